"""Queries of this folder and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name: (module, function, name of the module's SQL or None).
QUERIES = {
    "op8_bpe": ("bpe", "op8_bpe", None),
    "op9_decontamination": ("decontam", "op9_decontamination", "SQL"),
    "op7_language": ("langid", "op7_language", None),
    "op6_perplexity": ("ngram_lm", "op6_perplexity", None),
    "op10_near_duplicates": ("jaccard", "op10_near_duplicates", "SQL"),
    "op3_sharding": ("sharding", "op3_sharding", "SQL"),
    "op2_line_dedup": ("line_dedup", "op2_line_dedup", "SQL"),
    "op1_secrets": ("secrets", "op1_secrets", "SQL"),
    "op4_vptree": ("vptree", "op4_vptree", None),
    "op5_fixity": ("warc", "op5_fixity", "SQL"),
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), function) for name, (module, function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, _, sql) in QUERIES.items() if sql}
