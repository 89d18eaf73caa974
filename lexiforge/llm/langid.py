"""Language identification with interpolated modified Kneser-Ney character models, one for each language.

Counting: each task counts the character n-grams of its labelled texts (letters in lower case, every run of other signs
one space, padding before each text) and sums them by language before they are dealt out. One task for each language
turns its distinct n-grams into sorted hash arrays of discounted probabilities and back-off weights in the shared folder;
their size follows the distinct n-grams, not the texts. Prediction maps those files into memory and takes the language of
the lowest cross-entropy for each symbol.

Rejection is calibrated by the mean and spread of a symbol's surprise under the model's own training text: a text is
rejected if its mean surprise is above both mean + margin * (surprise of a uniform choice - mean) and
mean + z * spread / sqrt(symbols), or if it has no letter.

Cases: null texts and texts without letters are "und" with score 0 and rejected; null languages are not learned from; if
nothing was learned, all are "und"; ties go to the language that sorts first; repeated rows count repeatedly; very long
texts are scored whole; an empty table gives an empty result; other columns pass through, clashing names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .texts import chunks, summed

ORDER = 4
CHUNK = 3 << 18
MARGIN = 0.5
Z = 8.0
RESULTS = {"lang_pred": "string", "lang_score": "double", "lang_surprise": "double", "lang_rejected": "boolean"}
PAD = 1
_symbols: np.ndarray | None = None


def symbols() -> np.ndarray:
    """16-bit symbol of each code point: letters as they are (those beyond 16 bits folded into the private area), the pad, else a space."""
    global _symbols
    if _symbols is None:
        code = np.arange(0x110000)
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _symbols = np.where(letter, np.where(code < 0x10000, code, 0xE000 + code % 0x1900), 32).astype(np.uint16)
        _symbols[0xD800] = PAD
    return _symbols


def grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram that ends in each symbol, offsets by text, letters of each text)."""
    pad = "\ud800" * (order - 1)
    joined = "".join(pad + (t or "").lower() for t in texts)
    seq = symbols()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = seq == 32
    keep = np.ones(len(seq), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    seq = seq[keep].astype(np.uint64)
    is_pad = seq == PAD
    starts = np.flatnonzero(is_pad)[:: order - 1] if order > 1 else np.zeros(0, int)
    real = np.concatenate(([0], np.cumsum(~is_pad)))
    letters = np.concatenate(([0], np.cumsum(~is_pad & (seq != 32))))
    edges = np.append(starts, len(seq))
    key = seq.copy()
    for k in range(1, order):
        key[k:] |= seq[:-k] << np.uint64(16 * k)
    return key[~is_pad], real[edges], np.diff(letters[edges])


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discounts for the counts 0, 1, 2, 3 and more."""
    n = [0, *(int((counts == k).sum()) for k in (1, 2, 3, 4))]
    out = np.array([0.0, 0.5, 0.75, 0.9])
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for k in (1, 2, 3):
            if n[k]:
                out[k] = min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05)
    return out


def fit(keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> dict[str, np.ndarray]:
    """Arrays of the model of one language: for each order m the n-grams and their discounted probabilities (k, a), the
    contexts and their back-off weights (c, g)."""
    out: dict[str, np.ndarray] = {}
    raw_keys, raw_counts = keys, counts
    for m in range(order, 0, -1):
        d = _discounts(counts)[np.minimum(counts, 3)]
        context = keys >> np.uint64(16)
        names, at = np.unique(context, return_index=True)
        total = np.add.reduceat(counts, at)
        mass = np.add.reduceat(d, at)
        per = np.diff(np.append(at, len(keys)))
        out |= {f"k{m}": keys, f"a{m}": (counts - d) / np.repeat(total, per), f"c{m}": names, f"g{m}": mass / total}
        if m > 1:
            keys, counts = summed(keys & np.uint64((1 << 16 * (m - 1)) - 1))
    out["uniform"] = np.array([1.0 / (len(out["k1"]) + 1)])
    surprise = -np.log(probability(out, raw_keys, order))
    n = raw_counts.sum()
    mean = (raw_counts * surprise).sum() / n
    out["spread"] = np.array([mean, np.sqrt((raw_counts * (surprise - mean) ** 2).sum() / n)])
    return out


def _held(names: np.ndarray, keys: np.ndarray, values: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], default)


def probability(model: dict[str, np.ndarray], keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Interpolated probability of the last symbol of each n-gram after the others."""
    p = np.full(len(keys), float(model["uniform"][0]))
    for m in range(1, order + 1):
        own = keys & np.uint64((1 << 16 * m) - 1) if m < 4 else keys
        p = _held(model[f"k{m}"], own, model[f"a{m}"], 0.0) + _held(model[f"c{m}"], own >> np.uint64(16), model[f"g{m}"], 1.0) * p
    return p


def _pack(lang: str, arrays: dict[str, np.ndarray]) -> bytes:
    """A file of one model: a line with its language and the name and length of each array, then the arrays."""
    head = "\t".join([lang.encode().hex(), *(f"{k}:{len(v)}:{v.dtype.str}" for k, v in arrays.items())]).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(v.tobytes() for v in arrays.values())


def _unpack(uri: str) -> tuple[str, dict[str, np.ndarray]]:
    head = bytes(shared.mapped(uri, np.uint8)[:4096]).split(b"\n", 1)[0]
    lang, *names = head.decode().strip().split("\t")
    at, out = len(head) + 1, {}
    for name, n, dtype in (x.split(":") for x in names):
        out[name] = shared.mapped(uri, dtype, at, int(n))
        at += int(n) * np.dtype(dtype).itemsize
    return bytes.fromhex(lang).decode(), out


def train(docs: DataFrame, order: int = ORDER) -> str:
    """Learn a model for each non-null lang from the texts of docs; the folder of the models."""
    folder = shared.new_folder(docs.sparkSession, "langid")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in chunks(batches, limit=CHUNK):
            key, offs, _ = grams(batch.column("text").to_pylist(), order)
            langs = batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                own = [key[a:b] for x, a, b in zip(langs, offs[:-1], offs[1:], strict=True) if x == lang]
                held.setdefault(lang, []).append(summed(np.concatenate(own)))
            for lang, parts in held.items():
                if len(parts) >= 8:
                    held[lang] = [merge(parts)]
        for lang, parts in held.items():
            keys, counts = merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    def merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))

    def build(table: pa.Table) -> pa.Table:
        lang = table.column("lang")[0].as_py()
        keys = table.column("gram").to_numpy().view(np.uint64)
        order_of = np.argsort(keys)
        model = fit(keys[order_of], table.column("n").to_numpy()[order_of], order)
        shared.publish(f"{folder}/{hashlib.sha1(lang.encode()).hexdigest()}.model", _pack(lang, model))
        return pa.table({"lang": [lang], "n": pa.array([len(keys)], pa.int64())})

    counted = docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(count, "lang string, gram long, n long")
    counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(build, "lang string, n long").count()
    return folder


def predict(docs: DataFrame, folder: str, order: int = ORDER, margin: float = MARGIN, z: float = Z) -> DataFrame:
    """All rows and columns of docs with lang_pred, lang_score (0 to 1), lang_surprise (nats for each symbol) and lang_rejected."""
    docs = docs.drop(*RESULTS)
    schema = docs.limit(0).select("*", *(F.lit(None).cast(t).alias(n) for n, t in RESULTS.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sorted((_unpack(u) for u in shared.listing(folder, ".model")), key=lambda m: m[0])
        names = np.array([lang for lang, _ in models], object)
        for batch in chunks(batches, limit=CHUNK):
            key, offs, letters = grams(batch.column("text").to_pylist(), order)
            n = np.diff(offs)
            known = (letters > 0) & (len(models) > 0)
            pred, score, surprise, rejected = np.full(len(n), "und", object), np.zeros(len(n)), np.zeros(len(n)), ~known
            if known.any():
                distinct = summed(key)[0]
                at = np.searchsorted(distinct, key)
                total = np.empty((len(models), len(n)))
                for k, (_, model) in enumerate(models):
                    run_sum = np.concatenate(([0.0], np.cumsum(-np.log(probability(model, distinct, order))[at])))
                    total[k] = run_sum[offs[1:]] - run_sum[offs[:-1]]
                mean = total / np.maximum(n, 1)
                best = mean.argmin(axis=0)
                low = mean[best, np.arange(len(n))]
                own = np.stack([m["spread"] for _, m in models])[best]
                flat = np.array([-np.log(m["uniform"][0]) for _, m in models])[best]
                limit = np.maximum(own[:, 0] + margin * (flat - own[:, 0]), own[:, 0] + z * own[:, 1] / np.sqrt(np.maximum(n, 1)))
                share = 1 / np.exp(-(mean - low) * np.minimum(n, 40)).sum(axis=0)
                pred[known], score[known], surprise[known], rejected[known] = names[best][known], share[known], low[known], (low > limit)[known]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(surprise), pa.array(rejected)], [*batch.schema.names, *RESULTS])

    return docs.mapInArrow(run, schema).select(*docs.columns, *RESULTS)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = train(docs.where(remainder(F.col("doc_id"), 5) != 0).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), folder)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_surprise").alias("surprise"), F.col("lang_rejected").alias("rejected"))
