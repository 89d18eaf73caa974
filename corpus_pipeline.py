"""Documents to training tokens: language, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last adds the tokens.
n_chars follows the text. Other columns pass through under any name; rows are taken as they are, with null ids and null or very
long texts, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm import bpe, decontam, jaccard, langid, line_dedup, shared


def _hidden(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """(docs with names for all other columns that clash with no result, expressions that bring all columns back)."""
    names = {c: c if c in needed else f"_own{k}" for k, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), [F.col(n).alias(c) for c, n in names.items()]


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Models are learned from all labelled documents; documents that they reject go (also null texts and texts without a letter)."""
    folder = langid.train(docs.select("text", "lang"))
    own, back = _hidden(docs, "text")
    return langid.predict(own, folder).where(~F.col("lang_rejected")).select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out; a document of which nothing but white space is left goes."""
    own, back = _hidden(docs, "doc_id", "text")
    out = line_dedup.dedup_lines(own)
    return _with_length(out.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"\S")).select(*back))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest (doc_id, hash of the text) stays, once if its row is repeated; documents
    without words are no duplicates and stay."""
    found = shared.cut(jaccard.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "text_hash", "class_key"))
    first = found.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("w")).select("w.*", F.lit(True).alias("once"))
    kept = first.union(found.where("class_key IS NULL").select("doc_id", "text_hash", F.lit(False)).distinct())
    key = {"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_n": F.col("doc_id").isNull()}
    kept = kept.select(*(c.alias(n) for n, c in key.items()), F.col("text_hash").alias("_t"), F.col("once").alias("_once"))
    own, back = _hidden(docs, "doc_id", "text")
    out = own.withColumns(key | {"_t": F.xxhash64("text")}).join(kept, ["_d", "_n", "_t"])
    if not found.where("class_key IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy("_d", "_n", "_t").orderBy("_d"))).where((F.col("_k") == 1) | ~F.col("_once"))
    return out.select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that consists of nothing else goes. Null texts and texts without
    words stay as they are."""
    own, back = _hidden(docs, "text")
    out = decontam.decontaminate(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    return _with_length(out.withColumn("text", F.col("cleaned")).select(*back))


#: Columns that the last stage adds; columns of documents with these names are replaced.
TOKENS = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with n_tokens, ids and the hashes of ids and decoded text."""
    own, back = _hidden(docs.drop(*TOKENS), "text")
    out = bpe.encode(own, ids=True, decoded=False)
    return out.select(*back, *(F.col(c).alias(n) for c, n in zip(("bpe_n", "bpe_ids", "bpe_ids_sha256", "bpe_decoded_sha256"), TOKENS, strict=True)))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can't express language models, near duplicates or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again. What a stage no longer needs
    is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = shared.new_folder(spark, f"pipeline-{name}")
        with shared.scope():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/documents.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        if before:
            shared.remove(before)
        before = folder
    return docs
