"""Metrics of segmentations, each averaged over words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge import functions as L


def segmentation(df: DataFrame, by: list[str]) -> DataFrame:
    """words, ur_acc, seg_acc, f1, edit of rows (guess_ur, truth_ur, guess, truth: arrays of segments)."""
    prf = L.set_prf(F.col("guess"), F.col("truth"))
    return df.groupBy(*by).agg(
        F.count("*").alias("words"),
        F.avg((F.col("guess_ur") == F.col("truth_ur")).cast("double")).alias("ur_acc"),
        F.avg((F.col("guess") == F.col("truth")).cast("double")).alias("seg_acc"),
        F.avg(prf["f1"]).alias("f1"),
        F.avg(L.edit_distance(F.col("guess"), F.col("truth"))).alias("edit"),
    )


def span_f1(df: DataFrame, by: list[str]) -> DataFrame:
    """words and span_f1 of rows (guess, truth: arrays of structs i, j), from the decoded spans."""
    return df.groupBy(*by).agg(F.count("*").alias("words"), F.avg(L.set_prf(F.col("guess"), F.col("truth"))["f1"]).alias("span_f1"))


def coverage(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """words, best_right, in_sample, rescued: how often the best candidate (source best) is the gold form, the sample holds
    it, and the sample holds it though the best is wrong. samples: word_id, ur, source; gold: word_id, ur_gold."""
    per = samples.join(gold, "word_id").groupBy("word_id").agg(
        F.max(((F.col("source") == "best") & (F.col("ur") == F.col("ur_gold"))).cast("int")).alias("b"), F.max((F.col("ur") == F.col("ur_gold")).cast("int")).alias("s")
    )
    return per.agg(F.count("*").alias("words"), F.sum("b").alias("best_right"), F.sum("s").alias("in_sample"), F.sum(((F.col("s") == 1) & (F.col("b") == 0)).cast("int")).alias("rescued"))
