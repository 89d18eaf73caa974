"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of a source are put in seeded-shuffled order; the k-th of n has the fractional rank (k - u) / n,
where u in (0, 1) is drawn once for each source, so that many small sources spread too. All rows, sorted
by fractional rank, are cut into shards of equal row counts, so each shard has every source in proportion.

No window holds a whole source: ranks come from windows over (source, leading bits of the shuffle hash), offset by
running counts of those buckets, and places from windows over slices of the fractional rank, which rows fill evenly.

Cases: a null source is a source of its own; null texts have size 1 and the crc32 of no bytes; null and repeated ids are
dealt like others (rows equal in id and text are interchangeable); equal texts are dealt like other rows, since the law of
equal counts can't keep a group larger than a shard together; an empty table gives an empty result; of other columns only
those named in keep are passed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


def _hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of bytes, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int, seed: int = 20, source: str = "source", keep: tuple[str, ...] = (), window_rows: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, the columns keep, shard and slot (gapless from 0) of every row of docs (doc_id, text, source).

    window_rows: rows that one window is meant to hold; by default the square root of all rows, so that windows and the
    tables of their counts grow alike.
    """
    body = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select(
        "doc_id", F.col(source).alias("_source"), *keep, (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        _hashed(F.lit(f"{seed}|".encode()), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b"|"), body).alias("_order"),
    )
    slim = shared.cut(slim)
    total = slim.count()
    buckets = max(1, -(-total // (window_rows or max(1, math.isqrt(total)))))
    slim = slim.withColumn("_bucket", F.floor(F.col("_order") / F.lit(2.0**60) * buckets).cast("long"))
    own = Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id")
    counts = slim.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("_source").orderBy("_bucket")
    counts = counts.select(
        F.col("_source").alias("s"), F.col("_bucket").alias("b"), (F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("_source")).alias("_in_source")
    )
    ranked = slim.withColumn("_k", F.row_number().over(own))
    ranked = ranked.join(counts, ranked["_source"].eqNullSafe(counts["s"]) & (ranked["_bucket"] == counts["b"])).drop("s", "b")
    phase = _hashed(F.lit(f"{seed}|".encode()), F.coalesce(F.col("_source").cast("string"), F.lit("")).cast("binary")) / F.lit(2.0**60) * 0.998 + 0.001
    ranked = ranked.withColumn("_part", (F.col("_before") + F.col("_k") - phase) / F.col("_in_source"))
    ranked = ranked.withColumn("_slice", F.least(F.floor(F.col("_part") * buckets), F.lit(buckets - 1)).cast("long"))
    ranked = shared.cut(ranked.select("doc_id", *keep, "size", "text_crc32", "_source", "_order", "_part", "_slice"))
    slices = ranked.groupBy("_slice").agg(F.count("*").alias("_n"))
    # one row for each window_rows rows: so few that they fit one window
    slices = slices.select(F.col("_slice").alias("z"), (F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_from"))
    placed = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("_slice").orderBy("_part", "_source", "_order", "doc_id")) - 1)
    placed = placed.join(slices, placed["_slice"] == slices["z"]).withColumn("_place", F.col("_from") + F.col("_k"))
    n = max(total, 1)
    shard = F.expr(f"(_place * {shards}) div {n}")
    return placed.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", *keep, "shard", (F.col("_place") - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")).cast("long").alias("slot"))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = interleave(docs, 16, keep=("source",))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: CRC-32 byte by byte: the table of its reflected polynomial 0xEDB88320 is made by eight steps a byte.
_STEP = "(CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END)"
SQL = f"""
WITH steps AS (SELECT i, i AS c, 0 AS k FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
t1 AS (SELECT i, {_STEP.format('c')} AS c FROM steps), t2 AS (SELECT i, {_STEP.format('c')} AS c FROM t1), t3 AS (SELECT i, {_STEP.format('c')} AS c FROM t2), t4 AS (SELECT i, {_STEP.format('c')} AS c FROM t3),
t5 AS (SELECT i, {_STEP.format('c')} AS c FROM t4), t6 AS (SELECT i, {_STEP.format('c')} AS c FROM t5), t7 AS (SELECT i, {_STEP.format('c')} AS c FROM t6), t8 AS (SELECT i, {_STEP.format('c')} AS c FROM t7),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM t8),
d AS (SELECT doc_id, source, coalesce(text, '') AS x, ('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS o,
  CAST(('0x' || substr(md5('20|' || coalesce(source, '')), 1, 15))::BIGINT AS DOUBLE) / 1152921504606846976.0 * 0.998 + 0.001 AS phase FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY o, doc_id NULLS FIRST) - phase) / count(*) OVER (PARTITION BY source) AS part FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY part, source NULLS FIRST, o, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, CAST(strlen(x) + 1 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
  'rows' AS law, CAST(place * 16 // n AS INTEGER) AS shard, CAST(place - (place * 16 // n * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM p, crc
"""
