"""WARC records and a Merkle fixity audit of replicas, in DataFrame operations.

Pages become WARC/1.1 resource records, dealt to archives of bounded size by a hash of page id and url and ordered by them, each
with its offset. A leaf is the SHA-256 of a record's digest, its length and the gap between it and the record before, so
the leaves of an archive fix its whole offset table; FANOUT neighbouring nodes, an ordered offset range, make a node of
the next level, up to one root for each archive. An audit compares roots of two replicas, and descends only below nodes
that differ, level by level, to the records at fault. A lost or added record moves the later ones of its archive, so the
records below differing nodes are paired by page id and url, not by place.

Cases: null urls or bodies are written as empty; null page ids form records like others (they sort first); repeated rows
are records of their own, ordered by their hash, and equal ones are paired first; an archive or record that only one replica
has is missing or extra; a page id and url with more than ARCHIVE_ROWS rows is dealt by its records' hashes and copies as
well, so that no archive holds them all; very long bodies are hashed whole; empty tables give an empty result; other columns
are not passed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

FANOUT = 16
ARCHIVE_ROWS = 512


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC resource record. The block and the header lines are fixed by the format."""
    block = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), F.sha2(block, 256), F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), block, F.lit("\r\n\r\n").cast("binary"))


def _key() -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).cast("binary"))


def crowded(pages: DataFrame) -> DataFrame:
    """key and number c of rows of each page id and url that has more than ARCHIVE_ROWS."""
    return shared.cut(pages.select(_key().alias("key")).groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > ARCHIVE_ROWS))


def leaves(pages: DataFrame, archives: int, crowd: DataFrame | None = None) -> DataFrame:
    """archive, ordinal, key (of page id and url), page_id, offset, length, sha256 of the record of each page (page_id, url, html).
    crowd: what crowded() finds; replicas to be compared need the same."""
    crowd = crowded(pages) if crowd is None else crowd
    most, total = crowd.agg(F.max("c"), F.sum("c")).first()
    raw = record(F.col("page_id"), F.col("url"), F.col("html"))
    out = pages.select("page_id", "url", _key().alias("key"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("sha256"))
    deal = F.col("key")
    if most:
        # equal rows are counted before they meet, then dealt out by blocks of copies; a block is spread over tasks before it is a list of rows
        out = shared.cut(out.groupBy(*out.columns).agg(F.count("*").alias("rows")))
        out = shared.attached(out, crowd, ["key"], most, total, "left")
        out = out.withColumn("block", F.explode(F.expr(f"sequence(0L, (rows - 1) div {ARCHIVE_ROWS})")))
        large = F.col("rows") > ARCHIVE_ROWS
        out = out.where(~large).unionByName(out.where(large).repartition("key", "sha256", "block"))
        out = out.withColumn("copy", F.explode(F.expr(f"sequence(1L, least(rows - block * {ARCHIVE_ROWS}, {ARCHIVE_ROWS}L))")))
        deal = F.when(F.col("c").isNull(), F.col("key")).otherwise(F.md5(F.concat_ws("|", "key", "sha256", F.col("block").cast("string")).cast("binary")))
    out = out.withColumn("archive", (F.conv(F.substring(deal, 1, 7), 16, 10).cast("long") % archives).cast("int"))
    place = Window.partitionBy("archive").orderBy("page_id", "url", "sha256")
    out = out.withColumn("ordinal", (F.row_number().over(place) - 1).cast("long"))
    return out.withColumn("offset", F.sum("length").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).select("archive", "ordinal", "key", "page_id", "offset", "length", "sha256")


def with_gaps(records: DataFrame) -> DataFrame:
    """records with gap, the bytes between the end of the record before in the archive and the offset."""
    before = F.lag(F.col("offset") + F.col("length"), 1, 0).over(Window.partitionBy("archive").orderBy("ordinal"))
    return records.withColumn("gap", F.col("offset") - before)


def tree(records: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (archive, node, hash) from the leaves to the roots, of with_gaps(). A parent hashes its children's hashes, in order."""
    leaf = F.sha2(F.concat_ws(":", F.col("gap").cast("string"), F.col("length").cast("string"), "sha256").cast("binary"), 256)
    out = [records.select("archive", F.col("ordinal").alias("node"), leaf.alias("hash"))]
    for _ in range(levels):
        below = out[-1].groupBy("archive", F.expr(f"node div {fanout}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("children"))
        out.append(below.select("archive", F.col("parent").alias("node"), F.sha2(F.array_join(F.col("children.hash"), "").cast("binary"), 256).alias("hash")))
    return out


def levels_for(records: DataFrame, fanout: int = FANOUT) -> int:
    """Levels above the leaves so that the largest archive has one root."""
    most = records.groupBy("archive").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    return max(1, math.ceil(math.log(most, fanout) - 1e-9)) if most > 1 else 1


def audit(one: DataFrame, two: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """archive, ordinal, status (damaged, displaced, missing, extra; seen from replica one) of the records at fault. Displaced is
    a whole record whose offset doesn't follow from the one before as it does in the other replica. Archive and ordinal are
    those in replica one, of an extra record those in replica two. one, two: leaves() by the same number of archives and crowd."""
    levels = max(levels_for(one, fanout), levels_for(two, fanout))
    one, two = with_gaps(one), with_gaps(two)
    mine, theirs = tree(one, levels, fanout), tree(two, levels, fanout)
    suspects = None
    down = lambda df, node: df.withColumn("parent", F.expr(f"{node} div {fanout}")).join(suspects, ["archive", "parent"], "left_semi").drop("parent")
    for level in range(levels, 0, -1):
        a, b = mine[level], theirs[level].withColumnRenamed("hash", "other")
        if suspects is not None:
            a, b = down(a, "node"), down(b, "node")
        both = a.join(b, ["archive", "node"], "full")
        suspects = shared.cut(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", F.col("node").alias("parent")))
    # nodes that are left out hold equal records on both sides, so what differs below the others is what differs at all
    same = ["archive", "key", "sha256", "gap", "copy"]
    copies = Window.partitionBy("archive", "key", "sha256", "gap").orderBy("ordinal")
    a, b = (down(x, "ordinal").select("archive", "key", "sha256", "gap", "ordinal").withColumn("copy", F.row_number().over(copies)) for x in (one, two))
    # records of a crowded key may lie in another archive once damaged
    turn = F.row_number().over(Window.partitionBy("key").orderBy("archive", "ordinal"))
    own, other = (x.join(y, same, "left_anti").select("key", turn.alias("turn"), F.struct("archive", "ordinal", "sha256").alias(n)) for x, y, n in ((a, b, "own"), (b, a, "other")))
    both = own.join(other, ["key", "turn"], "full")
    status = F.expr("CASE WHEN other IS NULL THEN 'missing' WHEN own IS NULL THEN 'extra' WHEN own.sha256 = other.sha256 THEN 'displaced' ELSE 'damaged' END")
    return both.select(F.coalesce("own.archive", "other.archive").alias("archive"), F.coalesce("own.ordinal", "other.ordinal").alias("ordinal"), status.alias("status"))


def op5_fixity(spark, sf_dir: str) -> DataFrame:
    """Every record with its place and hash, and what an audit against a replica says of it. The replica is the same pages
    with planted faults, by the hash of the page id. Modulo 97: the record of a page that leaves 7 has its first character
    replaced, one that leaves 11 has lost its last character. Modulo 389: one that leaves 13 is lost, one that leaves 17 is
    under another url, so that it is missing and another one is extra (extra ones are no rows here)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = max(1, -(-pages.count() // ARCHIVE_ROWS))
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long")
    fault, moved = drawn % 97, drawn % 389
    html = F.coalesce("html", F.lit(""))
    bad = F.when(fault == 7, F.concat(F.lit("\u0000"), F.expr("substring(coalesce(html, ''), 2)"))).when(fault == 11, F.expr("left(coalesce(html, ''), greatest(length(coalesce(html, '')) - 1, 0))")).otherwise(html)
    url = F.when(moved == 17, F.concat(F.coalesce("url", F.lit("")), F.lit("#moved"))).otherwise(F.col("url"))
    crowd = crowded(pages)
    own = shared.cut(leaves(pages, archives, crowd))
    replica = shared.cut(leaves(pages.where(moved != 13).select("page_id", url.alias("url"), bad.alias("html")), archives, crowd))
    found = audit(own, replica).where("status <> 'extra'")  # those have no record here
    return own.join(found, ["archive", "ordinal"], "left").select("page_id", "archive", "ordinal", "offset", "length", "sha256", F.coalesce("status", F.lit("intact")).alias("status"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, (SELECT greatest(1, CAST(ceil(count(*) / {ARCHIVE_ROWS}.0) AS BIGINT)) FROM pages) AS archives, chr(13) || chr(10) AS n, coalesce(CAST(page_id AS VARCHAR), '') AS i FROM pages),
r AS (SELECT *, 'WARC/1.1' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: <urn:page:' || i || '>' || n || 'WARC-Target-URI: ' || u || n || 'Content-Type: text/html' || n
  || 'WARC-Block-Digest: sha256:' || sha256(h) || n || 'Content-Length: ' || strlen(h) || n || n || h || n || n AS raw, md5(i || '|' || u) AS key, ('0x' || substr(md5(i), 1, 7))::BIGINT AS drawn FROM p),
c AS (SELECT *, strlen(raw) AS length, sha256(raw) AS sha256, count(*) OVER (PARTITION BY key) AS c, (row_number() OVER (PARTITION BY key, sha256(raw)) - 1) // {ARCHIVE_ROWS} AS block FROM r),
s AS (SELECT *, CAST(('0x' || substr(CASE WHEN c > {ARCHIVE_ROWS} THEN md5(key || '|' || sha256 || '|' || block) ELSE key END, 1, 7))::BIGINT % archives AS INTEGER) AS archive FROM c)
SELECT page_id, archive, row_number() OVER w - 1 AS ordinal, CAST(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length AS BIGINT) AS offset, length, sha256,
  CASE WHEN drawn % 389 IN (13, 17) THEN 'missing' WHEN drawn % 97 = 7 OR drawn % 97 = 11 AND h <> '' THEN 'damaged' ELSE 'intact' END AS status
FROM s WINDOW w AS (PARTITION BY archive ORDER BY page_id, u, sha256)
"""
