"""Line dedup by a suffix array over line ids, in DataFrame operations only.

Every document is a sequence of lines; documents follow each other by (doc_id, hash of the text). Prefix doubling sorts
the suffixes: the rank at depth 2h is the place in the order of the pairs (rank at depth h, rank h lines on), taken by a
range-partitioned sort with running counts. A suffix that shares its prefix with no other is settled and left out, so the
doubling ends when every suffix is. Suffixes of one rank at depth h are an interval of the array whose longest common
prefix is h or more; its first copy is the member that stands first in the corpus.

The exact lengths come from the intervals in between. Going back down the depths, each suffix tries to grow its common
prefix with an earlier copy by h more lines: it joins its interval with the rank at the end of the prefix, which makes the
narrower interval, and has grown if that one's first member stands before it without overlap. After depth 1 every suffix
has its longest run that an earlier copy has too. Members that don't grow stay in an interval as possible first copies.

Runs of min_words words or more are deleted; their first copies stay.

Hot lines and hot intervals: both are summed before they are joined, and those of many members are joined by a broadcast
of at most shared.SHARE rows, so no task gets more than a fixed share of all members.

Cases: null texts stay null; empty texts and blank lines have no words; trailing white space of a line does not count;
rows equal in doc_id and text are one document and share its result; null ids come first; other columns pass through,
whatever their names (text is replaced, columns named n_lines or n_deleted are replaced); an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

MIN_WORDS = 50
DOC = ("d", "th")


def _document(doc_id: Column, text: Column) -> dict[str, Column]:
    """The non-null key (d, th) of a document, in the order of documents."""
    return {"d": F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))), "th": F.xxhash64(text, doc_id.isNull())}


def _members() -> list[Column]:
    """Number of members of a group, and the first of them."""
    return [F.count("*").alias("c"), F.min(F.struct(*DOC, "pos")).alias("first")]


def ranked(keys: DataFrame, by: list[str], uri: str) -> DataFrame:
    """keys (by, c and more) with place: the number of suffixes, c for each row, that sort before it."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = shared.table(keys.repartitionByRange(n, *by).withColumn("_p", F.spark_partition_id()), uri)
    # one row for each of n partitions
    before = held.groupBy("_p").agg(F.sum("c").alias("_c")).select("_p", (F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_from"))
    inside = F.sum("c").over(Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    return held.withColumn("_in", inside).join(F.broadcast(before), "_p").withColumn("place", F.col("_from") + F.col("_in")).drop("_p", "_in", "_from")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """d, th, pos, h1, h2 (the line) and need (lines from here that have min_words words, null if there are not so many) of the
    distinct documents."""
    line = F.rtrim("line")
    out = docs.where("text IS NOT NULL").select(*(c.alias(n) for n, c in _document(F.col("doc_id"), F.col("text")).items()), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = out.select(*DOC, "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.regexp_count("line", F.lit(r"[^ \t\r\f]+")).alias("words"))
    out = out.repartition(*DOC).dropDuplicates([*DOC, "pos"])
    whole = Window.partitionBy(*DOC)
    out = out.withColumn("at", F.sum("words").over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("long") - F.col("words"))
    reach = whole.orderBy("at").rangeBetween(0, min_words - 1)
    full = F.max(F.col("at") + F.col("words")).over(reach) - F.col("at") >= min_words
    return out.withColumn("need", F.when(full, F.max("pos").over(reach) - F.col("pos") + 1)).select(*DOC, "pos", "h1", "h2", "need")


def _earlier(length: Column) -> Column:
    """Whether the first copy of a run of some lines stands before it without overlap."""
    return ~((F.col("first.d") == F.col("d")) & (F.col("first.th") == F.col("th"))) | (F.col("pos") >= F.col("first.pos") + length)


@dataclass
class Level:
    """Suffixes that share a prefix of one depth with another: d, th, pos, need, rank and later (an earlier copy has it); the members of the largest interval."""

    rows: DataFrame
    largest: int


def array_levels(lines: DataFrame, folder: str) -> tuple[list[Level], int]:
    """(levels of the depths 1, 2, 4 and on, number of lines)."""
    out: list[Level] = []
    rows, keys = shared.table(lines, f"{folder}/lines"), ["h1", "h2"]
    total = rows.count()
    while True:
        k, h = len(out), 1 << len(out)
        classes = ranked(rows.groupBy(*keys).agg(*_members()).where("c > 1"), keys, f"{folder}/classes{k}")
        largest = classes.agg(F.max("c")).first()[0]
        if largest is None:
            return out, total
        rows = shared.attached(rows, classes.select(*keys, "c", "first", "place"), keys, largest, total)
        level = shared.table(rows.select(*DOC, "pos", "need", F.col("place").alias("rank"), _earlier(F.lit(h)).alias("later")), f"{folder}/level{k}")
        out.append(Level(level, largest))
        on = F.first("rank").over(Window.partitionBy(*DOC).orderBy("pos").rangeBetween(h, h))
        rows, keys = shared.table(level.withColumn("on", on).where("on IS NOT NULL").drop("later"), f"{folder}/pairs{k}"), ["rank", "on"]


def _grown(state: DataFrame, level: DataFrame, h: int, largest: int, total: int, folder: str) -> DataFrame:
    """state after each suffix that asks has tried to grow by h lines; intervals in which none asks are left out."""
    asked = state.where("asks").select("class").distinct()
    state = state.where("asks").unionByName(state.where("NOT asks").join(asked, "class", "left_semi").select(*state.columns))
    on = level.select(F.col("d").alias("d2"), F.col("th").alias("t2"), F.col("pos").alias("p2"), F.col("rank").alias("on"))
    rows = state.join(on, (F.col("d") == F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("pos") + F.col("len") == F.col("p2")), "left").drop("d2", "t2", "p2")
    rows = shared.table(rows, f"{folder}/tried{h}")
    some = rows.where("on IS NOT NULL")
    narrow = some.groupBy("class", "on").agg(*_members(), F.max("asks").alias("any")).where("c > 1 AND any")
    some = shared.attached(some, narrow.drop("any"), ["class", "on"], largest, total, "left").withColumn("grew", F.coalesce(F.col("asks") & _earlier(F.col("len") + h), F.lit(False)))
    deeper = F.struct((F.col("len") + h).alias("len"), F.xxhash64("class", "on", F.lit(h)).alias("class"), F.col("grew").alias("asks"))
    same = F.struct("len", "class", "asks")
    ways = F.when(F.col("c").isNull(), F.array(same)).when(F.col("grew"), F.array(deeper)).otherwise(F.array(same, deeper))
    some = some.select(*DOC, "pos", "need", F.explode(ways).alias("w")).select(*DOC, "pos", "need", "w.*")
    out = some.unionByName(rows.where("on IS NULL").drop("on").select(*some.columns))
    return out.withColumn("asks", F.col("asks") & (F.col("len") + h - 1 >= F.col("need")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, folder: str | None = None) -> DataFrame:
    """d, th, pos, len: for each line the longest run from there, of min_words words or more, that an earlier copy has."""
    folder = folder or shared.new_folder(docs.sparkSession, "lines")
    levels, total = array_levels(_lines(docs, min_words), folder)
    state, deeper = None, None
    for k in range(len(levels) - 1, -1, -1):
        h, level = 1 << k, levels[k].rows
        if state is not None:
            # what asks here shares twice as many lines at least
            state = _grown(state, level, h, levels[k + 1].largest, total, folder)
        fresh = level if deeper is None else level.join(deeper, [*DOC, "pos"], "left_anti")
        fresh = fresh.select(*DOC, "pos", "need", F.lit(h).alias("len"), F.xxhash64("rank", F.lit(k)).alias("class"), F.coalesce(F.col("later") & (F.col("need") <= 2 * h - 1), F.lit(False)).alias("asks"))
        state = shared.table(fresh if state is None else state.unionByName(fresh), f"{folder}/state{k}")
        deeper = level.where("later").select(*DOC, "pos")
    if state is None:
        return _lines(docs.limit(0), min_words).select(*DOC, "pos", F.lit(1).alias("len"))
    return state.where("asks").select(*DOC, "pos", "len")


def _free(columns: list[str], name: str) -> str:
    """A name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs (doc_id, text) with later copies of repeated runs cut out of text, n_lines before and n_deleted."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    folder = shared.new_folder(docs.sparkSession, "lines")
    whole = Window.partitionBy(*DOC).orderBy("pos", "len")
    runs = repeated_runs(docs.select("doc_id", "text"), min_words, folder).withColumn("end", F.col("pos") + F.col("len"))
    runs = runs.withColumn("new", (F.col("pos") > F.coalesce(F.max("end").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(whole.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*DOC, "run").agg(F.min("pos").alias("pos"), F.max("end").alias("end"))
    d, th, cuts, lines = (_free(docs.columns, n) for n in ("_d", "_th", "_cuts", "_lines"))
    runs = shared.cut(runs.groupBy(*DOC).agg(F.collect_list(F.struct("pos", "end")).alias(cuts)).withColumnsRenamed({"d": d, "th": th}))
    shared.remove(folder)
    key = _document(F.col("doc_id"), F.col("text"))
    out = docs.select(*columns).withColumns({d: key["d"], th: key["th"]}).join(runs, [d, th], "left")
    gone = F.flatten(F.transform(cuts, lambda c: F.sequence(c["pos"], c["end"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(F.col(lines)) - 1), gone)
    out = out.withColumn(lines, F.split("text", "\n")).withColumn("n_lines", F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0))
    out = out.withColumn("n_deleted", F.when(F.col(cuts).isNull(), 0).otherwise(F.size(gone)))
    cut_text = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    return out.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(cut_text)).select(*columns, "n_lines", "n_deleted")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), "text")


#: A run of 50 words or more is the union of the shortest such runs that start or end at its lines, so it is enough to compare those.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS pos FROM d),
w AS (SELECT doc_id, pos, rtrim(ls[pos + 1], ' ') AS line, len(regexp_extract_all(ls[pos + 1], '[^ \t\r\f]+')) AS words FROM l),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS aft FROM w),
r AS (SELECT *, aft - words AS bef FROM c),
r1 AS (SELECT doc_id, pos AS a, max(pos) OVER f AS b, max(aft) OVER f - bef >= 50 AS good FROM r WINDOW f AS (PARTITION BY doc_id ORDER BY bef RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
r2 AS (SELECT doc_id, min(pos) OVER f AS a, pos AS b, aft - min(bef) OVER f >= 50 AS good FROM r WINDOW f AS (PARTITION BY doc_id ORDER BY aft RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
v AS (SELECT doc_id, a, b FROM r1 WHERE good UNION SELECT doc_id, a, b FROM r2 WHERE good),
s AS (SELECT v.doc_id, v.a AS pos, v.b - v.a + 1 AS k, string_agg(w.line, chr(10) ORDER BY w.pos) AS t FROM v JOIN w ON v.doc_id = w.doc_id AND w.pos BETWEEN v.a AND v.b GROUP BY ALL),
f AS (SELECT *, first_value(doc_id) OVER g AS d1, first_value(pos) OVER g AS p1 FROM s WINDOW g AS (PARTITION BY k, t ORDER BY doc_id, pos)),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS pos FROM f WHERE d1 <> doc_id OR pos >= p1 + k),
kept AS (SELECT l.doc_id, count(g.pos) AS n_deleted, coalesce(string_agg(l.ls[l.pos + 1], chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT x.doc_id, CASE WHEN x.text IS NULL THEN 0 ELSE len(string_split(x.text, chr(10))) END AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted, k.text FROM documents x LEFT JOIN kept k ON x.doc_id = k.doc_id
"""
