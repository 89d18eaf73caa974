"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans stand on their own: assignments of 12 and more characters, access ids of 18 and more, runs of 16 and more hex
digits. Weak candidates are reported only where complementary parts co-occur. They are secrets (assigned values of under 12
characters, values of NAMED characters behind other names of keys and secrets such as secret_access_key, bare base64-like
runs of 40 with a digit and letters of either case), named identifiers, access ids of under 18 characters, and endpoints.
Within RADIUS code points in one scope, which is a text between blank lines, a secret needs an identifier, an access id or an
endpoint, an identifier or access id needs a secret, an endpoint needs both. A value behind another name or a bare run that
begins inside another candidate is a part of that one; a value that begins like an access id is no secret. Parts are joined by the interval around each candidate:
windows ordered by place carry the nearest end before and the nearest start behind of each class of parts, so no pairs
are listed.

Candidates of rows equal in doc_id and text are grouped before linking; the result has a row for each row.

Cases: null texts count as empty; null ids are kept; texts without candidates have zero counts and an empty list; very long
texts are scanned whole; an empty table gives an empty result; other columns are not passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint", "weak_access")
RADIUS = 300
#: Least characters of a value behind another name.
NAMED = 6

#: Fixed patterns: what stands before a value, and values.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
IDENTIFIER = r"""(?:[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee]|_?[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt](?:_?[Ii][Dd])?|[Kk][Ee][Yy]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?"""
KEY = r"""(?i:(?:secret|private|access|account|auth|signing|shared|storage|master|encryption)(?:[_.-]?[A-Z]{1,12})??[_.-]?key|secret[_.-][A-Z_.-]{1,24}|[_.-]key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?(?:/[A-Za-z0-9/_.%~-]*)?"
BARE = "[A-Za-z0-9+/]{40,}={0,2}"
BLANK = r"\n[ \t\r]*\n"


def _matches(text: Column, kind: int, before: str, value: str) -> Column:
    """array<struct<kind, i, gap, size, value>> of leftmost matches that don't overlap: code points between the last match
    and this one, of the match, and of its value (0: no candidate). A match of (as little as possible)(before value) starts
    where the last one ended, so lengths add up to places; what is left at the end is a match of size 0, else the search for
    another would start anew at every character. Texts without a match are told apart first, by a search that extracts nothing."""
    pattern = F.lit(f"(?s)(.*?)({before}{value}|\\z)")
    gaps = F.regexp_extract_all(text, pattern, F.lit(1))
    found = F.regexp_extract_all(text, pattern, F.lit(2))

    def counted(m: Column) -> Column:
        own = F.regexp_extract(m, f"(?s)^{before}({value})$", 1) if before else m
        if kind == 7:
            return F.when(own.startswith("AKIA"), 0).otherwise(F.length(own))
        if kind == 8:
            return F.when(own.rlike("[0-9]") & own.rlike("[a-z]") & own.rlike("[A-Z]"), F.length(own)).otherwise(0)
        return F.length(own)

    sized = F.transform(found, lambda m: F.struct(F.length(m).alias("size"), counted(m).alias("value")))
    both = F.zip_with(gaps, sized, lambda g, m: F.struct(F.length(g).alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    both = F.filter(both, lambda x: x["size"] > 0)
    both = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    return F.when(text.rlike(before + value), both).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:int>>"))


#: Number, pattern before the value, and value of what is looked for. 7 and 8 become weak secrets, 9 ends a scope.
SOUGHT = ((0, ASSIGN, VALUE), (1, "", ACCESS), (2, "", HEX), (4, IDENTIFIER, VALUE), (5, "", ENDPOINT), (7, KEY, VALUE), (8, "", BARE), (9, "", BLANK))
#: Kinds inside which no value behind another name and no bare run begins.
COVER = (0, 1, 2, 4, 5, 7)


def scan(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id and spans, array<struct<start, kind, end>> in code points (end exclusive; kind: place in KINDS), for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:int>>")
    out = docs.select("doc_id", F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    out = out.select("doc_id", "key", "text", *(_matches(F.col("text"), k, before, value).alias(f"m{k}") for k, before, value in SOUGHT if k < 9))
    weak = F.exists("m0", lambda m: m["value"] < 12) | F.exists("m1", lambda m: m["value"] < 18)
    for k in (4, 5, 7, 8):
        weak = weak | (F.size(f"m{k}") > 0)
    found = F.concat(*(f"m{k}" for k, _, _ in SOUGHT if k < 9), F.when(weak, _matches(F.col("text"), *SOUGHT[-1])).otherwise(none))
    out = out.select("doc_id", "key", found.alias("found")).groupBy("doc_id", "key").agg(F.first("found").alias("found"), F.count("*").alias("copies"))
    out = out.select("doc_id", "key", "copies", F.explode_outer("found").alias("m")).select("doc_id", "key", "copies", "m.*")

    whole = Window.partitionBy("doc_id", "key")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size"))
    ahead = F.max(F.when(F.col("kind").isin(*COVER), F.col("end"))).over(whole.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("inside", F.coalesce(ahead > F.col("start"), F.lit(False)))
    out = out.withColumn("scope", F.sum((F.col("kind") == 9).cast("int")).over(whole.orderBy("start").rangeBetween(Window.unboundedPreceding, 0)))
    kind = f"""CASE WHEN kind = 0 AND value < 12 THEN 3 WHEN kind = 1 AND value < 18 THEN 6
        WHEN kind = 7 THEN CASE WHEN value >= {NAMED} AND NOT inside THEN 3 END WHEN kind = 8 THEN CASE WHEN value >= 40 AND NOT inside THEN 3 END ELSE kind END"""
    out = out.withColumn("kind", F.expr(kind))
    scope = Window.partitionBy("doc_id", "key", "scope").orderBy("start", "kind")
    kinds = {"secret": (0, 2, 3), "who": (1, 4, 6), "where": (5,)}
    for name, own in kinds.items():
        part = F.col("kind").isin(*own)
        before = F.max(F.when(part, F.col("end"))).over(scope.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start") - radius
        behind = F.min(F.when(part, F.col("start"))).over(scope.rowsBetween(1, Window.unboundedFollowing)) <= F.col("end") + radius
        out = out.withColumn(name, F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False)))
    told = F.expr("CASE kind WHEN 3 THEN who OR where WHEN 4 THEN secret WHEN 5 THEN who AND secret WHEN 6 THEN secret WHEN 9 THEN false ELSE kind IS NOT NULL END")
    span = F.when(told, F.struct("start", "kind", "end"))
    out = out.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.first("copies").alias("copies"))
    return out.select("doc_id", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def listed(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return out.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] > 2)).cast("long").alias("n_linked"),
    )


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for kind, before, value in SOUGHT:
        pattern = quoted(f"(?s)(.*?)({before}({value})|\\z)")
        parts.append(f"SELECT r, {kind} AS k, unnest(range(len(g))) AS i, unnest(g) AS gap, unnest(m) AS whole, unnest(v) AS val FROM (SELECT r, regexp_extract_all(t, {pattern}, 1) AS g, regexp_extract_all(t, {pattern}, 2) AS m, regexp_extract_all(t, {pattern}, 3) AS v FROM d)")
    near = lambda own: f"(coalesce(max(CASE WHEN k IN ({own}) THEN e END) OVER p >= s - {RADIUS}, false) OR coalesce(min(CASE WHEN k IN ({own}) THEN s END) OVER q <= e + {RADIUS}, false))"
    names = "CASE k " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
ended AS (SELECT r, k, val, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS e, length(whole) AS n FROM m WHERE whole <> ''),
placed AS (SELECT r, k, e - n AS s, e, length(val) AS v, CASE k WHEN 7 THEN length(val) >= {NAMED} AND NOT starts_with(val, 'AKIA')
  WHEN 8 THEN regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') ELSE true END AS good FROM ended),
found AS (SELECT *, coalesce(max(CASE WHEN k IN ({', '.join(map(str, COVER))}) THEN e END) OVER (PARTITION BY r ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s, false) AS inside FROM placed),
kept AS (SELECT r, CASE WHEN k IN (7, 8) OR k = 0 AND v < 12 THEN 3 WHEN k = 1 AND v < 18 THEN 6 ELSE k END AS k, s, e FROM found WHERE good AND NOT (inside AND k IN (7, 8))),
scoped AS (SELECT *, count(*) FILTER (WHERE k = 9) OVER (PARTITION BY r ORDER BY s) AS scope FROM kept),
linked AS (SELECT *, {near('0, 2, 3')} AS secret, {near('1, 4, 6')} AS who, {near('5')} AS place FROM scoped
  WINDOW p AS (PARTITION BY r, scope ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY r, scope ORDER BY s, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
told AS (SELECT r, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c, count(*) FILTER (WHERE k > 2) AS l,
  coalesce(string_agg({names}, ',' ORDER BY s, k) FILTER (WHERE k < 3), '') AS base, string_agg({names}, ',' ORDER BY s, k) AS spans
  FROM linked WHERE CASE k WHEN 3 THEN who OR place WHEN 4 THEN secret WHEN 5 THEN who AND secret WHEN 6 THEN secret ELSE k < 3 END GROUP BY r)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0) AS n_linked FROM d LEFT JOIN told USING (r)
"""


SQL = _sql()
