"""Registered queries of the morphology operators and their SQL.

Words are all distinct runs of a-z in the lower-case texts of documents, numbered by 48 bits of a hash. Gold analyses come from
fixed affix rules. Scores come from hashes, so that every engine has the same ones. Operators run with their defaults.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge import functions as L
from lexiforge import sources
from lexiforge.operators import metrics, models, tables
from lexiforge.operators.optimizer import AdaGrad

#: Fixed affixes of the gold rules.
PREFIXES = "un|re|in|dis|de"
SUFFIXES = "ly|ness|ing|ed|er|ion|al|s"
RULE = f"^((?:{PREFIXES})?)(.+?)((?:{SUFFIXES})?)$"
LABELS = 3
GT0 = [0.0, 1.0, 2.0]
GT = [[0.0, -1.0, 1.0], [-2.0, 1.0, 0.0], [1.0, 0.0, -1.0]]


def tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    return docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def words(spark, sf_dir: str) -> DataFrame:
    """word_id, word, n of documents."""
    return _numbered(tokens(spark, sf_dir))


def _numbered(found: DataFrame) -> DataFrame:
    return found.groupBy("word").agg(F.count("*").alias("n")).select(F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 12), 16, 10).cast("long").alias("word_id"), "word", "n")


def raw_line(word: Column) -> Column:
    """A corpus line of a word by the affix rules, (S (S (pre:prefix) (stem:stem)) (suf:suffix)), as far as the word has them."""
    pre, stem, suf = (F.regexp_extract(word, RULE, k) for k in (1, 2, 3))
    core = F.concat(F.lit("("), stem, F.lit(":stem)"))
    core = F.when(pre != "", F.concat(F.lit("(S ("), pre, F.lit(":prefix) "), core, F.lit(")"))).otherwise(core)
    return F.concat(word, F.lit(" "), F.when(suf != "", F.concat(F.lit("(S "), core, F.lit(" ("), suf, F.lit(":suffix))"))).otherwise(core))


def corpus(spark, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(F.col("word_id").alias("line_no"), "word", "n", raw_line(F.col("word")).alias("raw"))


def hashed_score(segment: Column, label: Column) -> Column:
    return (L.hash_key(F.concat(segment, F.lit("|"), label.cast("string"))) % 11 - 5).cast("double")


def hashed_scores(spark, sf_dir: str) -> DataFrame:
    return models.packed_table(words(spark, sf_dir), LABELS, hashed_score)


def q_corpus_words(spark, sf_dir):
    return words(spark, sf_dir)


def q_parse_leaves(spark, sf_dir):
    own = corpus(spark, sf_dir).select("word", F.posexplode(sources.segments(F.col("raw"))).alias("pos", "s"))
    return own.select("word", "pos", F.col("s.word").alias("segment"), "s.label", "s.i", "s.j", "s.chunk")


def q_tree_nodes(spark, sf_dir):
    own = sources.parse(corpus(spark, sf_dir)).select("sr", "ur", "parse_ok", F.explode("nodes").alias("x")).where("x.node_id > 0")
    return own.select("sr", F.col("x.node_id").alias("node_id"), F.col("x.parent_id").alias("parent_id"), "x.i", "x.j", F.col("x.label").alias("label"), F.coalesce("x.word", F.lit("")).alias("segment"), "parse_ok")


def q_alphabet(spark, sf_dir):
    return sources.alphabet(words(spark, sf_dir).select(F.col("word").alias("line_no"), "word"), seeds=("o", "n", "y", "s", "e"))


def _symbols(spark, sf_dir):
    return sources.alphabet(words(spark, sf_dir).select(F.col("word").alias("line_no"), "word"))


def q_alignment_table(spark, sf_dir):
    return tables.alignments(_symbols(spark, sf_dir))


def _contexts(spark, symbols):
    twice = spark.createDataFrame([(c * 2,) for c in "onyse"], "symbol string")
    return symbols.select("symbol").union(twice).distinct()


def q_next_state(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    return tables.next_contexts(_contexts(spark, symbols), symbols)


def q_substring_ids(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    found = tables.substrings(words(spark, sf_dir), _contexts(spark, symbols).join(symbols, "symbol", "left").select("symbol", F.coalesce("id", F.lit(99)).alias("id")))
    return found.groupBy("id").agg(F.count("*").alias("n"))


def q_feature_counts(spark, sf_dir):
    own = words(spark, sf_dir)
    # features are counted before they are hashed
    feats = tables.chunk_features(own, own.where("n > 1").select("word")).groupBy("feature").agg(F.count("*").alias("n"))
    return feats.groupBy(L.hash_key(F.col("feature")).bitwiseAND(F.lit(65535)).alias("slot")).agg(F.sum("n").alias("n"))


def q_chunk_best(spark, sf_dir):
    own = words(spark, sf_dir).withColumn("t", models.chunk_table(F.col("word"), LABELS, hashed_score))
    return own.select("word", models.chunk_fold(F.col("word"), F.col("t"), GT0, GT, "max").cast("long").alias("best"))


def q_chunk_count(spark, sf_dir):
    own = words(spark, sf_dir).withColumn("t", models.chunk_table(F.col("word"), LABELS, lambda s, y: F.lit(0.0)))
    return own.select("word", F.round(F.log10(models.chunk_fold(F.col("word"), F.col("t"), GT0, GT, "count")), 6).alias("log_paths"))


def q_chunk_decode(spark, sf_dir):
    found = models.decode_chunks(hashed_scores(spark, sf_dir), GT0, GT)
    return found.select("word", F.col("score").cast("long").alias("score"), F.array_join(F.zip_with("segments", "labels", lambda s, y: F.concat_ws(":", s, y.cast("string"))), "#").alias("path"), F.round("log_z", 6).alias("log_z"))


def q_chunk_posterior(spark, sf_dir):
    """The probability that a word is one segment, by label."""
    own = words(spark, sf_dir).select("word_id", "word")
    p = models.chunk_posteriors(hashed_scores(spark, sf_dir), GT0, GT).where("i = 0").join(own, "word_id").where("j = length(word)")
    return p.select("word", "y", F.round("p", 6).alias("p")).where("p > 0")


def q_path_labels(spark, sf_dir):
    """How often each label follows another in the gold analyses."""
    labels = F.transform(sources.segments(F.col("raw")), lambda s: s["chunk"])
    own = corpus(spark, sf_dir).select(F.concat(F.array(F.lit(-1)), labels).alias("y"))
    return own.select(F.explode(F.zip_with(F.slice("y", 1, F.size("y") - 1), F.slice("y", 2, F.size("y") - 1), lambda a, b: F.struct(a.alias("before"), b.alias("y")))).alias("t")).groupBy("t.before", "t.y").agg(F.count("*").alias("n"))


def q_tree_yield(spark, sf_dir):
    return sources.parse(corpus(spark, sf_dir)).select("sr", "ur", "n", "m", F.size(F.filter("nodes", lambda x: x["is_leaf"])).alias("leaves"))


def q_tree_decode(spark, sf_dir):
    return models.decode_trees(hashed_scores(spark, sf_dir), LABELS).select("word", F.col("score").cast("long").alias("score"), "tree", F.round("log_z", 6).alias("log_z"))


def q_tree_nodes_expected(spark, sf_dir):
    """Expected number of nodes of each label."""
    return models.tree_posteriors(hashed_scores(spark, sf_dir), LABELS).groupBy("word_id", "y").agg(F.round(F.sum("p"), 6).alias("nodes"))


def q_grad_sum(spark, sf_dir):
    """A gradient of the whole word's place, summed over the prefixes that fire there."""
    own = words(spark, sf_dir)
    feats = own.select("word_id", F.lit(0).alias("i"), F.lit(1).alias("j"), F.explode(L.prefix_contexts(F.col("word"), F.length("word"), 4)).alias("feature"))
    places = own.select("word_id", F.lit(0).alias("i"), F.lit(1).alias("j"), F.explode(F.array(F.lit(0), F.lit(1))).alias("y")).withColumn("g", ((F.col("word_id") + F.col("y")) % 7 - 3).cast("double"))
    return tables.gradient_by_feature(feats, places, 2).select("k", F.col("g").cast("long").alias("g"))


LETTERS = ["", *"abcdefghijklmnopqrstuvwxyz"]


def q_align_best(spark, sf_dir):
    """Best alignment of each word with its stem by unit costs: less the edit distance."""
    scorer = models.TransducerScorer(LETTERS, LETTERS, copy=0.0, change=-1.0)
    own = words(spark, sf_dir).select("word", F.regexp_extract("word", RULE, 2).alias("ur"))
    return models.best_alignments(own, scorer).select("word", F.col("ur").alias("stem"), F.round("score").cast("long").alias("best"))


def hashed_scorer() -> models.TransducerScorer:
    """Pair weights of -5 to 5 from hashes, but -6 for insertions."""
    weight = lambda x, y: int(hashlib.md5(f"{x}>{y}".encode()).hexdigest()[:7], 16) % 11 - 5 if x else -6
    return models.TransducerScorer(LETTERS, [""], copy=0.0, change=0.0, pairs={(x, y): float(weight(x, y)) for x in LETTERS for y in LETTERS if x or y})


def q_transduce_best(spark, sf_dir):
    """With negative insertions each character goes to its best output."""
    return models.transduce(words(spark, sf_dir), hashed_scorer()).select("word", "ur", F.col("score").cast("long").alias("score"))


def _logz(spark, sf_dir, **limits):
    out = models.transduce(words(spark, sf_dir), replace(hashed_scorer(), **limits))
    return out.select("word", F.round("log_z", 6).alias("log_z"))


def q_transduce_logz(spark, sf_dir):
    """Log partition function over all outputs."""
    return _logz(spark, sf_dir)


def q_transduce_band(spark, sf_dir):
    """The same over outputs within a band."""
    return _logz(spark, sf_dir, band=3)


def q_transduce_clamped(spark, sf_dir):
    """Log sum of all alignments of each word with its stem."""
    own = words(spark, sf_dir).select("word_id", "word", F.regexp_extract("word", RULE, 2).alias("ur"))
    return models.clamped(own, hashed_scorer()).select("word_id", F.col("ur").alias("stem"), F.round("clamped", 6).alias("clamped"), F.round("ll", 6).alias("ll"))


def q_transduce_sample(spark, sf_dir):
    """The most frequent of a thousand outputs of each word, and how many different ones there were."""
    scorer = models.TransducerScorer(LETTERS, [""])
    drawn = models.candidates(words(spark, sf_dir), scorer, "sample").where("source = 'sample'")
    return drawn.groupBy("word").agg(F.sum("n").alias("draws"), F.count("*").alias("outputs"), F.min_by("ur", "pos").alias("ur"), F.max("n").alias("n"))


def _scored_candidates(spark, sf_dir):
    own = words(spark, sf_dir)
    stem, rest = F.regexp_extract("word", RULE, 2), F.regexp_extract("word", RULE, 3)
    each = F.array(F.col("word"), stem, F.concat(stem, rest), F.concat(F.col("word"), F.lit("e")))
    out = own.select("word_id", "word", F.posexplode(each).alias("pos", "ur"))
    return out.withColumn("score", L.hash_key(F.concat("ur", F.lit("~"), "word")) % 7)


def q_rerank_best(spark, sf_dir):
    best = tables.last_first(_scored_candidates(spark, sf_dir), "word", "score", "pos")
    return best.select("word", "pos", "ur", "score")


def q_softmax_weights(spark, sf_dir):
    out = models.softmax(_scored_candidates(spark, sf_dir).withColumn("score", F.col("score").cast("double")), "word")
    return out.select("word", "pos", F.round("weight", 6).alias("weight"))


def _metric_rows(spark, sf_dir):
    gold = F.transform(sources.segments(F.col("raw")), lambda s: s["word"])
    guess = F.filter(F.array(F.regexp_extract("word", "^(.*?)((?:ing|ed|s)?)$", 1), F.regexp_extract("word", "^(.*?)((?:ing|ed|s)?)$", 2)), lambda s: s != "")
    per = corpus(spark, sf_dir).select("word", sources.underlying(F.col("raw")).alias("truth_ur"), gold.alias("truth"), guess.alias("guess"), F.concat_ws("", guess).alias("guess_ur"))
    return tokens(spark, sf_dir).distinct().join(per, "word")


def q_seg_metrics(spark, sf_dir):
    out = metrics.segmentation(_metric_rows(spark, sf_dir), ["lang"])
    return out.select("lang", "words", *(F.round(c, 6).alias(c) for c in ("ur_acc", "seg_acc", "f1", "edit")))


def q_span_f1(spark, sf_dir):
    place = lambda xs: F.transform(xs, lambda x, k: F.struct((F.length(F.array_join(F.slice(xs, 1, k + 1), "")) - F.length(x)).alias("i"), F.length(F.array_join(F.slice(xs, 1, k + 1), "")).alias("j")))
    rows = _metric_rows(spark, sf_dir).select("lang", place(F.col("guess")).alias("guess"), place(F.col("truth")).alias("truth"))
    return metrics.span_f1(rows, ["lang"]).select("lang", "words", F.round("span_f1", 6).alias("span_f1"))


def _state(spark, sf_dir):
    own = words(spark, sf_dir)
    weights = own.where(F.col("word_id") % 3 != 0).select("word", F.col("word").alias("k"), ((F.col("word_id") % 17) / 8.0 - 1).alias("w"), (0.5 + (F.col("word_id") % 5)).alias("q"), (F.col("word_id") % 4).cast("int").alias("u"))
    gradient = own.where(F.col("word_id") % 2 == 0).select(F.col("word").alias("k"), ((F.col("word_id") % 13) / 4.0 - 1.5).alias("g"))
    return weights.drop("word"), gradient


def _adagrad(norm):
    def query(spark, sf_dir):
        weights, gradient = _state(spark, sf_dir)
        out = AdaGrad(eta=0.5, c=0.25, norm=norm).step(weights, gradient, 5)
        return out.select("k", (F.round("w", 6) + 0.0).alias("w"), F.round("q", 6).alias("q"), "u")

    return query


def q_adagrad_catchup(spark, sf_dir):
    return AdaGrad(eta=0.5, c=0.25).finalize(_state(spark, sf_dir)[0], 5).select("k", (F.round("w", 6) + 0.0).alias("w"), F.round("q", 6).alias("q"), "u")


def q_potentials_join(spark, sf_dir):
    own = words(spark, sf_dir)
    feats = own.select("word_id", F.lit(0).alias("i"), F.lit(1).alias("j"), F.explode(L.prefix_contexts(F.col("word"), F.length("word"), 4)).alias("feature"))
    keys = feats.select("feature").distinct().select((L.hash_key(F.col("feature")) * 2).bitwiseAND(F.lit(L.SLOTS - 1)).alias("k")).distinct()
    weights = keys.select("k", (F.col("k") % 9 - 4).cast("double").alias("w"))
    out = tables.potentials(feats, weights, 2, default=-1.0)
    return out.join(own, "word_id").groupBy("word", "y").agg(F.sum("score").cast("long").alias("score"))


def q_sparse_dot(spark, sf_dir):
    keys = F.transform(F.split("word", ""), lambda c: F.ascii(c) - 97)
    table = F.create_map(*(x for k in range(0, 26, 2) for x in (F.lit(k), F.lit(float(k)))))
    return words(spark, sf_dir).select("word", L.sparse_dot(keys, table).cast("long").alias("dot"))


def q_scatter_add(spark, sf_dir):
    keys = words(spark, sf_dir).select(F.transform(F.split("word", ""), lambda c: F.ascii(c)).alias("keys"))
    return tables.scatter(keys, 2.0, offset=5, scale=3).select("k", F.col("v").cast("long").alias("v"))


def q_coverage(spark, sf_dir):
    cands = _scored_candidates(spark, sf_dir).select("word_id", "word", "ur", F.when(F.col("pos") == 0, "best").otherwise("sample").alias("source"))
    gold = words(spark, sf_dir).select("word_id", F.regexp_extract("word", RULE, 2).alias("ur_gold"))
    return metrics.coverage(cands, gold)


_W = "t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), w AS (SELECT ('0x' || substr(md5(word), 1, 12))::BIGINT AS word_id, word, count(*) AS n FROM t GROUP BY word)"
_R = f"r AS (SELECT word_id, word, n, regexp_extract(word, '{RULE}', 1) AS a, regexp_extract(word, '{RULE}', 2) AS b, regexp_extract(word, '{RULE}', 3) AS c FROM w)"
_H = "('0x' || substr(md5({}), 1, 7))::BIGINT"
_SYM = "chars AS (SELECT DISTINCT unnest(string_split(word, '')) AS symbol FROM w), seen AS (SELECT symbol, min(word || '~' || lpad(CAST(instr(word, symbol) AS VARCHAR), 9, '0')) AS place FROM w JOIN chars ON instr(word, symbol) > 0 GROUP BY symbol)"
_CAND = f"c0 AS (SELECT word_id, word, unnest([0, 1, 2, 3]) AS pos, unnest([word, b, b || c, word || 'e']) AS ur FROM r), c AS (SELECT *, {_H.format("ur || '~' || word")} % 7 AS score FROM c0)"
_M = "m AS (SELECT d.lang, r.word, list_filter([a, b, c], lambda x: x <> '') AS truth, list_filter([regexp_extract(r.word, '^(.*?)((?:ing|ed|s)?)$', 1), regexp_extract(r.word, '^(.*?)((?:ing|ed|s)?)$', 2)], lambda x: x <> '') AS guess FROM (SELECT DISTINCT lang, word FROM t) d JOIN r USING (word))"
_F1 = "CASE WHEN len(list_intersect(list_distinct(g), list_distinct(t))) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(list_distinct(g), list_distinct(t))) / (len(list_distinct(g)) + len(list_distinct(t))) END"
_ST = "s AS (SELECT word AS k, (word_id % 17) / 8.0 - 1 AS w, 0.5 + (word_id % 5) AS q, word_id % 4 AS u FROM w WHERE word_id % 3 <> 0), g AS (SELECT word AS k, (word_id % 13) / 4.0 - 1.5 AS g FROM w WHERE word_id % 2 = 0), j AS (SELECT coalesce(s.k, g.k) AS k, g, coalesce(w, -0.1) AS w, coalesce(q, 0.0001) AS q, coalesce(u, 0) AS u FROM s FULL JOIN g ON s.k = g.k)"


def _list(xs) -> str:
    return "[" + ", ".join(map(_list, xs)) + "]" if isinstance(xs, list) else repr(xs)


_GE = _H.format("substr(word, i + 1, j - i) || '|' || y") + " % 11 - 5"
_LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda lse: exp(lse - list_max({0}))))))"
#: Scores of all segments that end at j, from the first start on, by label.
_COL = f"ge AS (SELECT word, i, j, list({_GE} ORDER BY y) AS s FROM (SELECT word, i, unnest(range(i + 1, length(word) + 1)) AS j FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)), (SELECT unnest([0, 1, 2]) AS y) GROUP BY word, i, j), col AS MATERIALIZED (SELECT word, j, list(s ORDER BY i) AS s FROM ge GROUP BY word, j)"
_GT0, _GTS = f"CAST({_list(GT0)} AS DOUBLE[])", f"CAST({_list(GT)} AS DOUBLE[][])"
#: a[j + 1][y]: best score, start and label before of the segments of label y that end at j; p: the paths there.
_BEST = f"""d AS (SELECT word, 0 AS j, [[[0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]]] AS a, [['']] AS p FROM w UNION ALL
SELECT word, j + 1, list_append(a, n), list_append(p, list_transform(n, lambda x, y: CASE WHEN x[2] = 0 THEN '' ELSE p[CAST(x[2] AS INT) + 1][CAST(x[3] AS INT)] || '#' END || substr(word, CAST(x[2] AS INT) + 1, CAST(j + 1 - x[2] AS INT)) || ':' || (y - 1)))
FROM (SELECT d.*, list_transform([1, 2, 3], lambda y: list_max(list_transform(range(1, d.j + 2), lambda i: CASE WHEN i = 1 THEN [s[1][y] + {_GT0}[y], 0, 0] ELSE list_max(list_transform([1, 2, 3], lambda b: [a[i][b][1] + {_GTS}[b][y] + s[i][y], i - 1, b])) END))) AS n FROM d JOIN col ON d.word = col.word AND col.j = d.j + 1))"""
#: As _BEST with sums: a[j + 1][y].
_SUMS = f"""z AS (SELECT word, 0 AS j, [[0.0::DOUBLE]] AS a FROM w UNION ALL
SELECT z.word, z.j + 1, list_append(a, list_transform([1, 2, 3], lambda y: {_LSE.format(f"flatten(list_transform(range(1, z.j + 2), lambda i: CASE WHEN i = 1 THEN [s[1][y] + {_GT0}[y]] ELSE list_transform([1, 2, 3], lambda b: a[i][b] + {_GTS}[b][y] + s[i][y]) END))")})) FROM z JOIN col ON z.word = col.word AND col.j = z.j + 1)"""


def _part(size: str, at: str, label: str) -> str:
    """Best score of a node of a size, first character and label."""
    return f"CASE WHEN {label} = 0 THEN a[{size}][{at}] ELSE psi[{size}][{at}][{label} + 1] END"


def _side(size: str, at: str, label: str) -> str:
    """The same node, printed."""
    return f"CASE WHEN {label} = 0 THEN p[{size}][{at}] ELSE substr(word, {at}, {size}) || ':' || {label} END"


_PAIR = f"""pr AS (SELECT x, y, CASE WHEN x = '' THEN -6 ELSE {_H.format("x || '>' || y")} % 11 - 5 END AS s FROM (SELECT unnest(list_prepend('', string_split('abcdefghijklmnopqrstuvwxyz', ''))) AS x), (SELECT unnest(list_prepend('', string_split('abcdefghijklmnopqrstuvwxyz', ''))) AS y) WHERE x <> '' OR y <> ''),
wt AS (SELECT x, sum(CASE WHEN y = '' THEN exp(s) ELSE 0 END) AS del, sum(CASE WHEN y <> '' THEN exp(s) ELSE 0 END) AS sub FROM pr WHERE x <> '' GROUP BY x), ins AS (SELECT sum(exp(s)) AS v FROM pr WHERE x = '')"""


def _outputs(band: int) -> str:
    """o: f[k + 1] is the sum over all ways to read i characters and write k, over exp(lg). Insertions come after each character."""
    after = lambda g, i: f"list_transform(range(0, length(word) + 7), lambda k: CASE WHEN abs({i} - k) < {band} THEN list_sum(list_transform(range(greatest(0, {i} - {band - 1}), k + 1), lambda u: {g}[u + 1] * pow(v, k - u))) ELSE 0.0 END)"
    return f"""{_PAIR}, o AS (SELECT word, v, 0 AS i, 0.0::DOUBLE AS lg, {after("list_prepend(1.0::DOUBLE, list_transform(range(0, length(word) + 6), lambda q: 0.0::DOUBLE))", "0")} AS f FROM w, ins UNION ALL
SELECT word, v, i + 1, lg + ln(list_max(n)), list_transform(n, lambda q: q / list_max(n)) FROM (SELECT word, v, i, lg, {after("g", "(i + 1)")} AS n FROM (SELECT word, v, i, lg, list_transform(f, lambda q, k: q * del + CASE WHEN k > 1 THEN f[k - 1] * sub ELSE 0.0 END) AS g FROM o JOIN wt ON wt.x = substr(word, i + 1, 1))))"""


SQL = {
    "corpus_words": f"WITH {_W} SELECT word_id, word, n FROM w",
    "parse_leaves": f"WITH {_W}, {_R}, x AS (SELECT word, unnest([a, b, c]) AS segment, unnest(['prefix', 'stem', 'suffix']) AS label, unnest([0, length(a), length(a) + length(b)]) AS i, unnest([0, 2, 1]) AS chunk FROM r) SELECT word, row_number() OVER (PARTITION BY word ORDER BY i) - 1 AS pos, segment, label, i, i + length(segment) AS j, chunk FROM x WHERE segment <> ''",
    "tree_nodes": f"""WITH {_W}, {_R}, k AS (SELECT *, CAST(a <> '' AS INT) AS p, CAST(c <> '' AS INT) AS s, length(word) AS m FROM r)
SELECT word AS sr, 1 AS node_id, 0 AS parent_id, 0 AS i, m AS j, 0 AS label, '' AS segment, true AS parse_ok FROM k WHERE s = 1
UNION ALL SELECT word, 1 + s, s, 0, length(a) + length(b), 0, '', true FROM k WHERE p = 1
UNION ALL SELECT word, 2 + s, 1 + s, 0, length(a), 1, a, true FROM k WHERE p = 1
UNION ALL SELECT word, 1 + s + 2 * p, s + p, length(a), length(a) + length(b), 0, b, true FROM k
UNION ALL SELECT word, 3 + 2 * p, 1, length(a) + length(b), m, 2, c, true FROM k WHERE s = 1""",
    "alphabet": f"WITH {_W}, {_SYM} SELECT symbol, CAST(row_number() OVER (ORDER BY place) + 5 AS INTEGER) AS id FROM seen WHERE symbol NOT IN ('o', 'n', 'y', 's', 'e') UNION ALL SELECT unnest(['', 'o', 'n', 'y', 's', 'e']), unnest([0, 1, 2, 3, 4, 5])",
    "alignment_table": f"WITH {_W}, {_SYM}, a AS (SELECT symbol, row_number() OVER (ORDER BY place) AS id FROM seen UNION ALL SELECT '', 0) SELECT p.symbol AS x, q.symbol AS y, CAST(p.id * (SELECT count(*) FROM a) + q.id + 1 AS BIGINT) AS align_id, p.symbol = q.symbol AS is_copy FROM a p, a q WHERE p.symbol <> '' OR q.symbol <> ''",
    "next_state": f"WITH {_W}, {_SYM}, a AS (SELECT symbol FROM seen UNION SELECT ''), ctx AS (SELECT symbol FROM a UNION SELECT unnest(['oo', 'nn', 'yy', 'ss', 'ee'])) SELECT p.symbol AS p, a.symbol AS y, (SELECT arg_max(x.symbol, length(x.symbol)) FROM ctx x WHERE suffix(p.symbol || a.symbol, x.symbol)) AS next_p FROM ctx p, a",
    "substring_ids": f"WITH {_W}, {_SYM}, a AS (SELECT symbol, row_number() OVER (ORDER BY place) AS id FROM seen UNION ALL SELECT '', 0), ctx AS (SELECT symbol, coalesce(id, 99) AS id FROM (SELECT symbol FROM a UNION SELECT unnest(['oo', 'nn', 'yy', 'ss', 'ee'])) LEFT JOIN a USING (symbol)), p AS (SELECT substr(word, i, k) AS symbol FROM (SELECT word, i, unnest(range(1, length(word) - i + 2)) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w))) SELECT coalesce(id, -1) AS id, count(*) AS n FROM p LEFT JOIN ctx USING (symbol) GROUP BY 1",
    "feature_counts": f"""WITH {_W}, p AS (SELECT word, i, unnest(range(i + 1, length(word) + 1)) AS j, '^' || word || '$' AS f, length(word) AS m FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
x AS (SELECT 'seg:' || substr(word, i + 1, j - i) AS f, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'left:' || substr(f, i - k + 1, k) AS f, count(*) AS n FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= i GROUP BY 1 UNION ALL SELECT 'right:' || substr(f, j + 1, least(m + 2, j + k) - j) AS f, count(*) AS n FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY 1
UNION ALL SELECT 'lexicon' AS f, count(*) AS n FROM p WHERE j - i > 3 AND substr(word, i + 1, j - i) IN (SELECT word FROM w WHERE n > 1))
SELECT {_H.format('f')} & 65535 AS slot, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1""",
    "chunk_best": f"WITH RECURSIVE {_W}, {_COL}, {_BEST} SELECT word, CAST(list_max(list_transform(a[j + 1], lambda x: x[1])) AS BIGINT) AS best FROM d WHERE j = length(word)",
    "chunk_decode": f"WITH RECURSIVE {_W}, {_COL}, {_BEST}, {_SUMS}, e AS (SELECT word, a[j + 1] AS last, p[j + 1] AS paths, list_max(list_transform([1, 2, 3], lambda y: [a[j + 1][y][1], y])) AS top FROM d WHERE j = length(word)) SELECT e.word, CAST(top[1] AS BIGINT) AS score, paths[CAST(top[2] AS INT)] AS path, round({_LSE.format('z.a[z.j + 1]')}, 6) AS log_z FROM e JOIN z ON e.word = z.word AND z.j = length(z.word)",
    "chunk_posterior": f"WITH RECURSIVE {_W}, {_COL}, {_SUMS}, e AS (SELECT word, {_LSE.format('a[j + 1]')} AS log_z FROM z WHERE j = length(word)) SELECT * FROM (SELECT e.word, unnest([0, 1, 2]) AS y, round(exp(unnest(s[1]) + unnest({_list(GT0)}) - log_z), 6) AS p FROM e JOIN col ON e.word = col.word AND col.j = length(e.word)) WHERE p > 0",
    "path_labels": f"WITH {_W}, {_R}, x AS (SELECT list_filter([CASE WHEN a <> '' THEN 0 END, 2, CASE WHEN c <> '' THEN 1 END], lambda v: v IS NOT NULL) AS y FROM r) SELECT before, y, count(*) AS n FROM (SELECT unnest(list_prepend(-1, y[1:len(y) - 1])) AS before, unnest(y) AS y FROM x) GROUP BY ALL",
    "tree_yield": f"WITH {_W}, {_R} SELECT word AS sr, word AS ur, length(word) AS n, length(word) AS m, 1 + CAST(a <> '' AS INT) + CAST(c <> '' AS INT) AS leaves FROM r",
    "grad_sum": f"WITH {_W}, f AS (SELECT word_id, substr('^' || word || '$', length(word) - k + 1, k) AS f FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= length(word) AND k < 4) SELECT ({_H.format('f')} * 2 + y) & 4194303 AS k, CAST(sum((word_id + y) % 7 - 3) AS BIGINT) AS g FROM f, (SELECT unnest([0, 1]) AS y) GROUP BY 1",
    "tree_decode": f"""WITH RECURSIVE {_W}, ge AS (SELECT word, i, j, list({_GE} ORDER BY y) AS s FROM (SELECT word, i, unnest(range(i + 1, length(word) + 1)) AS j FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)), (SELECT unnest([0, 1, 2]) AS y) GROUP BY word, i, j),
rw AS (SELECT word, j - i AS size, list(s ORDER BY i) AS s FROM ge GROUP BY word, j - i),
d AS (SELECT word, 1 AS size, [s] AS psi, [list_transform(s, lambda x: CAST(x[1] AS DOUBLE))] AS a, [list_transform(range(1, len(s) + 1), lambda i: substr(word, i, 1) || ':0')] AS p, [list_transform(s, lambda x: {_LSE.format('x')})] AS z, [list_transform(s, lambda x: CAST(x[1] AS DOUBLE))] AS z0 FROM rw WHERE size = 1 UNION ALL
SELECT word, size + 1, list_append(psi, s), list_append(a, list_transform(top, lambda x, i: s[i][1] + greatest(x[1], 0.0))),
  list_append(p, list_transform(top, lambda x, i: CASE WHEN x[1] < 0 THEN substr(word, i, size + 1) || ':0' ELSE '( ' || {_side('CAST(x[2] AS INT)', 'i', 'pl[CAST(x[3] AS INT)]')} || ' ' || {_side('CAST(size + 1 - x[2] AS INT)', 'CAST(i + x[2] AS INT)', 'pr[CAST(x[3] AS INT)]')} || ' )' END)),
  list_append(z, list_transform(zs, lambda x, i: {_LSE.format('[x, s[i][2], s[i][3]]')})), list_append(z0, zs)
FROM (SELECT *, list_transform(inner_z, lambda x, i: s[i][1] + greatest(x, 0.0) + ln(exp(-greatest(x, 0.0)) + exp(x - greatest(x, 0.0)))) AS zs, [1, 1, 2, 2, 0, 0, 1, 2, 0] AS pl, [1, 2, 1, 2, 1, 2, 0, 0, 0] AS pr
FROM (SELECT d.*, rw.s, list_transform(range(1, len(rw.s) + 1), lambda i: list_max(list_transform(range(1, d.size + 1), lambda l: list_max(list_transform(range(1, 10), lambda q: [{_part('l', 'i', '[1, 1, 2, 2, 0, 0, 1, 2, 0][q]')} + {_part('d.size + 1 - l', 'i + l', '[1, 2, 1, 2, 1, 2, 0, 0, 0][q]')}, l, q]))))) AS top,
  list_transform(range(1, len(rw.s) + 1), lambda i: {_LSE.format('list_transform(range(1, d.size + 1), lambda l: z[l][i] + z[d.size + 1 - l][i + l])')}) AS inner_z FROM d JOIN rw ON d.word = rw.word AND rw.size = d.size + 1)))
SELECT word, CAST(a[size][1] AS BIGINT) AS score, p[size][1] AS tree, round(z0[size][1], 6) AS log_z FROM d WHERE size = length(word)""",
    # the derivatives of log_z by a shift of all scores of a label, carried along with the sums from the leaves up
    "tree_nodes_expected": f"""WITH RECURSIVE {_W}, ge AS (SELECT word, i, j, list({_GE} ORDER BY y) AS s FROM (SELECT word, i, unnest(range(i + 1, length(word) + 1)) AS j FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)), (SELECT unnest([0, 1, 2]) AS y) GROUP BY word, i, j),
rw AS MATERIALIZED (SELECT word, j - i AS size, list(s ORDER BY i) AS s FROM ge GROUP BY word, j - i),
d AS (SELECT word, 1 AS size, [list_transform(s, lambda x: {_LSE.format('x')})] AS z, [list_transform(s, lambda x: list_transform(x, lambda q: exp(q - {_LSE.format('x')})))] AS dz, [1.0::DOUBLE, 0.0, 0.0] AS root FROM rw WHERE size = 1 UNION ALL
SELECT word, size + 1, list_append(z, list_transform(n, lambda q: q[1])), list_append(dz, list_transform(n, lambda q: [exp(q[2] - q[1]) * q[5], exp(q[2] - q[1]) * q[6] + exp(q[3] - q[1]), exp(q[2] - q[1]) * q[7] + exp(q[4] - q[1])])), [n[1][5], n[1][6], n[1][7]]
FROM (SELECT word, size, z, dz, list_transform(zs, lambda q, i: [{_LSE.format('[q, s[i][2], s[i][3]]')}, q, s[i][2], s[i][3], 1 + g[i] * list_sum(list_transform(range(1, size + 1), lambda l: t[i][l] * (dz[l][i][1] + dz[size + 1 - l][i + l][1]))),
  g[i] * list_sum(list_transform(range(1, size + 1), lambda l: t[i][l] * (dz[l][i][2] + dz[size + 1 - l][i + l][2]))), g[i] * list_sum(list_transform(range(1, size + 1), lambda l: t[i][l] * (dz[l][i][3] + dz[size + 1 - l][i + l][3])))]) AS n
FROM (SELECT *, list_transform(u, lambda q, i: s[i][1] + greatest(q, 0.0) + ln(exp(-greatest(q, 0.0)) + exp(q - greatest(q, 0.0)))) AS zs, list_transform(u, lambda q: 1 / (1 + exp(-q))) AS g, list_transform(ways, lambda q, i: list_transform(q, lambda e: exp(e - u[i]))) AS t
FROM (SELECT *, list_transform(ways, lambda q: {_LSE.format('q')}) AS u
FROM (SELECT d.*, rw.s, list_transform(range(1, len(rw.s) + 1), lambda i: list_transform(range(1, d.size + 1), lambda l: z[l][i] + z[d.size + 1 - l][i + l])) AS ways FROM d JOIN rw ON d.word = rw.word AND rw.size = d.size + 1)))))
SELECT word_id, y, nodes FROM (SELECT word_id, unnest([0, 1, 2]) AS y, round(unnest(root), 6) AS nodes, length(word) AS m FROM d JOIN w USING (word) WHERE size = length(word)) WHERE m > 1 OR y = 0""",
    "chunk_count": f"WITH {_W} SELECT word, round(log10(3.0) + (length(word) - 1) * log10(4.0), 6) AS log_paths FROM w",
    "align_best": f"WITH {_W}, {_R} SELECT word, b AS stem, -levenshtein(word, b) AS best FROM r",
    "transduce_best": f"WITH {_W}, l AS (SELECT unnest(list_prepend('', string_split('abcdefghijklmnopqrstuvwxyz', ''))) AS c), b AS (SELECT x, max(s) AS s, arg_max(y, s * 1000 + ascii(y)) AS y FROM (SELECT p.c AS x, q.c AS y, {_H.format("p.c || '>' || q.c")} % 11 - 5 AS s FROM l p, l q WHERE p.c <> '') GROUP BY x), u AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w) SELECT word, string_agg(y, '' ORDER BY i) AS ur, CAST(sum(s) AS BIGINT) AS score FROM u JOIN b ON b.x = substr(word, i, 1) GROUP BY word",
    "transduce_logz": f"WITH RECURSIVE {_W}, {_outputs(1 << 20)} SELECT word, round(lg + ln(list_sum(f)), 6) AS log_z FROM o WHERE i = length(word)",
    "transduce_band": f"WITH RECURSIVE {_W}, {_outputs(3)} SELECT word, round(lg + ln(list_sum(f)), 6) AS log_z FROM o WHERE i = length(word)",
    "transduce_clamped": f"""WITH RECURSIVE {_W}, {_R}, {_outputs(1 << 20)}, z AS (SELECT word, lg + ln(list_sum(f)) AS log_z FROM o WHERE i = length(word)),
row AS (SELECT word_id, r.word, b, i, list(exp(pr.s) ORDER BY k) AS sub, any_value(wt.del) AS del FROM (SELECT word_id, word, b, i, unnest(range(1, length(b) + 1)) AS k FROM (SELECT word_id, word, b, unnest(range(1, length(word) + 1)) AS i FROM r)) r JOIN pr ON pr.x = substr(r.word, CAST(i AS INT), 1) AND pr.y = substr(b, CAST(k AS INT), 1) JOIN wt ON wt.x = pr.x GROUP BY word_id, r.word, b, i),
c AS (SELECT word_id, word, b, 0 AS i, 0.0::DOUBLE AS lg, list_transform(range(0, length(b) + 1), lambda k: pow(exp(-6.0), k)) AS f FROM r UNION ALL
SELECT word_id, word, b, i + 1, lg + ln(list_max(n)), list_transform(n, lambda q: q / list_max(n)) FROM (SELECT word_id, word, b, i, lg, list_transform(range(0, len(g)), lambda k: list_sum(list_transform(range(0, k + 1), lambda u: g[u + 1] * pow(exp(-6.0), k - u)))) AS n
FROM (SELECT c.*, list_transform(f, lambda q, k: q * del + CASE WHEN k > 1 THEN f[k - 1] * sub[k - 1] ELSE 0.0 END) AS g FROM c JOIN row ON row.word_id = c.word_id AND row.i = c.i + 1)))
SELECT word_id, b AS stem, round(lg + ln(f[len(f)]), 6) AS clamped, round(lg + ln(f[len(f)]) - log_z, 6) AS ll FROM c JOIN z USING (word) WHERE i = length(word)""",
    "rerank_best": f"WITH {_W}, {_R}, {_CAND} SELECT word, pos, ur, score FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, pos DESC) = 1",
    "softmax_weights": f"WITH {_W}, {_R}, {_CAND} SELECT word, pos, round(exp(score) / sum(exp(score)) OVER (PARTITION BY word), 6) AS weight FROM c",
    "seg_metrics": f"WITH {_W}, {_R}, {_M}, v AS (SELECT lang, word, truth AS t, guess AS g FROM m) SELECT lang, count(*) AS words, round(avg(CAST(array_to_string(g, '') = word AS INT)), 6) AS ur_acc, round(avg(CAST(g = t AS INT)), 6) AS seg_acc, round(avg({_F1}), 6) AS f1, round(avg(levenshtein(array_to_string(g, '#'), array_to_string(t, '#'))), 6) AS edit FROM v GROUP BY lang",
    "span_f1": f"WITH {_W}, {_R}, {_M}, v AS (SELECT lang, list_transform(range(1, len(truth) + 1), lambda k: length(array_to_string(truth[1:k - 1], '')) * 1000 + length(array_to_string(truth[1:k], ''))) AS t, list_transform(range(1, len(guess) + 1), lambda k: length(array_to_string(guess[1:k - 1], '')) * 1000 + length(array_to_string(guess[1:k], ''))) AS g FROM m) SELECT lang, count(*) AS words, round(avg({_F1}), 6) AS span_f1 FROM v GROUP BY lang",
    "adagrad_l2_step": f"WITH {_W}, {_ST}, a AS (SELECT k, g, CASE WHEN g IS NULL THEN w ELSE w * pow(sqrt(q) / (0.5 * 0.25 + sqrt(q)), greatest(5 - u, 0)) END AS w, q + coalesce(g * g, 0) AS q, u FROM j) SELECT k, round(CASE WHEN g IS NULL THEN w ELSE (w * sqrt(q) - 0.5 * g) / (0.5 * 0.25 + sqrt(q)) END, 6) + 0.0 AS w, round(CAST(q AS DOUBLE), 6) AS q, CAST(CASE WHEN g IS NULL THEN u ELSE 6 END AS INTEGER) AS u FROM a",
    "adagrad_l1_step": f"WITH {_W}, {_ST}, a AS (SELECT k, g, CASE WHEN g IS NULL THEN w ELSE (CASE WHEN w >= 0 THEN 1 ELSE -1 END) * greatest(0.0, abs(w) - 0.5 * 0.25 * greatest(5 - u, 0) / sqrt(q)) END AS w, q + coalesce(g * g, 0) AS q, u FROM j), z AS (SELECT *, w - 0.5 * g / sqrt(q) AS z FROM a) SELECT k, round(CASE WHEN g IS NULL THEN w ELSE (CASE WHEN z >= 0 THEN 1 ELSE -1 END) * greatest(0.0, abs(z) - 0.5 * 0.25 / sqrt(q)) END, 6) + 0.0 AS w, round(CAST(q AS DOUBLE), 6) AS q, CAST(CASE WHEN g IS NULL THEN u ELSE 6 END AS INTEGER) AS u FROM z",
    "adagrad_catchup": f"WITH {_W}, {_ST} SELECT k, round(w * pow(sqrt(q) / (0.5 * 0.25 + sqrt(q)), greatest(5 - u, 0)), 6) + 0.0 AS w, round(CAST(q AS DOUBLE), 6) AS q, CAST(greatest(u, 5) AS INTEGER) AS u FROM s",
    "potentials_join": f"WITH {_W}, f AS (SELECT word, substr('^' || word || '$', length(word) - k + 1, k) AS f FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= length(word)), keys AS (SELECT DISTINCT ({_H.format('f')} * 2) & 4194303 AS k FROM f), x AS (SELECT word, y, ({_H.format('f')} * 2 + y) & 4194303 AS k FROM f, (SELECT unnest([0, 1]) AS y)) SELECT word, y, CAST(sum(coalesce(keys.k % 9 - 4, -1)) AS BIGINT) AS score FROM x LEFT JOIN keys ON x.k = keys.k GROUP BY word, y",
    "sparse_dot": f"WITH {_W} SELECT word, CAST(list_sum(list_transform(string_split(word, ''), lambda c: CASE WHEN ascii(c) % 2 = 1 THEN ascii(c) - 97 ELSE 0 END)) AS BIGINT) AS dot FROM w",
    "scatter_add": f"WITH {_W} SELECT ascii(c) * 3 + 5 AS k, count(*) * 2 AS v FROM (SELECT unnest(string_split(word, '')) AS c FROM w) GROUP BY 1",
    "coverage": f"WITH {_W}, {_R}, {_CAND}, p AS (SELECT r.word, max(CAST(pos = 0 AND ur = b AS INT)) AS best, max(CAST(ur = b AS INT)) AS s FROM c JOIN r ON c.word = r.word GROUP BY r.word) SELECT count(*) AS words, CAST(sum(best) AS BIGINT) AS best_right, CAST(sum(s) AS BIGINT) AS in_sample, CAST(sum(CAST(s = 1 AND best = 0 AS INT)) AS BIGINT) AS rescued FROM p",
}


#: Columns that are long in both.
LONG = {
    "parse_leaves": "pos i j chunk", "tree_nodes": "node_id parent_id i j label", "alphabet": "id", "substring_ids": "id n", "feature_counts": "slot n", "align_best": "best", "transduce_best": "score", "chunk_posterior": "y", "path_labels": "before y n", "tree_nodes_expected": "y", "tree_yield": "n m leaves", "grad_sum": "k g",
    "rerank_best": "pos score", "softmax_weights": "pos", "adagrad_l2_step": "u", "adagrad_l1_step": "u", "adagrad_catchup": "u", "potentials_join": "y score", "scatter_add": "k v",
}


def _long(name: str, query):
    def run(spark, sf_dir):
        out = query(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("long") for c in LONG[name].split()})

    return run if name in LONG else query


def queries() -> dict:
    own = {name.removeprefix("q_"): f for name, f in globals().items() if name.startswith("q_")}
    own |= {"adagrad_l2_step": _adagrad(2), "adagrad_l1_step": _adagrad(1)}
    return {name: _long(name, f) for name, f in own.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in LONG[k].split())}) FROM ({v})" if k in LONG else v for k, v in SQL.items()}
