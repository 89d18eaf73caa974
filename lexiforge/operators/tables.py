"""Dictionary tables: lookups, alignments, contexts and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge import functions as L


def substrings(words: DataFrame, symbols: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """word_id, i, j, id of every substring of word; -1 where the dictionary (symbol, id) doesn't have it."""
    places = words.select("word_id", "word", F.explode(L.spans(F.col("word"), longest)).alias("s"))
    places = places.select("word_id", "s.i", "s.j", F.substring("word", F.col("s.i") + 1, F.col("s.j") - F.col("s.i")).alias("symbol"))
    return places.join(symbols, "symbol", "left").select("word_id", "i", "j", F.coalesce("id", F.lit(-1)).alias("id"))


def frozen(found: DataFrame) -> DataFrame:
    """The rows of substrings(), if all are known; else the query fails."""
    return found.withColumn("id", F.when(F.col("id") >= 0, F.col("id")).otherwise(F.raise_error(F.lit("symbol is not in the frozen alphabet")).cast("int")))


def alignments(symbols: DataFrame) -> DataFrame:
    """x, y, align_id (from 2), is_copy of all pairs of symbols but (empty, empty). Both sides are one alphabet, so bounded by it."""
    x, y = (symbols.select(F.col("symbol").alias(c), F.col("id").alias(f"{c}_id")) for c in "xy")
    n = symbols.count()
    return x.join(y, F.lit(True)).where("x <> '' OR y <> ''").select("x", "y", (F.col("x_id") * n + F.col("y_id") + 1).cast("long").alias("align_id"), (F.col("x") == F.col("y")).alias("is_copy"))


def next_contexts(contexts: DataFrame, symbols: DataFrame) -> DataFrame:
    """p, y, next_p: the longest suffix of p + y that is a context. Contexts and symbols are small tables of an alphabet."""
    text = contexts.select(F.col("symbol").alias("p")).join(symbols.select(F.col("symbol").alias("y")), F.lit(True)).withColumn("t", F.concat("p", "y"))
    suffix = text.select("p", "y", F.explode(F.transform(F.sequence(F.lit(0), F.length("t")), lambda k: F.substring("t", k + 1, F.length("t")))).alias("next_p"))
    known = suffix.join(contexts.select(F.col("symbol").alias("next_p")), "next_p", "left_semi")
    return known.groupBy("p", "y").agg(F.max_by("next_p", F.length("next_p")).alias("next_p"))


def chunk_features(words: DataFrame, lexicon: DataFrame | None = None, width: int = 5, longest: int = 1 << 20) -> DataFrame:
    """word_id, i, j, feature of every span: the segment, left and right contexts (tagged, as often as they occur), and a
    flag for segments of over 3 characters that the lexicon (word) has."""
    n = F.length("word")
    at = words.where(n > 0).select("word_id", "word", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("*", F.explode(F.sequence(F.col("i") + 1, F.least(n, F.col("i") + longest))).alias("j"))
    at = at.withColumn("segment", F.substring("word", F.col("i") + 1, F.col("j") - F.col("i")))
    place, k, text = ("word_id", "i", "j"), F.col("k"), L.framed(F.col("word"))
    # plain generators and substrings, so that all of it is compiled
    left = at.where("i > 0").select(*place, "word", F.explode(F.sequence(F.lit(1), F.least(F.lit(width - 1), F.col("i")))).alias("k"))
    right = at.select(*place, "word", F.explode(F.sequence(F.lit(1), F.lit(width))).alias("k"))
    out = at.select(*place, F.concat(F.lit("seg:"), "segment").alias("feature"))
    if width > 1:
        out = out.union(left.select(*place, F.concat(F.lit("left:"), F.substring(text, F.col("i") - k + 1, k))))
    out = out.union(right.select(*place, F.concat(F.lit("right:"), F.substring(text, F.col("j") + 1, F.least(k, n + 2 - F.col("j"))))))
    if lexicon is not None:
        known = at.where(F.length("segment") > 3).join(lexicon.select(F.col("word").alias("segment")), "segment", "left_semi")
        out = out.union(known.select("word_id", "i", "j", F.lit("lexicon")))
    return out


def tree_features(words: DataFrame, lexicon: DataFrame | None = None, width: int = 5) -> DataFrame:
    """As chunk_features, but right contexts don't repeat at the end of the word."""
    at = words.select("word_id", "word", F.explode(L.spans(F.col("word"))).alias("s")).select("word_id", "word", "s.i", "s.j")
    right = F.transform(L.suffix_contexts(F.col("word"), F.col("j"), width, repeat=False), lambda t: F.concat(F.lit("right:"), t))
    rest = chunk_features(words, lexicon, width).where(~F.col("feature").startswith("right:"))
    return rest.union(at.select("word_id", "i", "j", F.explode(right)))


def transducer_features(words: DataFrame, width: int = 6, marks: tuple[str, ...] = ()) -> DataFrame:
    """word_id, i, x, feature: for every place i and both the empty segment and the character there, the segment, its
    contexts and which of the marks the word contains."""
    n = F.length("word")
    at = words.select("word_id", "word", F.explode(F.sequence(F.lit(0), n)).alias("i")).select("*", F.explode(F.array_distinct(F.array(F.lit(""), F.substring("word", F.col("i") + 1, 1)))).alias("x"))
    j = F.col("i") + F.length("x")
    some = F.concat(
        F.array(F.concat(F.lit("x:"), "x")),
        F.transform(L.prefix_contexts(F.col("word"), F.col("i"), width), lambda t: F.concat(F.lit("left:"), t)),
        F.transform(L.suffix_contexts(F.col("word"), j, width), lambda t: F.concat(F.lit("right:"), t)),
        F.filter(F.array(*(F.when(F.contains("word", F.lit(m)), F.lit(f"has:{m}")) for m in marks)) if marks else F.array().cast("array<string>"), lambda t: t.isNotNull()),
    )
    return at.select("word_id", "i", "x", F.explode(some).alias("feature"))


def context_features(contexts: DataFrame) -> DataFrame:
    """symbol, feature: the suffixes of each context."""
    return contexts.select("symbol", F.explode(F.transform(F.sequence(F.lit(0), F.length("symbol")), lambda k: F.substring("symbol", k + 1, F.length("symbol")))).alias("feature"))


def arc_features(symbols: DataFrame, contexts: DataFrame) -> DataFrame:
    """x, out, p, feature of every arc x:out after context p, whatever the word: the pair, whether it copies, the suffixes of
    the context, and these with the pair and with copies. symbols: symbol, id; contexts: symbol. All are small tables."""
    pairs = alignments(symbols).select("x", F.col("y").alias("out"), F.concat_ws(">", "x", "y").alias("pair"), "is_copy")
    after = context_features(contexts).select(F.col("symbol").alias("p"), F.col("feature").alias("s"))
    own = contexts.select(F.col("symbol").alias("p"))
    plain = pairs.join(own, F.lit(True)).select("x", "out", "p", F.explode(F.array(F.concat(F.lit("pair:"), "pair"), F.when(F.col("is_copy"), "copy").otherwise("change"))).alias("feature"))
    each = F.array(F.concat(F.lit("after:"), "s"), F.concat(F.lit("after:"), "s", F.lit("|"), "pair"), F.when(F.col("is_copy"), F.concat(F.lit("after:"), "s", F.lit("|copy"))))
    return plain.union(pairs.join(after, F.lit(True)).select("x", "out", "p", F.explode(F.filter(each, lambda t: t.isNotNull())).alias("feature")))


def tagged(features: DataFrame, tag: str) -> DataFrame:
    """The same features under names of their own, for weights of another kind."""
    return features.withColumn("feature", F.concat(F.lit(tag), "feature"))


def potentials(features: DataFrame, weights: DataFrame, labels: int, default: float = -0.1, by: tuple[str, ...] = ("word_id", "i", "j")) -> DataFrame:
    """by, y, score: the sum of the weights (k, w) of a place's features for each label; unknown weights count default.

    Equal features of a place are summed before the join with the weights.
    """
    counted = features.groupBy(*by, "feature").agg(F.count("*").alias("n"))
    keyed = counted.select(*by, "n", L.hash_key(F.col("feature")).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(labels - 1))).alias("y"))
    keyed = keyed.withColumn("k", L.slot(F.col("key"), labels, F.col("y")))
    return keyed.join(weights.select("k", "w"), "k", "left").groupBy(*by, "y").agg(F.sum(F.col("n") * F.coalesce("w", F.lit(default))).alias("score"))


def gradient_by_feature(features: DataFrame, gradient: DataFrame, labels: int, by: tuple[str, ...] = ("word_id", "i", "j")) -> DataFrame:
    """k, g: the gradient (by, y, g) of places summed over the features that fire there."""
    counted = features.groupBy(*by, "feature").agg(F.count("*").alias("n"))
    fired = counted.join(gradient, list(by)).withColumn("k", L.slot(L.hash_key(F.col("feature")), labels, F.col("y")))
    return fired.groupBy("k").agg(F.sum(F.col("n") * F.col("g")).alias("g"))


def scatter(keys: DataFrame, coefficient: float, offset: int = 0, scale: int = 1) -> DataFrame:
    """k, v: coefficient for each occurrence of a key (column keys, an array) after the affine map."""
    return keys.select(F.explode("keys").alias("k")).groupBy((F.col("k") * scale + offset).alias("k")).agg((F.count("*") * coefficient).alias("v"))


def last_first(df: DataFrame, by: str, score: str, order: str) -> DataFrame:
    """The row of the best score of each group; of equal ones that of the largest order."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(order).desc())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
