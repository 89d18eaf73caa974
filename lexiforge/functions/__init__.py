"""Column functions of the morphology operators. Each is a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature keys fall into this many slots.
SLOTS = 1 << 22
#: Labels of chunks, and of tree nodes (where stems and inner nodes share 0). Fixed values.
CHUNK_LABELS = {"prefix": 0, "suffix": 1, "stem": 2}
TREE_LABELS = {"stem": 0, "prefix": 1, "suffix": 2}


def log_add(x: Column, y: Column) -> Column:
    """log(exp(x) + exp(y)); of two negative infinities it is one of them."""
    high, low = F.greatest(x, y), F.least(x, y)
    return F.when(low == F.lit(float("-inf")), high).otherwise(high + F.log1p(F.exp(low - high)))


def sign(x: Column) -> Column:
    """1 for x >= 0, else -1 (unlike signum, 0 gives 1)."""
    return F.when(x >= 0, 1).otherwise(-1)


def hash_key(text: Column) -> Column:
    """Key of a feature: 28 bits of its MD5, the same on every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def slot(key: Column, labels: int, label: Column, offset: int = 0) -> Column:
    """Place of (key, label) among the weights: a long, so nothing wraps around."""
    return (key * labels + label).bitwiseAND(F.lit(SLOTS - 1)) + offset


def framed(word: Column) -> Column:
    return F.concat(F.lit("^"), word, F.lit("$"))


def prefix_contexts(word: Column, i: Column, width: int) -> Column:
    """The 1 .. width - 1 framed characters before character i of word, as far as they go."""
    text = framed(word)
    return F.when(i > 0, F.transform(F.sequence(F.lit(1), F.least(F.lit(width - 1), i)), lambda k: F.substring(text, i - k + 1, k))).otherwise(F.array().cast("array<string>"))


def suffix_contexts(word: Column, j: Column, width: int, repeat: bool = True) -> Column:
    """The 1 .. width framed characters from character j on. With repeat, widths past the frame give the whole rest again."""
    text, rest = framed(word), F.length(word) + 2 - j
    most = F.lit(width) if repeat else F.least(F.lit(width), rest)
    return F.transform(F.sequence(F.lit(1), most), lambda k: F.substring(text, j + 1, F.least(k, rest)))


def spans(word: Column, longest: int = 1 << 20) -> Column:
    """array<struct<i, j>> of all 0 <= i < j <= length with j - i <= longest."""
    n = F.length(word)
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, F.least(n, i + longest)), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.when(n > 0, F.flatten(rows).cast("array<struct<i:int,j:int>>")).otherwise(F.array().cast("array<struct<i:int,j:int>>"))


def set_prf(guess: Column, truth: Column) -> Column:
    """struct<p, r, f1> over the distinct elements of two arrays; 0 where nothing is shared."""
    g, t = F.array_distinct(guess), F.array_distinct(truth)
    both = F.size(F.array_intersect(g, t))
    p = F.when(F.size(g) > 0, both / F.size(g)).otherwise(0.0)
    r = F.when(F.size(t) > 0, both / F.size(t)).otherwise(0.0)
    return F.struct(p.alias("p"), r.alias("r"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def edit_distance(guess: Column, truth: Column, sep: str = "#") -> Column:
    """Levenshtein distance of two joined arrays."""
    return F.levenshtein(F.array_join(guess, sep), F.array_join(truth, sep))


def strip_brackets(tree: Column) -> Column:
    """Words of a printed tree such as ( a:1 ( b:0 c:2 ) )."""
    return F.regexp_extract_all(tree, F.lit(r"([^() :]+):[0-9]+"), F.lit(1))


def sparse_dot(keys: Column, weights: Column, offset: int = 0, scale: int = 1) -> Column:
    """Sum of weights (a map) at keys * scale + offset; repeated keys count repeatedly, absent ones are 0."""
    return F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.coalesce(F.element_at(weights, k * scale + offset), F.lit(0.0)))

