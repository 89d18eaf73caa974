"""Decoding, partition functions, posteriors, sampling and reranking of words by the three models, in Arrow batches.

Chunk and tree scores come as rows (word_id, i, j, y, score) from features.potentials; they are packed by word, which is
bounded by the square of its length. Transducer scores come from a TransducerScorer, a small table of arc weights that is
sent with the function; its size is that of alphabet times alphabet times contexts, and is checked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge import functions as L
from lexiforge.operators import dp
from lexiforge.shipping import ship

#: Arc weights that may be sent with a function.
MOST_WEIGHTS = 1 << 20


# -- chunks as column expressions -------------------------------------------------------------------------------------


def chunk_table(word: Column, labels: int, score: Callable[[Column, Column], Column]) -> Column:
    """Scores [i][j - i - 1][y] of all segments of a word from score(segment, label)."""
    n = F.length(word)
    row = lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.transform(F.sequence(F.lit(0), F.lit(labels - 1)), lambda y: score(F.substring(word, i + 1, j - i), y)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row))


def chunk_fold(word: Column, table: Column, gt0: list[float], gt: list[list[float]], semiring: str) -> Column:
    """Sum over all labelled segmentations of a word (null for an empty one): semiring max (best score), log (log partition
    function) or count (their number). The chart is an array carried through the positions."""
    labels = len(gt0)
    zero = F.lit(0.0 if semiring == "count" else float("-inf"))
    plus = {"max": lambda a, b: F.greatest(a, b), "log": L.log_add, "count": lambda a, b: a + b}[semiring]
    times = (lambda *x: x[0]) if semiring == "count" else (lambda *x: sum(x[1:], x[0]))
    first, between = F.array(*(F.lit(float(x)) for x in gt0)), F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in gt))
    ys = F.sequence(F.lit(0), F.lit(labels - 1))
    at = lambda i, j, y: F.get(F.get(F.get(table, i), j - i - 1), y)

    def cell(chart: Column, j: Column, y: Column) -> Column:
        start = F.lit(1.0) if semiring == "count" else times(F.get(first, y), at(F.lit(0), j, y))
        inner = lambda s, i: F.aggregate(ys, s, lambda s2, b: plus(s2, times(F.get(F.get(chart, i), b), F.get(F.get(between, b), y), at(i, j, y))))
        return F.when(j == 1, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(j - 1, F.lit(1))), start, inner))

    seed = F.array(F.array(*([zero] * labels)))
    chart = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), seed, lambda c, j: F.concat(c, F.array(F.transform(ys, lambda y: cell(c, j, y)))))
    return F.when(F.length(word) > 0, F.aggregate(F.get(chart, F.length(word)), zero, plus))


# -- models in Arrow batches --------------------------------------------------------------------------------------------

#: Words of one length that are taken together.
TOGETHER = 256


def packed(words: DataFrame, potentials: DataFrame) -> DataFrame:
    """word_id, word and its scores as parallel arrays."""
    rows = potentials.groupBy("word_id").agg(*(F.collect_list(c).alias(c) for c in ("i", "j", "y", "score")))
    return words.select("word_id", "word").join(rows, "word_id")


def packed_table(words: DataFrame, labels: int, score: Callable[[Column, Column], Column]) -> DataFrame:
    """word_id, word and the scores of all its segments by an expression score(segment, label), without a shuffle."""
    return words.select("word_id", "word", F.flatten(F.flatten(chunk_table(F.col("word"), labels, score))).alias("scores"))


def _dense(rows: pd.DataFrame, labels: int) -> np.ndarray:
    """Scores [word, i, j, label] of words of one length."""
    n = len(rows["word"].iloc[0])
    out = np.full((len(rows), n + 1, n + 1, labels), dp.NEG)
    if "scores" in rows:
        i, j = np.triu_indices(n + 1, 1)
        out[:, i, j] = np.stack([np.asarray(x, float) for x in rows["scores"]]).reshape(len(rows), len(i), labels)
    else:
        word = np.repeat(np.arange(len(rows)), [len(x) for x in rows["i"]])
        out[(word, *(np.concatenate([np.asarray(x) for x in rows[c]]) for c in ("i", "j", "y")))] = np.concatenate([np.asarray(x) for x in rows["score"]])
    return out


def _spread(df: DataFrame) -> DataFrame:
    """df over all cores: a few MB of words are hours of work, which Spark would put into one task by their size."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def _mapped(df: DataFrame, schema: str, each: Callable[[pd.DataFrame], Iterator[tuple]], by: tuple[str, ...] = ("word",), spread: bool = True) -> DataFrame:
    """Rows that each(rows) yields for rows of df whose strings by have the same lengths."""
    names = [x.strip().split(" ")[0] for x in _fields(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby([pdf[c].str.len() for c in by], sort=True):
                for at in range(0, len(own), TOGETHER):
                    yield pd.DataFrame(list(each(own.iloc[at : at + TOGETHER])), columns=names)

    ship(df.sparkSession)
    return (_spread(df) if spread and not df.isStreaming else df).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


SPANS = "array<struct<i:int,j:int>>"


def _chunks(rows: pd.DataFrame, gt0, gt) -> dp.ChunkBatch:
    return dp.ChunkBatch(_dense(rows, len(gt0)).transpose(0, 3, 1, 2), np.array(gt0), np.array(gt))


def decode_chunks(scored: DataFrame, gt0: list[float], gt: list[list[float]]) -> DataFrame:
    """word_id, word, score, spans, labels, segments, log_z."""

    def each(rows):
        model = _chunks(rows, gt0, gt)
        for key, word, (score, spans, labels), z in zip(rows["word_id"], rows["word"], model.decode(), model.log_z(), strict=True):
            yield key, word, score, [{"i": i, "j": j} for i, j in spans], labels, [word[i:j] for i, j in spans], z

    return _mapped(scored, f"word_id long, word string, score double, spans {SPANS}, labels array<int>, segments array<string>, log_z double", each)


def _cells(rows: pd.DataFrame, p: np.ndarray) -> Iterator[tuple]:
    """word_id, i, j, y, p of the positive cells of p[word, i, j, y]."""
    at = np.nonzero(p > 0)
    ids = rows["word_id"].to_numpy()
    yield from zip(ids[at[0]].tolist(), *(x.tolist() for x in at[1:]), p[at].tolist(), strict=True)


def chunk_posteriors(scored: DataFrame, gt0: list[float], gt: list[list[float]]) -> DataFrame:
    """word_id, i, j, y, p: probability of each labelled segment."""
    return _mapped(scored, "word_id long, i int, j int, y int, p double", lambda rows: _cells(rows, _chunks(rows, gt0, gt).posteriors().sum(axis=1).transpose(0, 2, 3, 1)))


def chunk_transitions(scored: DataFrame, gt0: list[float], gt: list[list[float]]) -> DataFrame:
    """before (-1 at the start), y, p: expected number of transitions, summed over words."""

    def each(rows):
        p = _chunks(rows, gt0, gt).posteriors()
        for y, v in enumerate(p[:, 0, :, 0].sum(axis=(0, 2))):
            yield -1, y, float(v)
        for (b, y), v in np.ndenumerate(p[:, :, :, 1:].sum(axis=(0, 3, 4))):
            yield b, y, float(v)

    return _mapped(scored, "before int, y int, p double", each).groupBy("before", "y").agg(F.sum("p").alias("p"))


def chunk_transitions_by_word(scored: DataFrame, gt0: list[float], gt: list[list[float]]) -> DataFrame:
    """word_id, before (-1 at the start), y, p: expected number of transitions of each word."""

    def each(rows):
        p = _chunks(rows, gt0, gt).posteriors()
        start, inner = p[:, 0, :, 0].sum(axis=2), p[:, :, :, 1:].sum(axis=(3, 4))
        for key, one, more in zip(rows["word_id"], start, inner, strict=True):
            yield from ((key, -1, y, float(v)) for y, v in enumerate(one))
            yield from ((key, b, y, float(v)) for (b, y), v in np.ndenumerate(more))

    return _mapped(scored, "word_id long, before int, y int, p double", each)


def decode_trees(scored: DataFrame, labels: int = 3) -> DataFrame:
    """word_id, word, score, tree (printed), spans (preorder), labels, log_z."""

    def each(rows):
        model = dp.TreeBatch(_dense(rows, labels))
        for key, word, (score, nodes), z in zip(rows["word_id"], rows["word"], model.decode(), model.log_z(), strict=True):
            yield key, word, score, dp.printed(word, nodes), [{"i": i, "j": j} for i, j, _, _ in nodes], [g for _, _, g, _ in nodes], z

    return _mapped(scored, f"word_id long, word string, score double, tree string, spans {SPANS}, labels array<int>, log_z double", each)


def tree_posteriors(scored: DataFrame, labels: int = 3) -> DataFrame:
    """word_id, i, j, y, p: probability that the tree has the node."""
    return _mapped(scored, "word_id long, i int, j int, y int, p double", lambda rows: _cells(rows, dp.TreeBatch(_dense(rows, labels)).marginals()))


@dataclass
class TransducerScorer:
    """Arc scores from weights: of (x, y) pairs, of (x, y) after a context, and for copying or not."""

    symbols: list[str]
    contexts: list[str]
    copy: float = 10.0
    change: float = -10.0
    pairs: dict[tuple[str, str], float] = field(default_factory=dict)
    after: dict[tuple[str, str, str], float] = field(default_factory=dict)
    extra: int = 6
    band: int | None = None
    max_y: int | None = None

    def __post_init__(self):
        if len(self.pairs) + len(self.after) > MOST_WEIGHTS:
            raise ValueError(f"more than {MOST_WEIGHTS} weights: score arcs by a join with features instead")
        self.automaton = dp.Automaton(self.symbols, self.contexts)
        self._known: dict[str, np.ndarray] = {}

    def __call__(self, i: int, x: str) -> np.ndarray | None:
        if x not in self.symbols:
            return None
        if x not in self._known:
            base = np.array([(self.copy if x == y else self.change) + self.pairs.get((x, y), 0.0) for y in self.symbols])
            out = np.repeat(base[:, None], len(self.contexts), axis=1)
            for (a, y, p), w in self.after.items():
                if a == x:
                    out[self.symbols.index(y), self.contexts.index(p)] += w
            self._known[x] = out
        return self._known[x]

    def on(self, word: str) -> dp.Transducer:
        return dp.Transducer(self.automaton, word, self, self.extra, band=self.band, max_y=self.max_y)

    def attach(self, rows: DataFrame) -> DataFrame:
        """rows (word_id, word, ...) with what workers need to score them."""
        return rows

    @property
    def shipped(self) -> TransducerScorer:
        """What workers hold: its batch(rows) gives the transducers of words of one length."""
        return self

    def batch(self, rows: pd.DataFrame) -> dp.TransducerBatch:
        return self.together(rows["word"].tolist())

    def together(self, words: list[str]) -> dp.TransducerBatch:
        """Words of one length."""
        tables = np.stack([np.full((len(self.symbols), len(self.contexts)), dp.NEG)] + [self(0, x) for x in self.symbols])
        place = {x: k + 1 for k, x in enumerate(self.symbols)}
        code = np.array([[place.get(c, 0) for c in w] for w in words]).reshape(len(words), -1)
        n = len(words[0])
        moves = [[(i, tables[1][None])] + ([(i + 1, tables[code[:, i]])] if i < n else []) for i in range(n + 1)]
        return dp.TransducerBatch(self.automaton, n, moves, self.extra, self.band, self.max_y)


def seeded(seed: int, word: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}\t{word}".encode()).digest()[:8], "big"))


def transduce(words: DataFrame, scorer: TransducerScorer | FeatureScorer) -> DataFrame:
    """word_id, word, score, ur, log_z: the best output and the log partition function."""
    model = scorer.shipped

    def each(rows):
        t = model.batch(rows)
        for key, word, (score, ur, _), z in zip(rows["word_id"], rows["word"], t.decode(), t.log_z(), strict=True):
            yield key, word, score, ur, z

    return _mapped(scorer.attach(words.select("word_id", "word")), "word_id long, word string, score double, ur string, log_z double", each)


def clamped(pairs: DataFrame, scorer: TransducerScorer | FeatureScorer) -> DataFrame:
    """word_id, ur, clamped, ll, in_support of pairs (word_id, word, ur); outputs beyond the length limit are out of support, and
    their ll is negative infinity."""
    model = scorer.shipped

    def each(rows):
        urs = rows["ur"].tolist()
        t = model.batch(rows)
        score, inside = t.clamped(urs)[:, 0, 0], len(urs[0]) <= t.most
        ll = score - t.log_z() if inside else np.full(len(urs), dp.NEG)
        yield from zip(rows["word_id"], urs, score, ll, [inside] * len(urs), strict=True)

    return _mapped(scorer.attach(pairs.select("word_id", "word", "ur")), "word_id long, ur string, clamped double, ll double, in_support boolean", each, ("word", "ur"))


def best_alignments(pairs: DataFrame, scorer: TransducerScorer) -> DataFrame:
    """word, ur, score of the best alignment of pairs (word, ur)."""

    def each(rows):
        urs = rows["ur"].tolist()
        yield from zip(rows["word"], urs, scorer.together(rows["word"].tolist()).clamped(urs, dp.best)[:, 0, 0], strict=True)

    return _mapped(pairs.select("word", "ur"), "word string, ur string, score double", each, ("word", "ur"))


def candidates(words: DataFrame, scorer: TransducerScorer | FeatureScorer, mode: str, num: int = 1000, seed: int = 1) -> DataFrame:
    """word_id, word, pos, ur, source, n of candidate outputs. mode: baseline (the word), oracle (ur_gold), viterbi (the best),
    sample (the best and the distinct samples, so the best may appear twice)."""
    if mode not in ("baseline", "oracle", "viterbi", "sample"):
        raise ValueError(f"unknown mode {mode}")
    if mode in ("baseline", "oracle"):
        return words.select("word_id", "word", F.lit(0).alias("pos"), F.col("word" if mode == "baseline" else "ur_gold").alias("ur"), F.lit(mode).alias("source"), F.lit(1).cast("long").alias("n"))

    model = scorer.shipped

    def each(rows):
        own = rows["word"].tolist()
        t = model.batch(rows)
        drawn = t.sample(num, [seeded(seed, w) for w in own]) if mode == "sample" else [{}] * len(own)
        for key, word, (_, ur, _), counts in zip(rows["word_id"], own, t.decode(), drawn, strict=True):
            yield key, word, 0, ur, "best", 1
            for k, (out, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
                yield key, word, k + 1, out, "sample", n

    return _mapped(scorer.attach(words.select("word_id", "word")), "word_id long, word string, pos int, ur string, source string, n long", each)


def rerank(cands: DataFrame, transducer: DataFrame, segmenter: DataFrame) -> DataFrame:
    """The candidate of each word with the largest ll (word_id, ur, ll) + log_z (word_id, ur, log_z); of equal ones the last."""
    own = cands.join(transducer.select("word_id", "ur", "ll").distinct(), ["word_id", "ur"]).join(segmenter.select("word_id", "ur", "log_z").distinct(), ["word_id", "ur"])
    own = own.withColumn("total", F.col("ll") + F.col("log_z"))
    return own.groupBy("word_id").agg(F.max_by(F.struct("word", "ur", "total", "pos"), F.struct("total", "pos")).alias("b")).select("word_id", "b.*")


def softmax(scores: DataFrame, by: str = "word_id", score: str = "score") -> DataFrame:
    """scores with weight: exp(score - log of the sum of exponentials of its group), by two combined aggregates and a join."""
    top = scores.groupBy(by).agg(F.max(score).alias("_top"))
    total = scores.join(top, by).groupBy(by).agg(F.first("_top").alias("_top"), F.sum(F.exp(F.col(score) - F.col("_top"))).alias("_sum"))
    return scores.join(total, by).withColumn("weight", F.exp(F.col(score) - F.col("_top")) / F.col("_sum")).drop("_top", "_sum")


def packed_arcs(words: DataFrame, potentials: DataFrame) -> DataFrame:
    """word_id, word and transducer scores (word_id, i, x, y: place among the symbols, score) as parallel arrays. With a column
    p, a score holds after that context only, unless p is -1."""
    own = potentials if "p" in potentials.columns else potentials.withColumn("p", F.lit(-1))
    rows = own.groupBy("word_id").agg(*(F.collect_list(c).alias(c) for c in ("i", "x", "y", "p", "score")))
    return words.select("word_id", "word").join(rows, "word_id")


def _arc_tables(row, automaton: dp.Automaton, arcs: dict[str, np.ndarray]) -> dict[tuple[int, str], np.ndarray]:
    """Scores [y, p] of the places (i, x) of a row of packed_arcs with the scores arcs[x][y, p] that hold for all words."""
    out: dict = {}
    shape = (len(automaton.y), len(automaton.p))
    for i, x, y, p, score in zip(row.i, row.x, row.y, row.p, row.score, strict=True):
        if (i, x) not in out:
            out[i, x] = np.zeros(shape), np.zeros(shape, bool)
        value, seen = out[i, x]
        if p < 0:
            value[y] += score
            seen[y] = True
        else:
            value[y, p] += score
    return {k: np.where(seen, value + arcs.get(k[1], 0.0), dp.NEG) for k, (value, seen) in out.items()}


def scored_transducer(row, automaton: dp.Automaton, extra: int, arcs: dict[str, np.ndarray] | None = None) -> dp.Transducer:
    """The transducer of a row of packed_arcs."""
    table = _arc_tables(row, automaton, arcs or {})
    return dp.Transducer(automaton, row.word, lambda i, x: table.get((i, x)), extra)


@dataclass
class ArcScores:
    """What workers hold of a transducer over features: scores [y, p] by x that hold for all words."""

    automaton: dp.Automaton
    extra: int
    arcs: dict[str, np.ndarray]

    def on(self, row) -> dp.Transducer:
        return scored_transducer(row, self.automaton, self.extra, self.arcs)

    def batch(self, rows: pd.DataFrame) -> dp.TransducerBatch:
        found = [_arc_tables(r, self.automaton, self.arcs) for r in rows.itertuples(index=False)]
        words, none = rows["word"].tolist(), np.full((len(self.automaton.y), len(self.automaton.p)), dp.NEG)
        n = len(words[0])
        at = lambda i, j: np.stack([t.get((i, w[i:j]), none) for t, w in zip(found, words, strict=True)])
        return dp.TransducerBatch(self.automaton, n, [[(j, at(i, j)) for j in (i, i + 1) if j <= n] for i in range(n + 1)], self.extra)


@dataclass
class FeatureScorer:
    """A transducer whose arcs have scores of their own at each place of a word: scored has the rows of packed_arcs."""

    scored: DataFrame
    shipped: ArcScores

    def attach(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.scored.drop("word"), "word_id")
