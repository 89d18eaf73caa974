"""Training loops: batch steps as joins over feature weights, for one model or for both jointly."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge import functions as L
from lexiforge.operators import dp, models, tables
from lexiforge.operators.optimizer import AdaGrad


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder of spark.checkpoint.dir, which the session must name."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not root:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(root)
    return df.checkpoint()


def chunk_gradient(scored: DataFrame, gold: DataFrame, gt0: list[float], gt: list[list[float]]) -> DataFrame:
    """word_id, i, j, y, g of the negative log-likelihood by the segments' scores. gold: word_id, i, j, y."""
    expected = models.chunk_posteriors(scored, gt0, gt).withColumnRenamed("p", "g")
    return expected.union(gold.select("word_id", "i", "j", "y", F.lit(-1.0))).groupBy("word_id", "i", "j", "y").agg(F.sum("g").alias("g"))


def tree_gradient(scored: DataFrame, gold: DataFrame, labels: int = 3) -> DataFrame:
    """As chunk_gradient, for the nodes of trees."""
    expected = models.tree_posteriors(scored, labels).withColumnRenamed("p", "g")
    return expected.union(gold.select("word_id", "i", "j", "y", F.lit(-1.0))).groupBy("word_id", "i", "j", "y").agg(F.sum("g").alias("g"))


def transition_keys(labels: int) -> dict[tuple[int, int], int]:
    """(label before, -1 for none; label): its weight's slot. A label has a weight, and each pair of labels that follow each other."""
    names = {(b, y): f"tag:{b}" if b >= 0 else "tag" for b in range(-1, labels) for y in range(labels)}
    return {at: (int(hashlib.md5(name.encode()).hexdigest()[:7], 16) * labels + at[1]) % L.SLOTS for at, name in names.items()}


def transitions(weights: DataFrame, labels: int = 3, default: float = -0.1) -> tuple[list[float], list[list[float]]]:
    """(gt0, gt) of the weights (k, w): the label's weight, and behind another label that of the pair too. labels * (labels + 1) rows are read."""
    keys = transition_keys(labels)
    known = {r.k: r.w for r in weights.where(F.col("k").isin(list(keys.values()))).select("k", "w").collect()}
    w = {at: known.get(k, default) for at, k in keys.items()}
    return [w[-1, y] for y in range(labels)], [[w[-1, y] + w[b, y] for y in range(labels)] for b in range(labels)]


def transition_gradient(scored: DataFrame, gold: DataFrame, gt0: list[float], gt: list[list[float]]) -> DataFrame:
    """k, g of the negative log-likelihood by the weights of labels and pairs of labels."""
    labels = len(gt0)
    before = F.coalesce(F.lag("y").over(Window.partitionBy("word_id").orderBy("i")), F.lit(-1))
    path = gold.select(before.alias("before"), "y").groupBy("before", "y").agg((-F.count("*")).cast("double").alias("p"))
    sums = models.chunk_transitions(scored, gt0, gt).union(path).groupBy("before", "y").agg(F.sum("p").alias("g"))
    return _transition_slots(sums, labels)


def _transition_slots(sums: DataFrame, labels: int) -> DataFrame:
    """k, g of sums (before, y, g)."""
    named = sums.sparkSession.createDataFrame([(b, y, k) for (b, y), k in transition_keys(labels).items()], "before int, y int, k long")
    own = sums.join(F.broadcast(named), ["before", "y"]).select("k", "g")
    label = sums.where("before >= 0").join(F.broadcast(named.where("before = -1").select("y", "k")), "y").select("k", "g")
    return own.union(label).groupBy("k").agg(F.sum("g").alias("g"))


def _scored(words: DataFrame, features: DataFrame, weights: DataFrame, labels: int, optimizer: AdaGrad) -> DataFrame:
    return models.packed(words, tables.potentials(features, weights, labels, optimizer.initial_w))


def segmenter_gradient(words: DataFrame, gold: DataFrame, features: DataFrame, weights: DataFrame, kind: str, labels: int, optimizer: AdaGrad) -> DataFrame:
    """k, g of the negative log-likelihood of gold (word_id, i, j, y) by all weights of a chunk or tree model."""
    scored = _scored(words, features, weights, labels, optimizer)
    if kind == "tree":
        return tables.gradient_by_feature(features, tree_gradient(scored, gold, labels), labels)
    gt0, gt = transitions(weights, labels, optimizer.initial_w)
    own = tables.gradient_by_feature(features, chunk_gradient(scored, gold, gt0, gt), labels)
    return own.union(transition_gradient(scored, gold, gt0, gt)).groupBy("k").agg(F.sum("g").alias("g"))


def no_weights(spark) -> DataFrame:
    return spark.createDataFrame([], "k long, w double, q double, u int")


def segmented(words: DataFrame, features: DataFrame, weights: DataFrame, kind: str, labels: int = 3, default: float = -0.1) -> DataFrame:
    """The decoded words (word_id, word) by weights: decode_chunks or decode_trees."""
    scored = models.packed(words, tables.potentials(features, weights, labels, default))
    return models.decode_chunks(scored, *transitions(weights, labels, default)) if kind == "chunk" else models.decode_trees(scored, labels)


def train(words: DataFrame, gold: DataFrame, kind: str = "chunk", labels: int = 3, iterations: int = 20, optimizer: AdaGrad | None = None, features: DataFrame | None = None, each_epoch: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(weights, metrics of each epoch: words and mean log_z) of a chunk or tree model. One batch step for each epoch:
    potentials by a join, posteriors in Arrow batches, the gradient summed by feature, the update by a join. Labels and pairs
    of labels have weights of their own. Lineage is cut by a checkpoint after each; each_epoch(epoch, weights) is called then."""
    if kind not in ("chunk", "tree"):
        raise ValueError(f"unknown kind {kind}")
    optimizer = optimizer or AdaGrad()
    features = tables.chunk_features(words) if features is None and kind == "chunk" else tables.tree_features(words) if features is None else features
    weights, metrics = no_weights(words.sparkSession), []
    for step in range(1, iterations + 1):
        metrics.append(segmented(words, features, weights, kind, labels, optimizer.initial_w).agg(F.count("*").alias("words"), F.avg("log_z").alias("log_z")))
        weights = checkpointed(optimizer.step(weights, segmenter_gradient(words, gold, features, weights, kind, labels, optimizer), step))
        if each_epoch is not None:
            each_epoch(step, optimizer.finalize(weights, step + 1))
    return optimizer.finalize(weights, iterations + 1), metrics


def weighted_segmenter_gradient(weighted: DataFrame, gold: DataFrame, weights: DataFrame, kind: str, labels: int, optimizer: AdaGrad) -> DataFrame:
    """k, g of the negative expected log-partition of sampled forms under importance weights, and of the gold analysis: with the
    joint score of a form being its transducer score plus the segmenter's log partition function, the gradient of the gold
    form's joint log-likelihood by the segmenter is the gold counts less the weighted posteriors.

    weighted: word_id, ur, weight; gold: word_id, ur, i, j, y."""
    forms = weighted.select(F.xxhash64("word_id", "ur").alias("form"), "word_id", F.col("ur").alias("word"), "weight")
    own = forms.select(F.col("form").alias("word_id"), "word")
    true = gold.select(F.xxhash64("word_id", "ur").alias("word_id"), "ur", "i", "j", "y")
    every = own.union(true.select("word_id", F.col("ur").alias("word"))).distinct()
    features = tables.chunk_features(every) if kind == "chunk" else tables.tree_features(every)
    scored = _scored(own, features, weights, labels, optimizer)
    share = forms.select(F.col("form").alias("word_id"), "weight")
    parts = []
    if kind == "chunk":
        gt0, gt = transitions(weights, labels, optimizer.initial_w)
        p = models.chunk_posteriors(scored, gt0, gt)
        # transitions are weighted word by word
        per = models.chunk_transitions_by_word(scored, gt0, gt).join(share, "word_id").groupBy("before", "y").agg(F.sum(F.col("p") * F.col("weight")).alias("p"))
        before = F.coalesce(F.lag("y").over(Window.partitionBy("word_id").orderBy("i")), F.lit(-1))
        path = true.select(before.alias("before"), "y").groupBy("before", "y").agg((-F.count("*")).cast("double").alias("p"))
        parts.append(_transition_slots(per.union(path).groupBy("before", "y").agg(F.sum("p").alias("g")), labels))
    else:
        p = models.tree_posteriors(scored, labels)
    cells = p.join(share, "word_id").select("word_id", "i", "j", "y", (F.col("p") * F.col("weight")).alias("g"))
    cells = cells.union(true.select("word_id", "i", "j", "y", F.lit(-1.0))).groupBy("word_id", "i", "j", "y").agg(F.sum("g").alias("g"))
    parts.append(tables.gradient_by_feature(features, cells, labels))
    return reduce(DataFrame.union, parts).groupBy("k").agg(F.sum("g").alias("g"))


def joint(words: DataFrame, gold: DataFrame, scorer: models.TransducerScorer | ArcModel, weights: DataFrame, kind: str = "chunk", labels: int = 3, iterations: int = 5, samples: int = 10, eta: float = 0.1, optimizer: AdaGrad | None = None, seed: int = 1, arcs: AdaGrad | None = None, extra: int = 6) -> tuple[models.TransducerScorer | DataFrame, DataFrame, list[float]]:
    """(transducer, weights, mean joint log-likelihood of the gold forms among the candidates in each epoch) after training both
    models together: draw forms, weigh them by their joint score, step both models by the weights.

    words: word_id, word, ur_gold; gold: word_id, ur (the gold form), i, j, y. The gold form is always a candidate. The
    transducer is a scorer, stepped by eta, or an ArcModel, whose weights are stepped by arcs and returned."""
    optimizer, told = optimizer or AdaGrad(), []
    over_features, step_arcs = isinstance(scorer, ArcModel), arcs or AdaGrad(eta=1.0, c=1e-7)
    arc_weights = no_weights(words.sparkSession)
    truth = words.select("word_id", F.col("ur_gold").alias("ur"))
    for step in range(1, iterations + 1):
        own = scorer.scorer(words, arc_weights, step_arcs.initial_w, extra) if over_features else scorer
        cands = models.candidates(words, own, "sample", samples, seed + step).select("word_id", "word", "ur")
        cands = checkpointed(cands.union(words.select("word_id", "word", F.col("ur_gold").alias("ur"))).distinct())
        forms = cands.select(F.xxhash64("word_id", "ur").alias("word_id"), F.col("ur").alias("word")).distinct()
        features = tables.chunk_features(forms) if kind == "chunk" else tables.tree_features(forms)
        seg = segmented(forms, features, weights, kind, labels, optimizer.initial_w).select(F.col("word_id").alias("form"), "log_z")
        ll = models.clamped(cands, own).where("in_support").select("word_id", "ur", "ll")
        scores = ll.withColumn("form", F.xxhash64("word_id", "ur")).join(seg, "form").select("word_id", "ur", (F.col("ll") + F.col("log_z")).alias("score"))
        weighted = checkpointed(importance(cands, scores).select("word_id", "ur", "weight"))
        told.append(weighted.join(truth, ["word_id", "ur"]).agg(F.avg(F.log("weight"))).first()[0])
        # words whose gold form is beyond the length limit have no likelihood and take no part
        inside = truth.join(weighted.select("word_id", "ur"), ["word_id", "ur"], "left_semi")
        weighted = weighted.join(inside.select("word_id"), "word_id", "left_semi")
        gradient = weighted_segmenter_gradient(weighted, gold.join(inside.select("word_id"), "word_id", "left_semi"), weights, kind, labels, optimizer)
        weights = checkpointed(optimizer.step(weights, gradient, step))
        if over_features:
            both = weighted.union(inside.withColumn("weight", F.lit(-1.0))).groupBy("word_id", "ur").agg(F.sum("weight").alias("weight"))
            rows = words.select("word_id", "word").join(both, "word_id")
            arc_weights = checkpointed(step_arcs.step(arc_weights, scorer.gradient(checkpointed(weighted_arcs(own, rows))), step))
        else:
            scorer = joint_step(words, inside.withColumn("weight", F.lit(1.0)), weighted, scorer, eta)
    return step_arcs.finalize(arc_weights, iterations + 1) if over_features else scorer, optimizer.finalize(weights, iterations + 1), told


def importance(cands: DataFrame, scores: DataFrame) -> DataFrame:
    """word_id, ur, weight of the distinct candidates by the joint score (word_id, ur, score), normalized for each word."""
    return models.softmax(cands.select("word_id", "ur").distinct().join(scores, ["word_id", "ur"]))


def _pair_sums(rows: DataFrame, scorer: models.TransducerScorer, arcs: Callable[[dp.Transducer, object], list]) -> dict[tuple[str, str], float]:
    """Sums over rows of the arc values that arcs(transducer, row) gives, by pair of symbols."""
    if len(scorer.symbols) ** 2 > models.MOST_WEIGHTS:
        raise ValueError(f"more than {models.MOST_WEIGHTS} pairs of symbols")

    def each(group):
        for row in group.itertuples(index=False):
            t = scorer.on(row.word)
            for i, (own, values) in enumerate(zip(t.moves, arcs(t, row), strict=True)):
                for (j, _), v in zip(own, values, strict=True):
                    yield from ((row.word[i:j], scorer.symbols[y], float(x)) for y, x in enumerate(v.sum(axis=1)) if x)

    sums = models._mapped(rows, "x string, y string, g double", each).groupBy("x", "y").agg(F.sum("g").alias("g"))
    return {(r.x, r.y): r.g for r in sums.collect()}  # at most the square of the alphabet, which is checked


def _moved(scorer: models.TransducerScorer, sums: dict[tuple[str, str], float], eta: float, c: float = 0.0) -> models.TransducerScorer:
    pairs = {k: (scorer.pairs.get(k, 0.0) + eta * sums.get(k, 0.0)) / (1 + eta * c) for k in scorer.pairs.keys() | sums.keys()}
    return replace(scorer, pairs=pairs)


def scorer_step(words: DataFrame, scorer: models.TransducerScorer, eta: float, c: float = 0.0) -> models.TransducerScorer:
    """The scorer after one ascent step of the mean log-likelihood of words (word, ur_gold) by its pair weights, which c shrinks."""
    n = max(words.count(), 1)
    inside = words.select("word", "ur_gold").where(F.length("ur_gold") <= F.length("word") + scorer.extra)
    return _moved(scorer, _pair_sums(inside, scorer, lambda t, row: t.gradient(row.ur_gold)), eta / n, c * n)


def joint_step(words: DataFrame, truth: DataFrame, weighted: DataFrame, scorer: models.TransducerScorer, eta: float) -> models.TransducerScorer:
    """The scorer after one ascent step on pair weights: expected arcs of the true outputs less those of the outputs by importance
    (both word_id, ur, weight)."""
    both = truth.select("word_id", "ur", "weight").union(weighted.select("word_id", "ur", (-F.col("weight")).alias("weight"))).groupBy("word_id", "ur").agg(F.sum("weight").alias("weight"))
    rows = words.select("word_id", "word").join(both, "word_id").select("word", "ur", "weight")
    return _moved(scorer, _pair_sums(rows, scorer, lambda t, row: [[row.weight * v for v in own] for own in t.expected_clamped(row.ur)]), eta)


@dataclass(frozen=True)
class ArcModel:
    """What a transducer over features scores: the segment and surroundings of a place by output symbol, by copying, and by
    output symbol after a context; and the arcs themselves by pair, copying and context, whatever the word."""

    symbols: list[str]
    contexts: list[str]
    places: DataFrame
    arcs: DataFrame

    @classmethod
    def of(cls, words: DataFrame, symbols: list[str], contexts: list[str], width: int = 6, marks: tuple[str, ...] = ()) -> ArcModel:
        if len(symbols) ** 2 * len(contexts) > models.MOST_WEIGHTS:
            raise ValueError(f"more than {models.MOST_WEIGHTS} arcs")
        spark = words.sparkSession
        letters = spark.createDataFrame(list(zip(symbols, range(len(symbols)), strict=True)), "symbol string, id int")
        after = spark.createDataFrame([(c,) for c in contexts], "symbol string")
        return cls(symbols, contexts, tables.transducer_features(words, width, marks), tables.arc_features(letters, after))

    @property
    def _copied(self) -> DataFrame:
        return self.places.sparkSession.createDataFrame(list(zip(self.symbols, range(len(self.symbols)), strict=True)), "x string, y int")

    def scorer(self, words: DataFrame, weights: DataFrame, default: float, extra: int = 6) -> models.FeatureScorer:
        """The scorer of words (word_id, word) under weights (k, w)."""
        by, wide = ("word_id", "i", "x"), len(self.contexts)
        plain = tables.potentials(self.places, weights, len(self.symbols), default, by).select(*by, "y", F.lit(-1).alias("p"), "score")
        copies = tables.potentials(tables.tagged(self.places, "copy&"), weights, 1, default, by).drop("y").join(F.broadcast(self._copied), "x").select(*by, "y", F.lit(-1).alias("p"), "score")
        after = tables.potentials(tables.tagged(self.places, "after&"), weights, len(self.symbols) * wide, default, by)
        after = after.select(*by, F.expr(f"y div {wide}").cast("int").alias("y"), (F.col("y") % wide).alias("p"), "score")
        places = plain.union(copies).union(after).groupBy(*by, "y", "p").agg(F.sum("score").alias("score"))
        arcs = {x: np.zeros((len(self.symbols), wide)) for x in self.symbols}
        y, p = ({c: k for k, c in enumerate(own)} for own in (self.symbols, self.contexts))
        # as many rows as arcs, whose number is checked
        for r in tables.potentials(self.arcs, weights, 1, default, ("x", "out", "p")).select("x", "out", "p", "score").collect():
            arcs[r.x][y[r.out], p[r.p]] = r.score
        return models.FeatureScorer(models.packed_arcs(words, places), models.ArcScores(dp.Automaton(self.symbols, self.contexts), extra, arcs))

    def gradient(self, gradient: DataFrame) -> DataFrame:
        """k, g of the sums (word_id, i, x, y, p, g) by the arcs' scores."""
        by, wide = ("word_id", "i", "x"), len(self.contexts)
        by_y = gradient.groupBy(*by, "y").agg(F.sum("g").alias("g"))
        copies = by_y.join(F.broadcast(self._copied), ["x", "y"]).withColumn("y", F.lit(0))
        after = gradient.withColumn("y", F.col("y") * wide + F.col("p")).select(*by, "y", "g")
        named = [self.places.sparkSession.createDataFrame([(k, c) for k, c in enumerate(own)], f"{n} int, {t} string") for own, n, t in ((self.symbols, "y", "out"), (self.contexts, "p", "context"))]
        arcs = gradient.groupBy("x", "y", "p").agg(F.sum("g").alias("g")).join(F.broadcast(named[0]), "y").join(F.broadcast(named[1]), "p")
        arcs = arcs.select("x", "out", F.col("context").alias("p"), F.lit(0).alias("y"), "g")
        parts = [
            tables.gradient_by_feature(self.places, by_y, len(self.symbols), by),
            tables.gradient_by_feature(tables.tagged(self.places, "copy&"), copies, 1, by),
            tables.gradient_by_feature(tables.tagged(self.places, "after&"), after, len(self.symbols) * wide, by),
            tables.gradient_by_feature(self.arcs, arcs, 1, ("x", "out", "p")),
        ]
        return reduce(DataFrame.union, parts).groupBy("k").agg(F.sum("g").alias("g"))


@dataclass(frozen=True)
class FittedArcs:
    """A trained ArcModel: its alphabets and weights."""

    symbols: list[str]
    contexts: list[str]
    weights: DataFrame
    default: float = -0.1
    extra: int = 6

    def scorer(self, words: DataFrame) -> models.FeatureScorer:
        return ArcModel.of(words, self.symbols, self.contexts).scorer(words, self.weights, self.default, self.extra)


ARC_SUMS = "word_id long, i int, x string, y int, p int, g double"


def _arc_rows(row, t: dp.Transducer, values: list, times: float) -> Iterator[tuple]:
    for i, (own, sums) in enumerate(zip(t.moves, values, strict=True)):
        for (j, _), g in zip(own, sums, strict=True):
            for y, p in zip(*(a.tolist() for a in np.nonzero(g)), strict=True):
                yield row.word_id, i, row.word[i:j], y, p, times * float(g[y, p])


def transducer_gradient(scorer: models.FeatureScorer, gold: DataFrame) -> DataFrame:
    """word_id, i, x, y, p, g of the negative log-likelihood by the arcs' scores. gold: word_id, word, ur_gold; forms beyond the
    length limit have no likelihood and take no part."""
    model = scorer.shipped

    def each(rows):
        for row in rows.itertuples(index=False):
            t = model.on(row)
            yield from _arc_rows(row, t, t.gradient(row.ur_gold), -1.0)

    inside = gold.where(F.length("ur_gold") <= F.length("word") + model.extra)
    return models._mapped(scorer.attach(inside.select("word_id", "word", "ur_gold")), ARC_SUMS, each)


def weighted_arcs(scorer: models.FeatureScorer, rows: DataFrame) -> DataFrame:
    """word_id, i, x, y, p, g: expected arcs given the outputs of rows (word_id, word, ur, weight), times their weights."""
    model = scorer.shipped

    def each(group):
        for row in group.itertuples(index=False):
            t = model.on(row)
            yield from _arc_rows(row, t, t.expected_clamped(row.ur), row.weight)

    return models._mapped(scorer.attach(rows.select("word_id", "word", "ur", "weight")), ARC_SUMS, each)


def train_transducer(words: DataFrame, symbols: list[str], contexts: list[str], iterations: int = 20, optimizer: AdaGrad | None = None, extra: int = 6, each_epoch: Callable[[int, DataFrame], None] | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(weights, exact-match accuracy of the best output against ur_gold for each epoch) from words (word_id, word, ur_gold),
    by the same batch steps as train(). The weights are those of ArcModel."""
    optimizer = optimizer or AdaGrad(eta=1.0, c=1e-7)
    model = ArcModel.of(words, symbols, contexts)
    weights, metrics = no_weights(words.sparkSession), []
    for step in range(1, iterations + 1):
        scorer = model.scorer(words, weights, optimizer.initial_w, extra)
        gradient = checkpointed(transducer_gradient(scorer, words))
        best = models.transduce(words, scorer).join(words.select("word_id", "ur_gold"), "word_id")
        metrics.append(best.agg(F.avg((F.col("ur") == F.col("ur_gold")).cast("double")).alias("ur_acc")))
        weights = checkpointed(optimizer.step(weights, model.gradient(gradient), step))
        if each_epoch is not None:
            each_epoch(step, optimizer.finalize(weights, step + 1))
    return optimizer.finalize(weights, iterations + 1), metrics
