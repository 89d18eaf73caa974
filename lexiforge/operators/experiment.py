"""A whole experiment: load corpora, train, make candidates, rerank, decode, and report metrics.

python -m lexiforge.operators.experiment --dev PATH [--train PATH --test PATH ...]
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge import functions as L
from lexiforge import sources
from lexiforge.operators import metrics, models, tables, training
from lexiforge.operators.optimizer import AdaGrad

MODES = ("baseline", "oracle", "viterbi", "sample")


@dataclass(frozen=True)
class Config:
    """Paths of corpora, the segmenter (chunk or tree), the candidates (a mode or all) and what the models need. t_ and s_ set
    the transducer's and the segmenter's step, regularization and norm. training: pipeline (one after the other) or joint.
    transducer: weights of pairs of characters, or of features (places, copies and contexts; with after 1 also the character
    written last), which move many weights at once and so want a smaller t_eta, such as 0.05.
    out: a folder for weights and metrics of each epoch."""

    dev: str
    test: str | None = None
    train: str | None = None
    segmenter: str = "chunk"
    decode: str = "all"
    samples: int = 1000
    seed: int = 1
    cap: int | None = None
    labels: int = 3
    default_weight: float = -0.1
    training: str = "pipeline"
    transducer: str = "pairs"
    after: int = 0
    iterations: int = 20
    joint_samples: int = 10
    t_eta: float = 1.0
    t_c: float = 1e-7
    s_eta: float = 0.1
    s_c: float = 1e-8
    s_l: int = 2
    extra: int = 6
    out: str | None = None

    def __post_init__(self):
        if self.segmenter not in ("chunk", "tree"):
            raise ValueError(f"unknown segmenter {self.segmenter}")
        if self.decode not in (*MODES, "all"):
            raise ValueError(f"unknown decode mode {self.decode}")
        if self.training not in ("pipeline", "joint"):
            raise ValueError(f"unknown training {self.training}")
        if self.transducer not in ("features", "pairs"):
            raise ValueError(f"unknown transducer {self.transducer}")

    @property
    def modes(self) -> tuple[str, ...]:
        return MODES if self.decode == "all" else (self.decode,)


def load(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """word_id, word, ur_gold, truth (segments), truth_spans of a corpus; with a cap, of its first rows."""
    raw = sources.lines(spark, path)
    raw = sources.limited(raw, cap) if cap else raw
    found = sources.segments(F.col("raw"))
    return raw.select(
        F.col("line_no").alias("word_id"), sources.surface(F.col("raw")).alias("word"), sources.underlying(F.col("raw")).alias("ur_gold"),
        "raw", F.transform(found, lambda s: s["word"]).alias("truth"), F.transform(found, lambda s: F.struct(s["i"].alias("i"), s["j"].alias("j"))).alias("truth_spans"),
    )


def gold(words: DataFrame, segmenter: str) -> DataFrame:
    """word_id, ur, i, j, y of the gold analyses of load(): segments, or the nodes of trees."""
    if segmenter == "chunk":
        return words.select("word_id", F.col("ur_gold").alias("ur"), F.explode(sources.segments(F.col("raw"))).alias("s")).select("word_id", "ur", "s.i", "s.j", F.col("s.chunk").alias("y"))
    nodes = sources.parse(words.select(F.col("word_id").alias("line_no"), "raw")).where("parse_ok")
    return nodes.select(F.col("line_no").alias("word_id"), "ur", F.explode("nodes").alias("x")).where("x.node_id > 0").select("word_id", "ur", "x.i", "x.j", F.col("x.label").alias("y"))


def starting_scorer(words: DataFrame, extra: int = 6) -> models.TransducerScorer:
    """A scorer over the characters of words that prefers to copy."""
    letters = sources.alphabet(words.select(F.col("word_id").alias("line_no"), "word", "ur_gold"), ("word", "ur_gold"))
    if (n := letters.count()) ** 2 > models.MOST_WEIGHTS:
        raise ValueError(f"an alphabet of {n} characters is too large for a table of pairs")
    return models.TransducerScorer([r.symbol for r in letters.orderBy("id").collect()], [""], extra=extra)


def fit(spark: SparkSession, config: Config) -> tuple[models.TransducerScorer | training.FittedArcs, DataFrame]:
    """(transducer, weights of the segmenter) trained on config.train; each epoch is saved and logged in config.out."""
    words = training.checkpointed(load(spark, config.train, config.cap))
    truth = training.checkpointed(gold(words, config.segmenter))
    optimizer = AdaGrad(config.s_eta, config.s_c, config.s_l, config.default_weight)
    scorer, forms = starting_scorer(words, config.extra), words.select("word_id", F.col("ur_gold").alias("word"))

    def kept(epoch: int, weights: DataFrame) -> None:
        if config.out:
            sources.save_weights(weights, f"{config.out}/weights", config.segmenter, epoch)
            seg = segment(forms, weights, config).join(words, "word_id")
            acc = seg.agg(F.lit(config.segmenter).alias("model"), F.lit(epoch).alias("epoch"), F.avg((F.col("segments") == F.col("truth")).cast("double")).alias("accuracy"))
            sources.log_metrics(acc, f"{config.out}/log")

    symbols, contexts = scorer.symbols, scorer.symbols if config.after else [""]
    arcs = AdaGrad(config.t_eta, config.t_c, initial_w=config.default_weight)
    fitted = lambda w: training.FittedArcs(symbols, contexts, w, config.default_weight, config.extra)
    over_features = config.transducer == "features"
    if config.training == "joint":
        model = training.ArcModel.of(words, symbols, contexts) if over_features else scorer
        found, weights, told = training.joint(words, truth, model, training.no_weights(spark), config.segmenter, config.labels, config.iterations, config.joint_samples, config.s_eta, optimizer, config.seed, arcs, config.extra)
        scorer = fitted(found) if over_features else found
        if config.out:
            sources.log_metrics(spark.createDataFrame([("joint", k + 1, float(x)) for k, x in enumerate(told)], "model string, epoch int, accuracy double"), f"{config.out}/log")
            sources.save_weights(weights, f"{config.out}/weights", config.segmenter, config.iterations)
        return scorer, weights

    def told_accuracy(epoch: int, own) -> None:
        if config.out:
            acc = models.transduce(words, own).join(words.select("word_id", "ur_gold"), "word_id").agg(F.lit("transducer").alias("model"), F.lit(epoch).alias("epoch"), F.avg((F.col("ur") == F.col("ur_gold")).cast("double")).alias("accuracy"))
            sources.log_metrics(acc, f"{config.out}/log")

    def kept_arcs(epoch: int, own: DataFrame) -> None:
        told_accuracy(epoch, fitted(own).scorer(words))
        if config.out:
            sources.save_weights(own, f"{config.out}/weights", "transducer", epoch)

    if over_features:
        scorer = fitted(training.train_transducer(words, symbols, contexts, config.iterations, arcs, config.extra, kept_arcs)[0])
    for epoch in range(1, config.iterations + 1) if not over_features else ():
        scorer = training.scorer_step(words, scorer, config.t_eta / epoch**0.5, config.t_c)
        told_accuracy(epoch, scorer)
    return scorer, training.train(forms, truth.drop("ur"), config.segmenter, config.labels, config.iterations, optimizer, each_epoch=kept)[0]


def segment(rows: DataFrame, weights: DataFrame, config: Config) -> DataFrame:
    """word_id, segments, leaf spans, log_z of words (word_id, word)."""
    features = tables.chunk_features(rows) if config.segmenter == "chunk" else tables.tree_features(rows)
    out = training.segmented(rows, features, weights, config.segmenter, config.labels, config.default_weight)
    if config.segmenter == "chunk":
        return out.select("word_id", "segments", "spans", "log_z")
    leaf = F.filter("spans", lambda s: ~F.exists("spans", lambda t: (t["i"] >= s["i"]) & (t["j"] <= s["j"]) & (t["j"] - t["i"] < s["j"] - s["i"])))
    return out.select("word_id", L.strip_brackets(F.col("tree")).alias("segments"), leaf.alias("spans"), "log_z")


def decode(words: DataFrame, scorer: models.TransducerScorer | training.FittedArcs, weights: DataFrame, config: Config, mode: str) -> DataFrame:
    """word_id, ur, segments, spans: each word's best candidate by the transducer's log-likelihood plus the segmenter's log_z."""
    scorer = scorer.scorer(words) if isinstance(scorer, training.FittedArcs) else scorer
    cands = models.candidates(words, scorer, mode, config.samples, config.seed)
    keyed = cands.select(F.xxhash64("word_id", "ur").alias("key"), "word_id", "ur").distinct()
    own = segment(keyed.select(F.col("key").alias("word_id"), F.col("ur").alias("word")), weights, config).withColumnRenamed("word_id", "key")
    segmented = keyed.join(own, "key")
    best = models.rerank(cands, models.clamped(cands.select("word_id", "word", "ur").distinct(), scorer), segmented)
    return best.select("word_id", "ur").join(segmented.select("word_id", "ur", "segments", "spans"), ["word_id", "ur"])


def run(spark: SparkSession, config: Config, scorer: models.TransducerScorer | training.FittedArcs | None = None, weights: DataFrame | None = None) -> DataFrame:
    """set, mode, words, ur_acc, seg_acc, f1, edit, span_f1 for every set and mode, by the given models or those of fit()."""
    if scorer is None or weights is None:
        if config.train is None:
            raise ValueError("give models or a training corpus")
        scorer, weights = fit(spark, config)
    parts = []
    for name in ("dev", "test"):
        path = getattr(config, name)
        if path is None:
            continue
        words = load(spark, path, config.cap)
        for mode in config.modes:
            rows = decode(words, scorer, weights, config, mode).join(words, "word_id")
            rows = rows.select(F.lit(name).alias("set"), F.lit(mode).alias("mode"), F.col("ur").alias("guess_ur"), F.col("ur_gold").alias("truth_ur"), F.col("segments").alias("guess"), "truth", "spans", "truth_spans")
            one = metrics.segmentation(rows, ["set", "mode"])
            two = metrics.span_f1(rows.select("set", "mode", F.col("spans").alias("guess"), F.col("truth_spans").alias("truth")), ["set", "mode"]).drop("words")
            parts.append(one.join(two, ["set", "mode"]))
    return reduce(DataFrame.union, parts)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Train, decode and evaluate.")
    for f in fields(Config):
        kind = int if "int" in str(f.type) else float if "float" in str(f.type) else str
        parser.add_argument(f"--{f.name.replace('_', '-')}", type=kind, required=f.name == "dev", default=None if f.name == "dev" else f.default)
    run(SparkSession.builder.getOrCreate(), Config(**vars(parser.parse_args(argv)))).show(truncate=False)


if __name__ == "__main__":
    main()
