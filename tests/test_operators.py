"""Sources, tables, optimizer, training and queries."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lexiforge import functions as L
from lexiforge import plans, sources
from lexiforge.operators import enumerate as brute
from lexiforge.operators import metrics, models, tables, training
from lexiforge.operators.optimizer import AdaGrad

DATA = "/root/testdata/sf0.001"
LINES = [
    "rejig (S (re:prefix) (jig:stem))",
    "miserly (S (S (misa:stem) (r:suffix)) (ly:suffix))",
    "marble (marble :stem)",
    "bad  (S (bad:stme) (ly:suffix)",
    "more (S (mo:stem) (re:suffix)))",
    "(S (un:prefix) (do:stem))",
    "three (S (a:prefix) (b:stem) (c:suffix))",
    "",
    None,
]


def test_parser_is_lenient(spark):
    corpus = spark.createDataFrame(list(enumerate(LINES)), "line_no long, raw string")
    got = {r.line_no: r for r in sources.parse(corpus).collect()}
    assert [got[k].ur for k in range(7)] == ["rejig", "misarly", "marble", "badly", "more", "undo", "abc"]
    assert [got[k].parse_issue for k in range(9)] == [None, None, None, "unclosed (", "surplus )", "no surface form", "more than two children", None, None]
    assert [(x.i, x.j, x.label, x.word) for x in got[1].nodes] == [(0, 7, 0, None), (0, 7, 0, None), (0, 5, 0, None), (0, 4, 0, "misa"), (4, 5, 2, "r"), (5, 7, 2, "ly")]
    assert sources.checked(sources.parse(corpus)).count() == 0
    leaf = {r.line_no: [x.word for x in r.s] for r in corpus.where("raw IS NOT NULL").select("line_no", sources.segments(F.col("raw")).alias("s")).collect()}
    assert leaf[1] == ["misa", "r", "ly"] and leaf[2] == ["marble"]
    assert sources.display([x.asDict() for x in got[0].nodes]).startswith("S(0,5)")


def test_alphabet_round_trip(spark, tmp_path):
    words = spark.createDataFrame([(0, "ba"), (1, "cab")], "line_no long, word string")
    symbols = sources.alphabet(words, seeds=("o",))
    assert {r.symbol: r.id for r in symbols.collect()} == {"": 0, "o": 1, "b": 2, "a": 3, "c": 4}
    sources.save_alphabet(symbols, str(tmp_path / "a"))
    assert sorted(sources.load_alphabet(spark, str(tmp_path / "a")).collect()) == sorted(symbols.collect())
    found = tables.substrings(words.withColumnRenamed("line_no", "word_id"), symbols.where("symbol <> 'c'"), 1)
    assert found.where("id = -1").count() == 1
    with pytest.raises(Exception, match="frozen"):
        tables.frozen(found).collect()


def test_weights_round_trip(spark, tmp_path):
    w = spark.createDataFrame([(1, 0.5, 1.0, 2)], "k long, w double, q double, u int")
    for epoch in (1, 2):
        sources.save_weights(w.withColumn("w", F.col("w") * epoch), str(tmp_path / "w"), "chunk", epoch)
    assert sources.load_weights(spark, str(tmp_path / "w"), "chunk").first().w == 1.0
    assert sources.load_weights(spark, str(tmp_path / "w"), "chunk", 1).first().w == 0.5


def test_contexts(spark):
    row = spark.range(1).select(L.prefix_contexts(F.lit("abc"), F.lit(2), 5).alias("p"), L.suffix_contexts(F.lit("abc"), F.lit(2), 5).alias("s"), L.suffix_contexts(F.lit("abc"), F.lit(2), 5, repeat=False).alias("t")).first()
    assert row.p == ["a", "^a"] and row.s == ["b", "bc", "bc$", "bc$", "bc$"] and row.t == ["b", "bc", "bc$"]


def test_segmentations_column(spark):
    got = spark.createDataFrame([("abc",)], "w string").select(brute.segmentations_column(F.col("w")).alias("s")).first().s
    assert sorted(map(tuple, got)) == [("a", "b", "c"), ("a", "bc"), ("ab", "c"), ("abc",)]


def test_adagrad_lazy_equals_eager(spark):
    opt = AdaGrad(eta=0.5, c=0.1)
    w = spark.createDataFrame([(1, 1.0, 1.0, 0)], "k long, w double, q double, u int")
    late = opt.finalize(w, 3).first().w
    assert late == pytest.approx((1 / 1.05) ** 3)
    stepped = opt.step(w, spark.createDataFrame([(2, 0.5)], "k long, g double"), 3)
    assert {r.k: r.u for r in stepped.collect()} == {1: 0, 2: 4}
    assert opt.finalize(w.withColumn("u", F.lit(9)), 3).first().w == 1.0


def test_training_fits(spark):
    words = spark.createDataFrame([(1, "redo"), (2, "undo")], "word_id long, word string")
    gold = spark.createDataFrame([(1, 0, 2, 0), (1, 2, 4, 2), (2, 0, 2, 0), (2, 2, 4, 2)], "word_id long, i int, j int, y int")
    weights, epochs = training.train(words, gold, "chunk", iterations=4, optimizer=AdaGrad(eta=1.0))
    scored = models.packed(words, tables.potentials(tables.chunk_features(words), weights, 3))
    got = {r.word: (r.segments, r.labels) for r in models.decode_chunks(scored, [0.0] * 3, [[0.0] * 3] * 3).collect()}
    assert got == {"redo": (["re", "do"], [0, 2]), "undo": (["un", "do"], [0, 2])} and len(epochs) == 4


def test_candidates_and_reranking(spark):
    words = spark.createDataFrame([(1, "ab", "aab")], "word_id long, word string, ur_gold string")
    scorer = models.TransducerScorer(["", "a", "b"], ["", "a"], copy=1.0, change=-1.0, extra=1)
    for mode in ("baseline", "oracle", "viterbi", "sample"):
        got = models.candidates(words, scorer, mode, num=50).collect()
        assert got[0].ur == {"baseline": "ab", "oracle": "aab"}.get(mode, "ab")
    with pytest.raises(ValueError):
        models.candidates(words, scorer, "other")
    cands = models.candidates(words, scorer, "sample", num=50)
    assert cands.collect() == models.candidates(words, scorer, "sample", num=50).collect()
    ll = models.clamped(cands.distinct(), scorer)
    seg = cands.select("word_id", "ur").distinct().withColumn("log_z", F.when(F.col("ur") == "aab", 100.0).otherwise(0.0))
    best = models.rerank(cands.union(words.select("word_id", "word", F.lit(99), F.lit("aab"), F.lit("sample"), F.lit(1))), ll.union(models.clamped(words.withColumn("ur", F.lit("aab")), scorer)), seg.union(spark.createDataFrame([(1, "aab", 100.0)], "word_id long, ur string, log_z double")))
    assert best.first().ur == "aab"
    weights = training.importance(cands, ll.select("word_id", "ur", F.col("ll").alias("score")))
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    truth = spark.createDataFrame([(1, "aab", 1.0)], "word_id long, ur string, weight double")
    moved = training.joint_step(words, truth, weights.select("word_id", "ur", "weight"), scorer, 0.1)
    assert moved.on("ab").log_likelihood("aab") > scorer.on("ab").log_likelihood("aab")


def test_metrics(spark):
    rows = spark.createDataFrame([("ab", "ab", ["a", "b"], ["a", "b"]), ("ab", "abc", ["ab"], ["ab", "c"])], "guess_ur string, truth_ur string, guess array<string>, truth array<string>")
    got = metrics.segmentation(rows.withColumn("split", F.lit("dev")), ["split"]).first()
    assert (got.ur_acc, got.seg_acc, got.f1, got.edit) == (0.5, 0.5, pytest.approx((1 + 2 / 3) / 2), 1.0)


@pytest.mark.parametrize("name", ["parse_leaves", "tree_nodes", "alphabet", "next_state", "feature_counts", "chunk_best", "align_best", "rerank_best", "seg_metrics", "adagrad_l1_step", "potentials_join", "coverage", "chunk_decode", "chunk_posterior", "tree_decode", "tree_nodes_expected", "transduce_best", "transduce_logz", "transduce_band", "transduce_clamped", "grad_sum", "path_labels"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = plans.queries()[name](spark, DATA).toPandas()
    want = con.execute(plans.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_streaming(spark, tmp_path):
    from lexiforge.streaming import decode_stream

    spark.createDataFrame([(1, "ab")], "word_id long, word string").write.parquet(str(tmp_path / "in"))
    scorer = models.TransducerScorer(["", "a", "b"], [""], extra=1)
    stream = spark.readStream.schema("word_id long, word string").parquet(str(tmp_path / "in"))
    q = decode_stream(stream, scorer).writeStream.format("memory").queryName("decoded").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT ur FROM decoded").first().ur == "ab"


def _likelihood(words, model, weights, extra=1):
    scorer = model.scorer(words, weights, -0.1, extra)
    return sum(scorer.shipped.on(r).log_likelihood(r.ur_gold) for r in scorer.attach(words).collect())


def test_transducer_training(spark):
    words = spark.createDataFrame([(1, "aa", "ab"), (2, "ba", "bb")], "word_id long, word string, ur_gold string")
    symbols, contexts = ["", "a", "b"], ["", "a", "b"]
    model = training.ArcModel.of(words, symbols, contexts)
    weights, accuracy = training.train_transducer(words, symbols, contexts, iterations=2, optimizer=AdaGrad(eta=0.05), extra=1)
    assert _likelihood(words, model, weights) > _likelihood(words, model, weights.limit(0)) + 0.5 and len(accuracy) == 2


def test_transducer_gradient_by_feature(spark):
    """Slots of all kinds of features, against differences of the likelihood."""
    words = spark.createDataFrame([(1, "ab", "bb"), (2, "ba", "a")], "word_id long, word string, ur_gold string")
    symbols, contexts = ["", "a", "b"], ["", "b"]
    model = training.ArcModel.of(words, symbols, contexts, width=2)
    names = {"pair:a>b": (1, 0), "copy": (1, 0), "change": (1, 0), "after:b": (1, 0), "after:b|b>b": (1, 0), "after:|copy": (1, 0), "x:a": (3, 2), "copy&x:b": (1, 0), "after&right:b": (6, 5)}
    text = spark.createDataFrame([(n, *v) for n, v in names.items()], "f string, labels int, y int")
    slot = {r.f: r.k for r in text.select("f", L.slot(L.hash_key(F.col("f")), F.col("labels"), F.col("y")).alias("k")).collect()}
    start = [(k, 0.3 - 0.1 * n) for n, k in enumerate(slot.values())]
    frame = lambda rows: spark.createDataFrame(rows, "k long, w double")
    got = {r.k: r.g for r in model.gradient(training.transducer_gradient(model.scorer(words, frame(start), -0.1, 1), words)).collect()}
    for name in ("copy", "after:b|b>b", "copy&x:b", "after&right:b"):
        up, down = ([(k, w + e * (k == slot[name])) for k, w in start] for e in (1e-4, -1e-4))
        numeric = (_likelihood(words, model, frame(up)) - _likelihood(words, model, frame(down))) / 2e-4
        assert -got[slot[name]] == pytest.approx(numeric, abs=1e-5) and abs(numeric) > 1e-3, name


def test_batched_transducer_equals_single_words(spark):
    words = spark.createDataFrame([(1, "ab", "b"), (2, "bb", "b"), (3, "a", "a"), (4, "", "")], "word_id long, word string, ur_gold string")
    symbols, contexts = ["", "a", "b"], ["", "b"]
    model = training.ArcModel.of(words, symbols, contexts)
    weights = spark.sql("SELECT k, (k % 7) / 5 - 0.5 AS w FROM (SELECT explode(sequence(0, 4194303, 3)) AS k)")
    scorer = model.scorer(words, weights, -0.1, 2)
    got = {r.word_id: r for r in models.transduce(words, scorer).collect()}
    for row in scorer.scored.collect():
        t = scorer.shipped.on(row)
        assert got[row.word_id].log_z == pytest.approx(t.log_z()) and got[row.word_id].score == pytest.approx(t.decode()[0]) and got[row.word_id].ur == t.decode()[1]


@pytest.mark.parametrize("segmenter", ["chunk", "tree"])
def test_experiment(spark, tmp_path, segmenter):
    from lexiforge.operators import experiment

    spark.createDataFrame([("recut (S (re:prefix) (cut:stem))",), ("uncut (S (un:prefix) (cut:stem))",)], "value string").coalesce(1).write.text(str(tmp_path / "dev"))
    letters = ["", *"centru"]
    scorer = models.TransducerScorer(letters, [""], extra=1)
    weights = spark.createDataFrame([], "k long, w double, q double, u int")
    config = experiment.Config(dev=str(tmp_path / "dev"), segmenter=segmenter, samples=20)
    got = {r["mode"]: r for r in experiment.run(spark, config, scorer, weights).collect()}
    assert set(got) == set(experiment.MODES) and all(r.words == 2 and r.ur_acc == 1.0 and 0 <= r.span_f1 <= 1 for r in got.values())
    with pytest.raises(ValueError):
        experiment.Config(dev="x", decode="best")


@pytest.mark.parametrize("segmenter, how", [("chunk", "pipeline"), ("tree", "pipeline"), ("chunk", "joint")])
def test_experiment_trains(spark, tmp_path, segmenter, how):
    from lexiforge.operators import experiment

    spark.createDataFrame([("rerun (S (re:prefix) (run:stem))",), ("redy (S (red:stem) (y:suffix))",), ("badly (S (bad:stem) (ly:suffix))",)], "value string").coalesce(1).write.text(str(tmp_path / "train"))
    config = experiment.Config(dev=str(tmp_path / "train"), train=str(tmp_path / "train"), segmenter=segmenter, decode="viterbi", iterations=3, s_eta=1.0, extra=1, training=how, out=str(tmp_path / "out"))
    got = experiment.run(spark, config).first()
    assert got.words == 3 and got.ur_acc == 1.0
    assert how == "joint" or got.seg_acc == 1.0
    log = spark.read.parquet(str(tmp_path / "out" / "log"))
    assert {r.epoch for r in log.collect()} == {1, 2, 3} and sources.load_weights(spark, str(tmp_path / "out" / "weights"), segmenter).count() > 0


def test_experiment_over_features(spark, tmp_path):
    from lexiforge.operators import experiment

    spark.createDataFrame([("ab (S (a:prefix) (b:stem))",), ("ba (S (b:stem) (a:suffix))",)], "value string").coalesce(1).write.text(str(tmp_path / "train"))
    config = experiment.Config(dev=str(tmp_path / "train"), train=str(tmp_path / "train"), decode="viterbi", iterations=2, t_eta=0.05, extra=1, transducer="features", out=str(tmp_path / "out"))
    got = experiment.run(spark, config).first()
    assert got.words == 2 and 0 <= got.ur_acc <= 1
    log = spark.read.parquet(str(tmp_path / "out" / "log")).where("model = 'transducer'")
    assert {r.epoch for r in log.collect()} == {1, 2} and sources.load_weights(spark, str(tmp_path / "out" / "weights"), "transducer").count() > 0


def test_joint_training_raises_the_likelihood(spark):
    words = spark.createDataFrame([(1, "aab", "ab"), (2, "bab", "bb")], "word_id long, word string, ur_gold string")
    gold = spark.createDataFrame([(1, "ab", 0, 1, 0), (1, "ab", 1, 2, 2), (2, "bb", 0, 2, 2)], "word_id long, ur string, i int, j int, y int")
    scorer = models.TransducerScorer(["", "a", "b"], [""], copy=0.5, change=-0.5, extra=1)
    moved, weights, told = training.joint(words, gold, scorer, training.no_weights(spark), iterations=4, samples=30, eta=0.3, optimizer=AdaGrad(eta=0.5))
    assert told[-1] > told[0] + 0.1 and moved.on("aab").log_likelihood("ab") > scorer.on("aab").log_likelihood("ab") and weights.count() > 0


def test_joint_training_over_features(spark):
    words = spark.createDataFrame([(1, "aab", "ab"), (2, "bab", "bb")], "word_id long, word string, ur_gold string")
    gold = spark.createDataFrame([(1, "ab", 0, 1, 0), (1, "ab", 1, 2, 2), (2, "bb", 0, 2, 2)], "word_id long, ur string, i int, j int, y int")
    model = training.ArcModel.of(words, ["", "a", "b"], [""], width=2)
    arcs, weights, told = training.joint(words, gold, model, training.no_weights(spark), iterations=2, samples=20, optimizer=AdaGrad(eta=0.5), arcs=AdaGrad(eta=0.05), extra=1)
    assert len(told) == 2 and weights.count() > 0 and _likelihood(words, model, arcs) > _likelihood(words, model, arcs.limit(0)) + 0.1


def test_transitions_are_learned(spark):
    """Segments that look alike can only be told by the label before."""
    words = spark.createDataFrame([(k, "aa") for k in range(4)], "word_id long, word string")
    gold = spark.createDataFrame([(k, i, i + 1, y) for k in range(4) for i, y in ((0, 0), (1, 2))], "word_id long, i int, j int, y int")
    features = words.crossJoin(spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "i int, j int")).select("word_id", "i", "j", F.concat(F.lit("length:"), (F.col("j") - F.col("i")).cast("string")).alias("feature"))
    weights, _ = training.train(words, gold, "chunk", iterations=6, optimizer=AdaGrad(eta=1.0), features=features)
    assert {tuple(r.labels) for r in training.segmented(words, features, weights, "chunk").collect()} == {(0, 2)}
    gt0, gt = training.transitions(weights)
    assert gt0[0] > gt0[1] and gt[0][2] > gt[2][0] + 0.1 and gt[0][2] > gt[0][0] + 0.1
