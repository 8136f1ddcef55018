import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.models import blocks, rain
from fieldflow.operators import evaluate
from fieldflow.queries import assessing
from fieldflow.queries.assessing import model_matrix


@pytest.fixture(scope="module")
def matrix(spark, sf_dir):
    return model_matrix(spark, sf_dir)


def test_classifier_scores_and_card(spark, matrix):
    model = rain.train_classifier(matrix, K.FEATURE_NAMES, rounds=3, maxDepth=3)
    scored = rain.score_rain(model, matrix, threshold=0.3)
    assert scored.where("p < 0 OR p > 1 OR label <> CAST(p >= 0.3 AS INT)").count() == 0
    card = rain.classifier_card(scored, K.FEATURE_NAMES).first()
    assert json.loads(card.features) == K.FEATURE_NAMES
    assert card.n_samples == card.n_train + card.n_val == matrix.count()
    assert 0.1 <= card.threshold_default <= 0.9 and 0 <= card.auc_roc <= 1
    top = rain.feature_importance(model, K.FEATURE_NAMES, top=5).collect()
    assert len(top) == 5 and [r.gain for r in top] == sorted((r.gain for r in top), reverse=True)


def test_regressor_is_never_negative(spark, matrix):
    model = rain.train_regressor(matrix, K.FEATURE_NAMES, rounds=3, maxDepth=3)
    scored = rain.score_amount(model, matrix)
    assert scored.agg(F.min("predicted")).first()[0] >= 0
    assert rain.regressor_card(scored, K.FEATURE_NAMES).first().n_val > 0


def test_positive_weight(spark, matrix):
    weights = {r.rain_next_60: r.weight for r in rain.add_class_weight(matrix).select("rain_next_60", "weight").distinct().collect()}
    assert weights[0] == 1.0 and weights[1] >= 8.5


def test_rounds_end_by_patience_and_not_at_the_first_small_gain():
    assert rain.best_round([5.0, 4.99, 4.985, 4.99, 4.98, 6.0], patience=3) == 5
    assert rain.best_round([5.0, 6.0, 6.0, 6.0, 1.0], patience=3) == 1
    assert rain.best_round([3.0, 2.0, 1.0], patience=50) == 3


def test_small_gains_do_not_end_a_fit(spark):
    rows = spark.range(600).select(
        (F.col("id") % 20).cast("double").alias("x"),
        F.col("id").cast("double").alias("z"),
        F.when(F.col("id") % 7 == 0, "validation").otherwise("train").alias("split"),
    ).withColumn("rain_amount_next_60_mm", F.col("x") * F.col("x") / 40)
    rows = spark.createDataFrame(rows.collect(), rows.schema).coalesce(1)
    long = rain.train_regressor(rows, ["x", "z"], rounds=12, stepSize=0.001, maxDepth=2)
    assert rain.trees_kept(long) == 12  # each round gains less than 1 %
    short = rain.train_regressor(rows, ["x", "z"], rounds=4, stepSize=0.001, maxDepth=2)
    first = [t.toDebugString.split("\n", 1)[1] for t in long.stages[-1].trees[:4]]
    assert first == [t.toDebugString.split("\n", 1)[1] for t in short.stages[-1].trees]  # so a refit may stand for a cut


def plain_auc(pairs):
    wins = [(a > b) + (a == b) / 2 for a, y in pairs if y == 1 for b, z in pairs if z == 0]
    return sum(wins) / len(wins)


@pytest.fixture(scope="module")
def small(spark):
    """A fit of a few rounds that the training rows and the validation rows judge differently."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3))
    y = (x[:, 0] + 0.4 * x[:, 1] * x[:, 2] + rng.normal(size=700) > 0.8).astype(int)
    part = np.where(np.arange(700) % 4 == 0, "validation", "train")
    rows = [(*map(float, r), int(t), str(s)) for r, t, s in zip(x, y, part)]
    matrix = spark.createDataFrame(rows, "a double, b double, c double, rain_next_60 int, split string").coalesce(1)
    assembler = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    train = assembler.transform(rain.add_class_weight(matrix).where("split = 'train'"))
    booster = GBTClassifier(labelCol="rain_next_60", weightCol="weight", maxIter=12, **{**rain.CLASSIFIER, "maxDepth": 3})
    return matrix, PipelineModel([assembler, booster.fit(train)])


def test_auc_of_every_round_against_all_pairs(small):
    matrix, model = small
    held = matrix.where("split = 'validation'")
    staged = rain.staged_margins(model, held).collect()
    raw = [r[0] for r in rain.score_rain(model, held).select("p").collect()]
    assert np.allclose([1 / (1 + np.exp(-2 * r.margins[-1])) for r in staged], raw)
    want = [plain_auc([(r.margins[k], r.rain_next_60) for r in staged]) for k in range(12)]
    got = rain.auc_per_round(model, held, "rain_next_60")
    assert np.allclose(got, want)


def test_the_round_with_the_best_auc_is_kept(small, monkeypatch):
    matrix, whole = small
    aucs = rain.auc_per_round(whole, matrix.where("split = 'validation'"), "rain_next_60")
    for patience in (1, 2, 50):
        monkeypatch.setattr(rain, "CLASSIFIER_PATIENCE", patience)
        model = rain.train_classifier(matrix, ["a", "b", "c"], rounds=12, maxDepth=3)
        assert rain.trees_kept(model) == rain.best_round([-a for a in aucs], patience)


def test_gain_against_a_walk_of_the_trees(small):
    _, model = small
    splits = {}

    def walk(node):
        if node.numDescendants():
            stats = node.impurityStats().stats()
            splits.setdefault(node.split().featureIndex(), []).append(node.gain() * stats[0])
            walk(node.leftChild())
            walk(node.rightChild())

    for tree in model.stages[-1]._java_obj.trees():
        walk(tree.rootNode())
    want = {n: float(np.mean(splits[i])) if i in splits else 0.0 for i, n in enumerate("abc")}
    got = {r.feature: r.gain for r in rain.feature_importance(model, ["a", "b", "c"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)


def test_cards_tell_the_trees_kept(spark, matrix):
    model = rain.train_regressor(matrix, K.FEATURE_NAMES, rounds=3, maxDepth=3)
    card = rain.regressor_card(rain.score_amount(model, matrix), K.FEATURE_NAMES, n_trees=rain.trees_kept(model)).first()
    assert 1 <= card.n_trees == model.stages[-1].getNumTrees <= 3


def test_a_fit_asks_for_no_more_rounds_than_a_stop_needs(small, monkeypatch):
    matrix, _ = small
    asked = []
    for kind in (rain.GBTClassifier, rain.GBTRegressor):
        monkeypatch.setattr(kind, "fit", lambda self, rows, fit=kind.fit: asked.append(self.getMaxIter()) or fit(self, rows))
    monkeypatch.setattr(rain, "CLASSIFIER_PATIENCE", 2)
    monkeypatch.setattr(rain, "auc_per_round", lambda model, *_: [1.0, *[0.5] * (len(model.stages[-1].treeWeights) - 1)])
    assert rain.trees_kept(rain.train_classifier(matrix, ["a", "b", "c"], rounds=12, maxDepth=2)) == 1
    assert asked == [3, 1]
    asked.clear()
    monkeypatch.setattr(rain, "REGRESSOR_PATIENCE", 4)
    monkeypatch.setattr(rain, "best_round", lambda losses, patience: min(3, len(losses)))
    amounts = matrix.withColumn("rain_amount_next_60_mm", F.abs("a"))
    assert rain.trees_kept(rain.train_regressor(amounts, ["a", "b", "c"], rounds=40, maxDepth=2)) == 3
    assert asked == [6, 7, 3]


def test_the_next_lot_ends_patience_or_goes_on():
    assert rain.next_rounds(101, 40, 80, 800) == 120
    assert rain.next_rounds(101, 90, 80, 800) == 404
    assert rain.next_rounds(404, 400, 80, 800) == 800


def test_many_rows_are_dealt_to_even_tasks(spark, monkeypatch):
    rows = spark.range(700).coalesce(1)
    assert rain.deal_evenly(rows).rdd.getNumPartitions() == 1
    monkeypatch.setattr(rain, "TASK_ROWS", 60)
    sizes = [len(part) for part in rain.deal_evenly(rows).rdd.glom().collect()]
    assert len(sizes) % spark.sparkContext.defaultParallelism == 0 and sum(sizes) == 700
    assert max(sizes) <= 60


def test_both_models_of_an_application_share_one_matrix(spark, monkeypatch):
    made = []
    monkeypatch.setattr(assessing, "_FITTED", {})
    monkeypatch.setattr(assessing, "model_matrix", lambda *_: made.append(1) or len(made))
    assert [assessing._fitted(spark, "tables", kind, lambda m: m) for kind in ("a", "b", "a")] == [1, 1, 1]
    assert made == [1]


@pytest.fixture(scope="module")
def weighted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    x[:, 2], x[:, 3] = np.round(x[:, 2]), 1.0  # few values, one value
    y = (x[:, 0] + 0.4 * x[:, 1] * x[:, 2] + rng.normal(size=3000) > 0.8).astype(int)
    rows = [(*map(float, r), int(t), 2.5 if t else 1.0, float(abs(r[0] * r[1]) * t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y int, w double, mm double").repartition(3).cache()


def whole_trees(spark, model, path):
    model.write().overwrite().save(str(path))
    return spark.read.parquet(f"{path}/data").orderBy("treeID", "nodeData.id").select("treeID", "nodeData.*").collect()


@pytest.mark.parametrize("kind, columns", [(GBTClassifier, dict(labelCol="y", weightCol="w")), (GBTRegressor, dict(labelCol="mm"))])
def test_blocks_grow_the_trees_of_spark_ml(spark, weighted, tmp_path, monkeypatch, kind, columns):
    """Without draws every node is the same: split, threshold, prediction, impurity, gain, sums and counts."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 700)
    monkeypatch.setattr(blocks, "LINEAGE_ROUNDS", 3)
    names = ["a", "b", "c", "d"]
    booster = kind(maxIter=8, maxDepth=4, stepSize=0.3, seed=42, **columns)
    want = booster.fit(VectorAssembler(inputCols=names, outputCol="features").transform(weighted))
    fit = blocks.BlockFit(booster, weighted, names)
    for rounds in (8, 3):
        got = fit.model(rounds)
        assert type(got) is type(want) and got.treeWeights == want.treeWeights[:rounds]
        assert got.getMaxIter() == got.getNumTrees == rounds and got.numFeatures == 4
        pairs = list(zip(whole_trees(spark, got, tmp_path / "got"), whole_trees(spark, want, tmp_path / "want")))
        assert {r.treeID for r, _ in pairs} == set(range(rounds))
        for g, w in pairs:
            assert (g.treeID, g.id, g.leftChild, g.rightChild, g.split.featureIndex) == (w.treeID, w.id, w.leftChild, w.rightChild, w.split.featureIndex)
            numbers = lambda n: [n.prediction, n.gain, n.rawCount, *n.impurityStats, *n.split.leftCategoriesOrThreshold]
            assert np.allclose(numbers(g), numbers(w), rtol=1e-7, atol=1e-9)
            assert np.isclose(g.impurity, w.impurity, atol=1e-9) or w.impurity == -1  # Spark ML's for "no valid split"
    fit.close()


def test_many_rows_are_fitted_on_blocks_and_rounds_are_grown_once(small, monkeypatch):
    matrix, _ = small
    grown = []
    grow = blocks.BlockFit._grow
    monkeypatch.setattr(blocks.BlockFit, "_grow", lambda self: grown.append(1) or grow(self))
    monkeypatch.setattr(rain, "BLOCK_FIT_ROWS", 1)
    for kind in (rain.GBTClassifier, rain.GBTRegressor):
        monkeypatch.setattr(kind, "fit", lambda *_: pytest.fail("Spark ML's fit was called"))
    monkeypatch.setattr(rain, "CLASSIFIER_PATIENCE", 4)
    model = rain.train_classifier(matrix, ["a", "b", "c"], rounds=12, maxDepth=3)
    aucs = rain.auc_per_round(model, matrix.where("split = 'validation'"), "rain_next_60")
    assert rain.trees_kept(model) == np.argmax(aucs) + 1 and 0 < len(grown) <= 12
    assert aucs[-1] > 0.6
    grown.clear()
    monkeypatch.setattr(rain, "REGRESSOR_PATIENCE", 4)
    monkeypatch.setattr(rain, "best_round", lambda losses, patience: min(3, len(losses)))
    amounts = matrix.withColumn("rain_amount_next_60_mm", F.abs("a"))
    assert rain.trees_kept(rain.train_regressor(amounts, ["a", "b", "c"], rounds=40, maxDepth=2)) == 3
    assert len(grown) == 7  # 6, then one more; the model of 3 is a cut


def test_draws_of_blocks_have_their_shares(spark, weighted):
    booster = GBTClassifier(labelCol="y", weightCol="w", maxIter=3, **{**rain.CLASSIFIER, "maxDepth": 2})
    fit = blocks.BlockFit(booster, weighted, ["a", "b", "c", "d"])
    fit.model(3)
    counts = [tree.stats[0, 0] for tree in fit.trees]
    assert all(abs(n - 0.8 * 3000) < 150 for n in counts) and len(set(counts)) > 1
    assert blocks.features_per_node("0.8", 13) == 11
    again = blocks.BlockFit(booster, weighted, ["a", "b", "c", "d"])
    again.model(3)
    assert all(np.array_equal(a.feature, b.feature) and np.allclose(a.value, b.value) for a, b in zip(fit.trees, again.trees))
    fit.close(), again.close()


def test_blocks_refuse_missing_values(spark, weighted):
    booster = GBTRegressor(labelCol="mm", maxIter=2)
    gap = weighted.withColumn("b", F.when(F.col("a") > 0, F.col("b")))
    with pytest.raises(Exception, match="null or NaN"):
        blocks.BlockFit(booster, gap, ["a", "b"])


def test_other_settings_stay_with_spark_ml():
    assert blocks.handles(GBTClassifier(**rain.CLASSIFIER)) and blocks.handles(GBTRegressor(**rain.REGRESSOR))
    assert not blocks.handles(GBTRegressor(minInstancesPerNode=5)) and not blocks.handles(GBTRegressor(lossType="absolute"))


def test_auc_of_each_position_over_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    scores = np.column_stack([rng.integers(0, 4, 400) / 4, rng.normal(size=400), np.zeros(400)])
    labels = (rng.random(400) < 0.3).astype(int)
    rows = [(int(t), [None if i == 1 and n % 50 == 0 else float(v) for i, v in enumerate(r)]) for n, (t, r) in enumerate(zip(labels, scores))]
    df = spark.createDataFrame([*rows, (None, [1.0, 1.0, 1.0]), (1, [float("nan")] * 3)], "y int, scores array<double>").repartition(3)
    monkeypatch.setattr(evaluate, "POSITION_CELL", 30)
    monkeypatch.setattr(evaluate, "POSITION_ROWS", 17)
    got = evaluate.auc_per_position(df, df.limit(90), 402, 3)
    want = [plain_auc([(r[i], t) for t, r in rows if r[i] is not None]) for i in range(3)]
    assert np.allclose(got, want)
    assert evaluate.auc_per_position(df.where("y = 1"), df, 402, 3) == [None] * 3
