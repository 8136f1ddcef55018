"""Rain classifier and amount regressor with Spark ML boosted trees."""

from __future__ import annotations

import json
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldflow.models.blocks import BlockFit, handles
from fieldflow.operators import evaluate as E
from fieldflow.session import cut_lineage, scratch

CLASSIFIER = dict(maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
REGRESSOR = dict(maxDepth=6, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)
# Rounds without a better validation AUC (classifier) or squared error (regressor) after which boosting counts as ended.
CLASSIFIER_PATIENCE = 50
REGRESSOR_PATIENCE = 80
# A fit reads its rows some seven times a round: more rows than these are dealt to even tasks of at most as many.
TASK_ROWS = 250_000
# From as many training rows on, trees are grown on blocks of binned rows, by Spark ML's method.
BLOCK_FIT_ROWS = 1_000_000


def add_class_weight(matrix: DataFrame, target: str = "rain_next_60", conservative: bool = True) -> DataFrame:
    """Weight of positives: neg/pos, or with ``conservative`` max(8.5, 1.2 neg/pos)."""
    balance = E.class_balance(matrix.where("split = 'train'"), target)
    weight = balance.select("scale_pos_weight_adjusted" if conservative else "scale_pos_weight").scalar()
    return matrix.withColumn("weight", F.when(F.col(target) == 1, weight).otherwise(F.lit(1.0)))


def best_round(losses: list[float], patience: int) -> int:
    """Rounds to keep: up to the lowest loss seen before ``patience`` rounds in a row bring no lower one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def tree_nodes(model: PipelineModel) -> DataFrame:
    """One row per node of a boosted model: tree, node (in preorder), feature (position, null at leaves), gain, n, prediction.

    ``gain`` is what the split takes off the squared error of the rows it sees (weights counted), ``n`` their number.
    """
    booster = model.stages[-1]
    path = scratch(_session(), "trees")
    booster.save(path)
    node = F.col("nodeData")
    inner = node["leftChild"] >= 0
    return _session().read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"),
        F.when(inner, node["gain"] * node["impurityStats"][0]).alias("gain"),
        node["rawCount"].alias("n"),
        node["prediction"].alias("prediction"),
    )


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()


def staged_margins(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``margins``: what the trees of the first 1, 2, ... rounds add up to, all from one pass.

    A row's leaf in each tree is the model's own; the value of a leaf is looked up in a table of all leaves, which
    has at most 2^depth numbers per tree.
    """
    booster = model.stages[-1].copy().setLeafCol("leaves")
    weights = booster.treeWeights
    leaves: list[list[float]] = [[] for _ in weights]
    for r in tree_nodes(model).where("feature is null").orderBy("tree", "node").collect():  # bounded by rounds and depth
        leaves[r.tree].append(r.prediction * weights[r.tree])
    table = np.zeros((len(leaves), max(map(len, leaves))))
    for i, values in enumerate(leaves):
        table[i, : len(values)] = values

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def running(found: pa.Array) -> pa.Array:
        at = found.flatten().to_numpy().astype(np.int64).reshape(-1, len(table))
        sums = np.cumsum(table[np.arange(len(table)), at], axis=1)
        offsets = np.arange(len(at) + 1, dtype=np.int32) * len(table)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))

    assembled = PipelineModel(model.stages[:-1]).transform(rows)
    scored = booster.transform(assembled).withColumn("margins", running(vector_to_array("leaves")))
    return scored.select(*rows.columns, "margins")


def auc_per_round(model: PipelineModel, rows: DataFrame, target: str, since: int = 0) -> list[float]:
    """AUC on ``rows`` with the trees of the first 1, 2, ... rounds, all from one pass; without the first ``since`` of them."""
    rounds, total = len(model.stages[-1].treeWeights) - since, rows.count()
    margins = F.slice("margins", since + 1, rounds).alias("scores")
    staged = lambda of: staged_margins(model, of).select(F.col(target).alias("y"), margins)
    some = staged(rows.sample(False, min(1.0, 20_000 / max(total, 1)), 42))
    return [auc or 0.0 for auc in E.auc_per_position(staged(rows), some, total, rounds)]


def deal_evenly(train: DataFrame) -> DataFrame:
    """``train`` in as many equal tasks for each slot; files pack into one task more than there are slots, which all others wait for."""
    rows, slots = train.count(), train.sparkSession.sparkContext.defaultParallelism
    return train if rows <= TASK_ROWS else train.repartition(slots * -(-rows // (slots * TASK_ROWS)))


def next_rounds(fitted: int, kept: int, patience: int, rounds: int) -> int:
    """Rounds of the fit after one of ``fitted`` rounds whose best was ``kept`` and whose patience had not run out.

    Long without a better round: just enough to end patience there. Still getting better: four times as many.
    """
    return min(kept + patience if 2 * kept <= fitted else 4 * fitted, rounds)


@contextmanager
def fitting(booster, assembler, train: DataFrame):
    """Fits of the booster by their number of rounds. ``train`` holds the features by name, the target and any weight."""
    names, columns = assembler.getInputCols(), [c for c in train.columns if c not in assembler.getInputCols()]
    if handles(booster) and train.count() >= BLOCK_FIT_ROWS:
        blocks = BlockFit(booster, train, names)
        yield blocks.model
        blocks.close()
        return
    rows = deal_evenly(cut_lineage(assembler.transform(train).select("features", *columns), "train"))
    yield lambda rounds: booster.copy({booster.maxIter: rounds}).fit(rows)


def _boost(fit, assembler, rounds: int, patience: int, losses, spare: int = 0) -> PipelineModel:
    """Fits (at first as many rounds as a stop at once needs and ``spare`` more) until ``patience`` rounds in a row bring no lower loss, and the model of the best round.

    A seeded fit only appends trees, so a fit of more rounds goes on from one of fewer, and one of fewer stands for a cut.
    ``losses`` gets the losses of the rounds that it has judged before.
    """
    fitted, found = min(patience + 1 + spare, rounds), []
    while True:
        model = PipelineModel([assembler, fit(fitted)])
        found = losses(model, found)
        kept = best_round(found, patience)
        if kept == fitted == rounds:
            return model
        if fitted == rounds or fitted - kept >= patience:
            return PipelineModel([assembler, fit(kept)])
        fitted = next_rounds(fitted, kept, patience, rounds)


def train_classifier(matrix: DataFrame, names: list[str], target: str = "rain_next_60", rounds: int = 200, **params) -> PipelineModel:
    """``matrix`` holds the features, the target and ``split``.

    Rounds are fitted until the AUC on the validation rows has not risen for as many as patience allows, and the best
    round up to there is kept. Without validation rows of both classes all rounds stay.
    """
    booster = GBTClassifier(labelCol=target, weightCol="weight", maxIter=rounds, **{**CLASSIFIER, **params})
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    rows = add_class_weight(matrix, target)
    held = rows.where("split = 'validation'")
    judged = lambda model, known: known + [-auc for auc in auc_per_round(model, held, target, len(known))]
    with fitting(booster, assembler, rows.where("split = 'train'").select(*names, target, "weight")) as fit:
        if held.select(target).distinct().count() < 2:
            return PipelineModel([assembler, fit(rounds)])
        return _boost(fit, assembler, rounds, CLASSIFIER_PATIENCE, judged)


def train_regressor(
    matrix: DataFrame, names: list[str], target: str = "rain_amount_next_60_mm", rounds: int = 800, **params
) -> PipelineModel:
    """As the classifier, by squared error."""
    booster = GBTRegressor(labelCol=target, maxIter=rounds, **{**REGRESSOR, **params})
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    clipped = matrix.withColumn(target, F.greatest(F.col(target), F.lit(0.0))).select(*names, target, "split")
    held = cut_lineage(assembler.transform(clipped.where("split = 'validation'")).select("features", target), "validation")
    squared = lambda model, _: model.stages[-1].evaluateEachIteration(held, "squared")
    with fitting(booster, assembler, clipped.where("split = 'train'").drop("split")) as fit:
        if held.isEmpty():
            return PipelineModel([assembler, fit(rounds)])
        return _boost(fit, assembler, rounds, REGRESSOR_PATIENCE, squared, spare=REGRESSOR_PATIENCE // 4)


def trees_kept(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def score_rain(model: PipelineModel, features: DataFrame, threshold: float = 0.5) -> DataFrame:
    scored = model.transform(features)
    p = vector_to_array("probability")[1]
    return scored.withColumn("p", p).withColumn("label", (F.col("p") >= threshold).cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def score_at_best(model: PipelineModel, matrix: DataFrame, target: str = "rain_next_60") -> DataFrame:
    """Scores of all rows, labelled at the threshold with the best F1 on the validation part; it stays as ``threshold``."""
    scored = score_rain(model, matrix).drop("label")
    held = scored.where("split = 'validation'").select(F.col(target).alias("y"), "p")
    best = E.best_threshold(E.threshold_sweep(held)).first()  # one row
    scored = scored.withColumn("threshold", F.lit(best.threshold))
    return scored.withColumn("label", (F.col("p") >= F.col("threshold")).cast("int"))


def score_amount(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Predicted millimetres, never below 0."""
    return (
        model.transform(features)
        .withColumn("predicted", F.greatest(F.col("prediction"), F.lit(0.0)))
        .drop("features", "prediction")
    )


def slot_scorer(classifier: PipelineModel, regressor: PipelineModel | None = None):
    """Fitted models as a scoring function over feature rows: adds ``probability`` and ``rain_amount_mm``."""

    def score(features: DataFrame) -> DataFrame:
        scored = score_rain(classifier, features).withColumnRenamed("p", "probability").drop("label")
        if regressor is None:
            return scored
        return score_amount(regressor, scored).withColumnRenamed("predicted", "rain_amount_mm")

    return score


def feature_importance(model: PipelineModel, names: list[str], top: int = 20) -> DataFrame:
    """Features by the mean gain of the splits that use them; 0 for those that no split uses."""
    gains = tree_nodes(model).where("feature is not null").groupBy("feature").agg(F.avg("gain").alias("gain"))
    named = _session().createDataFrame(list(enumerate(names)), "feature int, name string")
    joined = named.join(gains, "feature", "left")
    return joined.select(F.col("name").alias("feature"), F.coalesce("gain", F.lit(0.0)).alias("gain")).orderBy(F.desc("gain"), "feature").limit(top)


def classifier_card(
    scored: DataFrame, names: list[str], target: str = "rain_next_60", params: dict | None = None, n_trees: int | None = None
) -> DataFrame:
    """One row of metadata: features, settings, best threshold, validation metrics and counts.

    ``scored`` holds ``p``, the target and ``split`` for all rows.
    """
    held = scored.where("split = 'validation'").select(F.col(target).alias("y"), "p")
    at_half = E.metrics_at(held, [0.5])
    best = E.best_threshold(E.threshold_sweep(held))
    return scored.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum((F.col("split") == "train").cast("bigint")).alias("n_train"),
        F.sum((F.col("split") == "validation").cast("bigint")).alias("n_val"),
        F.avg(F.col(target)).alias("positive_rate"),
    ).select(
        F.lit(json.dumps(names)).alias("features"),
        F.lit(json.dumps(params or CLASSIFIER)).alias("hyperparameters"),
        F.lit(n_trees).cast("int").alias("n_trees"),
        best.select("threshold").scalar().alias("threshold_default"),
        E.auc_roc(held).select("auc_roc").scalar().alias("auc_roc"),
        E.average_precision(held).select("average_precision").scalar().alias("pr_auc"),
        *[at_half.select(c).scalar().alias(c) for c in ("precision", "recall", "f1")],
        "n_samples",
        "n_train",
        "n_val",
        "positive_rate",
    )


def regressor_card(
    scored: DataFrame, names: list[str], target: str = "rain_amount_next_60_mm", params: dict | None = None, n_trees: int | None = None
) -> DataFrame:
    held = scored.where("split = 'validation'").select(F.col(target).alias("actual"), "predicted")
    metrics = E.regression_metrics(held)
    return scored.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum((F.col("split") == "train").cast("bigint")).alias("n_train"),
        F.sum((F.col("split") == "validation").cast("bigint")).alias("n_val"),
        F.avg(F.col(target)).alias("target_mean"),
        F.max(F.col(target)).alias("target_max"),
    ).select(
        F.lit(json.dumps(names)).alias("features"),
        F.lit(json.dumps(params or REGRESSOR)).alias("hyperparameters"),
        F.lit(n_trees).cast("int").alias("n_trees"),
        *[metrics.select(c).scalar().alias(c) for c in ("mae", "rmse", "r2")],
        "n_samples",
        "n_train",
        "n_val",
        "target_mean",
        "target_max",
    )
