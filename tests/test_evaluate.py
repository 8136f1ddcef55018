import math
from datetime import timedelta

import numpy as np
import pytest
from helpers import START, at, random_readings
from pyspark.sql import functions as F

from fieldflow.operators import evaluate as E


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(2)
    y = (rng.uniform(size=500) < 0.3).astype(int)
    p = np.clip(np.round(0.25 * y + rng.uniform(size=500) * 0.75, 2), 0, 1)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double")
    return df, y, p


def test_auc_counts_pairs(scores):
    df, y, p = scores
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert E.auc_roc(df).first().auc_roc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def counts(y, p, t):
    yes = p >= t
    return ((y == 1) & yes).sum(), ((y == 0) & yes).sum(), ((y == 1) & ~yes).sum(), ((y == 0) & ~yes).sum()


def test_average_precision_is_the_step_sum(scores):
    df, y, p = scores
    total, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, fp, fn, _ = counts(y, p, t)
        total += (tp / (tp + fn) - last) * tp / (tp + fp)
        last = tp / (tp + fn)
    assert E.average_precision(df).first()[0] == pytest.approx(total, abs=1e-12)


def test_sweep_equals_counting_and_first_best_wins(scores):
    df, y, p = scores
    rows = E.threshold_sweep(df).orderBy("threshold").collect()
    assert len(rows) == 33
    for r in rows:
        assert (r.tp, r.fp, r.fn, r.tn) == counts(y, p, r.threshold)
    best = max(rows, key=lambda r: (round(r.f1, 12), -r.threshold))
    assert E.best_threshold(E.threshold_sweep(df)).first().threshold == best.threshold


def test_metrics_drop_equal_thresholds_and_divide_by_zero_safely(spark, scores):
    df, y, p = scores
    rows = E.metrics_at(df, [0.5, 0.5, 2.0]).orderBy("threshold").collect()
    assert [(r.tp, r.fp, r.fn, r.tn) for r in rows] == [counts(y, p, 0.5), counts(y, p, 2.0)]
    assert (rows[1].precision, rows[1].recall, rows[1].f1) == (0.0, 0.0, 0.0)


def test_recall_first_prefers_precision_then_falls_back(scores):
    df, y, p = scores
    row = E.recall_first(df, 0.6).first()
    reach = []
    for t in sorted(set(p)):
        tp, fp, fn, _ = counts(y, p, t)
        if tp / (tp + fn) >= 0.6:
            reach.append((round(tp / (tp + fp), 12), -t))
    assert row.by_recall == -max(reach)[1] and row.default_threshold == row.by_recall
    fallback = E.recall_first(df, 1.1).first()
    assert fallback.by_recall is None and fallback.default_threshold == fallback.by_f1


def test_regression_metrics_clip_at_zero(spark):
    df = spark.createDataFrame([(0.0, -3.0), (2.0, 1.0), (6.0, 4.0)], "actual double, predicted double")
    row = E.regression_metrics(df).first()
    assert (row.n, row.mae) == (3, 1.0)
    assert row.rmse == pytest.approx(np.sqrt(5 / 3)) and row.r2 == pytest.approx(1 - 5 / np.var([0, 2, 6]) / 3)
    bands = {r.rain_band: (r.mae, r.n) for r in E.error_by_band(df).collect()}
    assert bands == {"small": (0.0, 1), "medium": (1.0, 1), "large": (2.0, 1)}


def test_class_balance_floor(spark):
    df = spark.createDataFrame([(1,), (0,), (0,)], "y int")
    row = E.class_balance(df).first()
    assert (row.scale_pos_weight, row.scale_pos_weight_adjusted) == (2.0, 8.5)
    none = E.class_balance(df.where("y = 0")).first()
    assert none.scale_pos_weight == 2.0


def test_splits(spark):
    df = random_readings(spark, 300)
    split = E.time_split(df).toPandas().sort_values("ts")
    held = int(np.ceil(0.15 * len(split)))
    assert split["split"].tolist() == ["train"] * (len(split) - held) + ["validation"] * held
    one, two = [E.stratified_split(df.repartition(n), ["device_id", "ts"]).where("split = 'validation'").count() for n in (2, 7)]
    assert one == two and 0.05 < one / len(split) < 0.25


def test_folds_expand(spark):
    df = spark.createDataFrame([(START + timedelta(days=i),) for i in range(60)], "ts timestamp")
    got = E.time_folds(df).groupBy("fold", "part").count().collect()
    assert {(r.fold, r.part): r["count"] for r in got} == {
        (1, "train"): 45, (1, "test"): 5, (2, "train"): 50, (2, "test"): 5, (3, "train"): 55, (3, "test"): 5,
    }


def test_target_stats(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.4,), (2.0,)], "rain_amount_next_60_mm double")
    row = E.target_stats(df).first()
    assert (row.n, row.min_mm, row.max_mm, row.median_mm, row.nonzero_share) == (4, 0.0, 2.0, 0.2, 0.5)


def test_split_holds_the_share_of_each_class(spark):
    df = spark.createDataFrame([(i, 1 if i % 40 == 0 else 0 if i % 7 else None) for i in range(400)], "k int, y int")
    got = E.stratified_split(df, ["k"], max_rows=50)
    held = {r.y: (r.n, r.held) for r in got.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "validation").alias("held")).collect()}
    assert {y: h for y, (_, h) in held.items()} == {y: math.ceil(0.15 * n) for y, (n, _) in held.items()}
    assert held[1] == (10, 2) and got.count() == 400 and E.empty_classes(got).count() == 0
    assert E.stratified_split(df, ["k"], y=None).where("split = 'validation'").count() == 60
    assert E.empty_classes(got.where("y = 0 or split = 'train'")).count() == 2


def test_rows_without_score_or_label_leave_every_rate(spark):
    rows = [(1, 0.9), (1, None), (0, 0.2), (None, 0.5), (0, float("nan"))]
    df = spark.createDataFrame(rows, "y int, p double")
    assert E.pr_points(df).agg(F.max("recall")).first()[0] == 1.0
    assert E.auc_roc(df).first().auc_roc == 1.0


def test_crowded_scores_split_into_cells(spark):
    scores = [1e-9 * i for i in range(1000)] + [0.5, 1.0]
    counts = spark.createDataFrame([(p, 1, i % 3) for i, p in enumerate(scores)], "p double, pos long, neg long")
    cell = E.score_cell(counts, "p", 100)
    sizes = [r["count"] for r in counts.groupBy(cell.alias("c")).count().collect()]
    assert max(sizes) <= 200
    got = {r.p: r.tp for r in E.curve_of(counts, max_rows=100).collect()}
    assert all(got[p] == len(scores) - i for i, p in enumerate(scores))


def test_forecasts_meet_the_nearest_outcome(spark):
    made = spark.createDataFrame([("d", at(10), 0.7), ("d", at(100), 0.2)], "device_id string, ts timestamp, p double")
    happened = spark.createDataFrame([("d", at(11), 1), ("d", at(14), 0), ("e", at(10), 0)], "device_id string, ts timestamp, y int")
    got = E.match_forecasts(made, happened, 300).collect()
    assert [(r.ts, r.p, r.y) for r in got] == [(at(10), 0.7, 1)]
