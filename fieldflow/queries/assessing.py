"""Profiles, evaluation, splits and models."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.models import rain
from fieldflow.operators import clean, evaluate, features, joins
from fieldflow.operators.ordered import fit_cell_seconds, row_index
from fieldflow.queries.inputs import rain_labels, scored, weather_joined
from fieldflow.queries.registry import query
from fieldflow.session import cut_lineage
from fieldflow.sources import adapter

TH = ", ".join(f"({t!r}e0)" for t in evaluate.SWEEP)
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END"
PREC = "CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END"
REC = "CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END"
ACC = "(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)"
METRICS = f"threshold, {ACC} AS accuracy, {PREC} AS precision, {REC} AS recall, {F1} AS f1, tp, fp, tn, fn"
COUNTS = """sum(CASE WHEN y = 1 AND p >= threshold THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p >= threshold THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND p < threshold THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 0 AND p < threshold THEN 1 ELSE 0 END) AS tn"""
CURVE = f"""points AS (SELECT threshold, {PREC} AS precision, {REC} AS recall FROM (
  SELECT t.p AS threshold, {COUNTS.replace('threshold', 't.p').replace('y =', 's.y =').replace(' p ', ' s.p ')}
  FROM (SELECT DISTINCT p FROM scored) t CROSS JOIN scored s GROUP BY t.p)),
curve AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM points)"""
METRIC_COLUMNS = "threshold:d accuracy:d precision:d recall:d f1:d tp:i fp:i tn:i fn:i"


@query(
    "device_id:s n:i median_seconds:d sparse:b",
    """WITH g AS (SELECT device_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY device_id ORDER BY ts)) AS gap FROM sensor)
    SELECT device_id, count(*) AS n, median(gap) / 1e6 AS median_seconds, median(gap) / 1e6 > 20 AS sparse FROM g WHERE gap > 0 GROUP BY 1""",
    "sensor",
)
def sampling_interval(spark, d):
    return clean.sampling_interval(adapter.sensor_reading(spark, d))


@query(
    "table_name:s n:i first_ts:t last_ts:t",
    """SELECT 'sensor' AS table_name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM sensor
    UNION ALL SELECT 'weather', count(*), min(ts), max(ts) FROM weather""",
    "sensor weather",
)
def table_profile(spark, d):
    return clean.time_profile({"sensor": adapter.sensor_reading(spark, d), "weather": adapter.weather_hour(spark, d)})


@query(
    "pos:i neg:i scale_pos_weight:d scale_pos_weight_adjusted:d",
    """SELECT pos, neg, neg / CAST(greatest(pos, 1) AS DOUBLE) AS scale_pos_weight, greatest(8.5e0, 1.2e0 * neg / greatest(pos, 1)) AS scale_pos_weight_adjusted
    FROM (SELECT sum(rain_next_60) AS pos, sum(1 - rain_next_60) AS neg FROM labels)""",
    "sensor weather labels",
)
def class_balance(spark, d):
    return evaluate.class_balance(rain_labels(spark, d), "rain_next_60")


@query(
    "n:i min_mm:d max_mm:d mean_mm:d median_mm:d nonzero_share:d",
    """SELECT count(*) AS n, min(v) AS min_mm, max(v) AS max_mm, avg(v) AS mean_mm, median(v) AS median_mm,
      avg(CASE WHEN v > 0 THEN 1e0 ELSE 0e0 END) AS nonzero_share FROM (SELECT greatest(rain_amount_next_60_mm, 0e0) AS v FROM labels)""",
    "sensor weather labels",
)
def target_stats(spark, d):
    return evaluate.target_stats(rain_labels(spark, d))


@query(
    "duplicates:i distinct_keys:i",
    """SELECT sum(c - 1) AS duplicates, count(*) AS distinct_keys FROM (SELECT count(*) AS c FROM
      (SELECT device_id, ts FROM sensor UNION ALL SELECT device_id, ts FROM sensor WHERE event_type = 'click') GROUP BY device_id, ts)""",
    "sensor",
)
def duplicate_keys(spark, d):
    k = adapter.keyed_sensor(spark, d)
    return clean.duplicate_count(k.unionByName(k.where("event_type = 'click'")))


MERGE_SQL = """SELECT device_id, ts, temp_c, source FROM (
  SELECT *, row_number() OVER (PARTITION BY device_id, ts ORDER BY priority DESC, event_id DESC) AS r FROM (
    SELECT device_id, ts, event_id, temp_c, 'old' AS source, 0 AS priority FROM sensor WHERE event_type <> 'view'
    UNION ALL SELECT device_id, ts, event_id, temp_c + 1, 'new', 1 FROM sensor WHERE event_type IN ('view', 'click'))) WHERE r = 1"""


@query("device_id:s ts:t temp_c:d source:s", MERGE_SQL, "sensor")
def merge_keep_last(spark, d):
    k = adapter.keyed_sensor(spark, d).select("device_id", "ts", "event_id", "event_type", "temp_c")
    old = k.where("event_type <> 'view'").withColumn("source", F.lit("old"))
    new = k.where(F.col("event_type").isin("view", "click")).withColumns(
        {"temp_c": F.col("temp_c") + 1, "source": F.lit("new")}
    )
    return clean.keep_last([old, new], recency=["event_id"])


@query(
    "ts:t api_pop:d source:s",
    """SELECT ts, api_pop, source FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY priority DESC) AS r FROM (
      SELECT ts, api_pop, 'old' AS source, 0 AS priority FROM weather WHERE hour(ts) < 18
      UNION ALL SELECT ts, api_pop / 2, 'new', 1 FROM weather WHERE hour(ts) >= 12)) WHERE r = 1""",
    "weather",
)
def weather_merge(spark, d):
    w = adapter.weather_hour(spark, d)
    old = w.where(F.hour("ts") < 18).withColumn("source", F.lit("old"))
    new = w.where(F.hour("ts") >= 12).withColumns({"api_pop": F.col("api_pop") / 2, "source": F.lit("new")})
    return clean.keep_last([old, new], keys=["ts"])


# --- scores ----------------------------------------------------------------------------------------


@query(
    METRIC_COLUMNS,
    f"""WITH {CURVE}, best AS (SELECT threshold FROM curve ORDER BY round(f1, 12) DESC, threshold LIMIT 1),
    th AS (SELECT 0.5e0 AS threshold UNION SELECT 0.675e0 UNION SELECT threshold FROM best)
    SELECT {METRICS} FROM (SELECT threshold, {COUNTS} FROM th CROSS JOIN scored GROUP BY threshold)""",
    "sensor scored",
)
def confusion_metrics(spark, d):
    s = scored(spark, d)
    return evaluate.metrics_at(s, [0.5, 0.675, evaluate.best_f1(s).select("threshold").scalar()])


@query(
    "auc_roc:d positives:i negatives:i",
    """SELECT (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - pos * (pos + 1) / 2e0) / (pos * neg) AS auc_roc, pos AS positives, neg AS negatives FROM (
      SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r,
        sum(y) OVER () AS pos, sum(1 - y) OVER () AS neg FROM scored) GROUP BY pos, neg""",
    "sensor scored",
)
def auc_roc(spark, d):
    return evaluate.auc_roc(scored(spark, d))


@query(
    "average_precision:d",
    f"""WITH {CURVE}, steps AS (SELECT precision, recall - coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS step FROM curve)
    SELECT sum(precision * step) AS average_precision FROM steps""",
    "sensor scored",
)
def avg_precision(spark, d):
    return evaluate.average_precision(scored(spark, d))


@query(
    METRIC_COLUMNS,
    f"SELECT {METRICS} FROM (SELECT threshold, {COUNTS} FROM (VALUES {TH}) AS t(threshold) CROSS JOIN scored GROUP BY threshold)",
    "sensor scored",
)
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(scored(spark, d))


@query(
    "threshold:d f1:d",
    f"""SELECT threshold, {F1} AS f1 FROM (SELECT threshold, {COUNTS} FROM (VALUES {TH}) AS t(threshold) CROSS JOIN scored GROUP BY threshold)
    ORDER BY round({F1}, 12) DESC, threshold LIMIT 1""",
    "sensor scored",
)
def sweep_best(spark, d):
    return evaluate.best_threshold(evaluate.threshold_sweep(scored(spark, d)))


@query(
    "threshold:d precision:d recall:d f1:d",
    f"WITH {CURVE} SELECT * FROM curve ORDER BY round(f1, 12) DESC, threshold LIMIT 1",
    "sensor scored",
)
def pr_curve_best(spark, d):
    return evaluate.best_f1(scored(spark, d))


@query(
    "by_recall:d by_f1:d default_threshold:d",
    f"""WITH {CURVE}, a AS (SELECT threshold FROM curve WHERE recall >= 0.6 ORDER BY round(precision, 12) DESC, threshold LIMIT 1),
    b AS (SELECT threshold FROM curve ORDER BY round(f1, 12) DESC, threshold LIMIT 1)
    SELECT (SELECT threshold FROM a) AS by_recall, (SELECT threshold FROM b) AS by_f1,
      coalesce((SELECT threshold FROM a), (SELECT threshold FROM b), 0.5e0) AS default_threshold""",
    "sensor scored",
)
def recall_first_threshold(spark, d):
    return evaluate.recall_first(scored(spark, d))


@query(
    "label:s precision:d recall:d f1:d support:i",
    f"""WITH c AS (SELECT {COUNTS.replace('threshold', '0.5e0')} FROM scored),
    k AS (SELECT '1' AS label, tp, fp, fn, tp + fn AS support FROM c UNION ALL SELECT '0', tn, fn, fp, tn + fp FROM c),
    m AS (SELECT label, {PREC} AS precision, {REC} AS recall, {F1} AS f1, support FROM k)
    SELECT * FROM m UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m""",
    "sensor scored",
)
def class_report(spark, d):
    return evaluate.class_report(scored(spark, d))


AMOUNTS = "amounts AS (SELECT l.rain_amount_next_60_mm AS actual, (s.rh_pct - 60) / 20e0 AS predicted FROM labels l JOIN sensor s ON s.event_id = l.event_id)"
CLIPPED = f"{AMOUNTS}, c AS (SELECT greatest(actual, 0e0) AS a, greatest(predicted, 0e0) AS p FROM amounts)"


def amounts(spark, d):
    """A fixed linear amount model, so that both engines predict alike."""
    return joins.join_labels(adapter.sensor_reading(spark, d), rain_labels(spark, d), "rain_amount_next_60_mm").select(
        F.col("rain_amount_next_60_mm").alias("actual"), ((F.col("rh_pct") - 60) / 20).alias("predicted")
    )


@query(
    "n:i mae:d rmse:d r2:d",
    f"""WITH {CLIPPED}, t AS (SELECT avg(a) AS mean FROM c)
    SELECT count(*) AS n, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, 1 - sum((a - p) * (a - p)) / sum((a - t.mean) * (a - t.mean)) AS r2 FROM c CROSS JOIN t""",
    "sensor weather labels",
)
def regression_metrics(spark, d):
    return evaluate.regression_metrics(amounts(spark, d))


@query(
    "rain_band:s mae:d n:i",
    f"WITH {CLIPPED} SELECT CASE WHEN a < 2 THEN 'small' WHEN a < 5 THEN 'medium' ELSE 'large' END AS rain_band, avg(abs(a - p)) AS mae, count(*) AS n FROM c GROUP BY 1",
    "sensor weather labels",
)
def error_by_band(spark, d):
    return evaluate.error_by_band(amounts(spark, d))


TIME_SPLIT = """split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, device_id) <= count(*) OVER () - ceil(0.15e0 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM scored)"""


@query(
    "device_id:s ts:t y:i split:s", f"WITH {TIME_SPLIT} SELECT device_id, ts, y, split FROM split", "sensor scored"
)
def time_split(spark, d):
    return evaluate.time_split(scored(spark, d))


@query(
    "prevalence:d validation_prevalence:d positives:i n:i all_zero_f1:d",
    f"""WITH {TIME_SPLIT} SELECT avg(y) AS prevalence, avg(CASE WHEN split = 'validation' THEN y END) AS validation_prevalence,
      sum(y) AS positives, count(*) AS n, 0e0 AS all_zero_f1 FROM split""",
    "sensor scored",
)
def prevalence(spark, d):
    return evaluate.prevalence(evaluate.time_split(scored(spark, d)))


@query(
    "device_id:s us:i y:i split:s",
    """SELECT device_id, us, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY digest, device_id, us)
        <= ceil(0.15e0 * count(*) OVER (PARTITION BY y)) THEN 'validation' ELSE 'train' END AS split
      FROM (SELECT *, epoch_us(ts) AS us, CAST('0x' || substr(md5(device_id || '|' || CAST(epoch_us(ts) AS VARCHAR)), 1, 8) AS BIGINT) AS digest FROM scored)""",
    "sensor scored",
)
def stratified_split(spark, d):
    keyed = scored(spark, d).withColumn("us", F.unix_micros("ts"))
    return evaluate.stratified_split(keyed, ["device_id", "us"])


FOLDS = ((20, 23), (23, 26), (26, 30))


@query(
    "fold:i part:s n:i positives:i f1:d",
    f"""WITH d AS (SELECT *, date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM scored), CAST(ts AS DATE)) + 1 AS day FROM scored),
    f AS (SELECT d.*, v.fold, CASE WHEN day <= v.a THEN 'train' ELSE 'test' END AS part FROM d JOIN (VALUES (1, 20, 23), (2, 23, 26), (3, 26, 30)) AS v(fold, a, b) ON d.day <= v.b),
    c AS (SELECT fold, part, count(*) AS n, sum(y) AS positives, {COUNTS.replace('threshold', '0.5e0')} FROM f GROUP BY 1, 2)
    SELECT fold, part, n, positives, {F1} AS f1 FROM c""",
    "sensor scored",
)
def time_folds(spark, d):
    return evaluate.fold_metrics(evaluate.time_folds(scored(spark, d), FOLDS))


@query(
    "fold:i part:s auc_roc:d average_precision:d positives:i negatives:i",
    """WITH d AS (SELECT *, datediff('day', CAST((SELECT min(ts) FROM scored) AS DATE), CAST(ts AS DATE)) + 1 AS day FROM scored),
    f AS (SELECT y, p, v.fold, CASE WHEN day <= v.a THEN 'train' ELSE 'test' END AS part FROM d JOIN (VALUES (1, 20, 23), (2, 23, 26), (3, 26, 30)) AS v(fold, a, b) ON d.day <= v.b),
    c AS (SELECT fold, part, p, sum(y) AS pos, sum(1 - y) AS neg FROM f GROUP BY ALL),
    r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (PARTITION BY fold, part ORDER BY p DESC))
    SELECT fold, part, 1 - sum(pos * (fp - neg / 2e0)) / nullif(sum(pos) * sum(neg), 0) AS auc_roc,
      sum(pos * (tp * 1e0 / (tp + fp))) / nullif(sum(pos), 0) AS average_precision, sum(pos) AS positives, sum(neg) AS negatives FROM r GROUP BY 1, 2""",
    "sensor scored",
)
def fold_rank_metrics(spark, d):
    """AUC and average precision of every fold's parts from one keyed score curve."""
    return evaluate.rank_metrics(evaluate.time_folds(scored(spark, d), FOLDS), ["fold", "part"])


@query(
    "date:s " + METRIC_COLUMNS,
    f"""WITH forecasts AS (SELECT *, ts - INTERVAL 7 SECOND AS made FROM scored),
    near AS (SELECT s.event_id, s.made, s.p, l.rain_next_60 AS y, row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(s.made)), l.ts) AS r
      FROM forecasts s JOIN labels l ON l.device_id = s.device_id AND l.ts BETWEEN s.made - INTERVAL 5 MINUTE AND s.made + INTERVAL 5 MINUTE),
    f AS (SELECT strftime(made, '%Y-%m-%d') AS date, 0.5e0 AS threshold, p, y FROM near WHERE r = 1),
    c AS (SELECT date, threshold, {COUNTS} FROM f GROUP BY 1, 2) SELECT date, {METRICS} FROM c""",
    "sensor weather labels scored",
)
def forecast_monitor(spark, d):
    """Forecasts made some seconds ahead of the readings, against the label nearest in time."""
    forecasts = scored(spark, d).drop("y").withColumn("ts", F.col("ts") - F.expr("INTERVAL 7 SECONDS"))
    happened = rain_labels(spark, d).select("device_id", "ts", F.col("rain_next_60").alias("y"))
    return evaluate.forecast_monitor(evaluate.match_forecasts(forecasts, happened, 300))


# --- models ----------------------------------------------------------------------------------------



def model_matrix(spark, d):
    """Features, both targets and the time split, written out once before the rounds of a fit.

    What is read more than once, by measuring cells or by running counts, is written out first.
    """
    labels = rain_labels(spark, d)
    readings = adapter.sensor_reading(spark, d)
    cells = fit_cell_seconds(readings, ["device_id"])
    labelled = cut_lineage(readings.join(labels, ["ts", "device_id"]), "labelled")
    readings = row_index(labelled, ["device_id"], cell_seconds=cells)
    built = features.nowcast_features(weather_joined(spark, d, readings))
    matrix = features.training_matrix(
        built.withColumn("target", F.struct("rain_next_60", "rain_amount_next_60_mm")), K.FEATURE_NAMES, "target"
    )
    unsplit = cut_lineage(matrix.select("*", "target.*").drop("target"), "unsplit")
    return cut_lineage(evaluate.time_split(unsplit), "matrix")


#: What an application has fitted: one matrix and one model of each kind per folder of tables, shared by its queries.
_FITTED: dict[tuple[str, str, str], object] = {}


def _once(spark, d, kind, make):
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _fitted(spark, d, kind, fit):
    return _once(spark, d, kind, lambda: fit(_once(spark, d, "matrix", lambda: model_matrix(spark, d))))


def fitted_classifier(spark, d):
    """The fitted classifier and its scores of all rows, labelled at the threshold its validation rows suggest."""

    def fit(matrix):
        model = rain.train_classifier(matrix, K.FEATURE_NAMES)
        return model, cut_lineage(rain.score_at_best(model, matrix), "scores")

    return _fitted(spark, d, "classifier", fit)


def fitted_regressor(spark, d):
    """The fitted regressor and its predictions of all rows."""

    def fit(matrix):
        model = rain.train_regressor(matrix, K.FEATURE_NAMES)
        return model, cut_lineage(rain.score_amount(model, matrix), "amounts")

    return _fitted(spark, d, "regressor", fit)


@query("split:s n:i mean_score:d")
def train_rain_model(spark, d):
    _, scores = fitted_classifier(spark, d)
    return scores.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_score"))


SPLIT_LABELS = """split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, device_id) <= count(*) OVER () - ceil(0.15e0 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM labels)"""


@query(
    "split:s n:i positives:i outside:i mislabelled:i misordered:i",
    f"WITH {SPLIT_LABELS} SELECT split, count(*) AS n, sum(rain_next_60) AS positives, 0 AS outside, 0 AS mislabelled, 0 AS misordered FROM split GROUP BY 1",
    "sensor weather labels",
)
def rain_model_checks(spark, d):
    """What must hold whatever the trees learn: rows and positives per part, scores in [0, 1], labels that follow one threshold."""
    _, scores = fitted_classifier(spark, d)
    at = scores.agg(F.min(F.when(F.col("label") == 1, F.col("p"))).alias("least"), F.max(F.when(F.col("label") == 0, F.col("p"))).alias("most"))
    bounds = at.select(F.coalesce(F.col("least") <= F.col("most"), F.lit(False)).cast("int")).scalar()
    return scores.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rain_next_60").alias("positives"),
        F.count_if(~F.col("p").between(0, 1)).alias("outside"),
        F.count_if(F.col("label") != (F.col("p") >= F.col("threshold")).cast("int")).alias("mislabelled"),
        F.max(bounds).alias("misordered"),
    )


@query("split:s n:i mae:d rmse:d r2:d")
def train_amount_model(spark, d):
    _, scored_rows = fitted_regressor(spark, d)
    held = scored_rows.where("split = 'validation'").withColumn("actual", F.col("rain_amount_next_60_mm"))
    return evaluate.regression_metrics(held).withColumn("split", F.lit("validation"))


@query("device_id:s ts:t p:d label:i threshold:d")
def score_rain(spark, d):
    _, scores = fitted_classifier(spark, d)
    return scores.where("split = 'validation'")


@query("feature:s gain:d")
def feature_importance(spark, d):
    model, _ = fitted_classifier(spark, d)
    return rain.feature_importance(model, K.FEATURE_NAMES)


@query(
    "features:s hyperparameters:s n_trees:i threshold_default:d auc_roc:d pr_auc:d precision:d recall:d f1:d n_samples:i n_train:i n_val:i positive_rate:d"
)
def model_card(spark, d):
    model, scores = fitted_classifier(spark, d)
    return rain.classifier_card(scores, K.FEATURE_NAMES, n_trees=rain.trees_kept(model))


def _amount_card(spark, d):
    model, scores = fitted_regressor(spark, d)
    return rain.regressor_card(scores, K.FEATURE_NAMES, n_trees=rain.trees_kept(model))


@query("features:s hyperparameters:s n_trees:i mae:d rmse:d r2:d n_samples:i n_train:i n_val:i target_mean:d target_max:d")
def amount_model_card(spark, d):
    return _amount_card(spark, d)


@query(
    "features:s n_samples:i n_train:i n_val:i target_mean:d target_max:d errors_agree:b",
    f"""WITH {SPLIT_LABELS} SELECT '{json.dumps(K.FEATURE_NAMES)}' AS features, count(*) AS n_samples, count(*) FILTER (split = 'train') AS n_train,
      count(*) FILTER (split = 'validation') AS n_val, avg(rain_amount_next_60_mm) AS target_mean, max(rain_amount_next_60_mm) AS target_max, true AS errors_agree FROM split""",
    "sensor weather labels",
)
def amount_model_checks(spark, d):
    """What must hold of the amount model's card whatever the trees learn."""
    return _amount_card(spark, d).withColumn("errors_agree", (F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae")) & (F.col("r2") <= 1))
