"""Joins, labels, features and the operators that follow from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.functions import scalars
from fieldflow.operators import evaluate, features, joins, labels
from fieldflow.operators.ordered import fit_cell_seconds, number_rows, over_rows, over_time, row_index, time_cell
from fieldflow.plans import pre_irrigation
from fieldflow.queries.inputs import (
    decided_slots,
    irrigation,
    rain_labels as labels_of,
    score,
    weather_joined,
)
from fieldflow.queries.registry import query
from fieldflow.session import cut_lineage
from fieldflow.sources import adapter

W = "WINDOW w AS (PARTITION BY device_id ORDER BY ts)"


@query(
    "device_id:s ts:t temp_c:d rain_next_60:i",
    "SELECT s.device_id, s.ts, s.temp_c, l.rain_next_60 FROM sensor s JOIN labels l ON l.event_id = s.event_id",
    "sensor weather labels",
)
def sensor_label_join(spark, d):
    return joins.join_labels(adapter.sensor_reading(spark, d), labels_of(spark, d))


SITE_LABELS = """site AS (
  SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 600000000) AS ts, max(CASE WHEN rain_mm_5min > 0 THEN 1 ELSE 0 END) AS rain_next_60
  FROM sensor WHERE event_type IN ('error', 'click') GROUP BY 1)"""


@query(
    "device_id:s ts:t rain_next_60:d",
    f"""WITH {SITE_LABELS}, best AS (
      SELECT event_id, rain_next_60 FROM (SELECT s.event_id, l.rain_next_60,
        row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(s.ts)), l.ts) AS r
        FROM sensor s JOIN site l ON l.ts BETWEEN s.ts - INTERVAL 5 MINUTE AND s.ts + INTERVAL 5 MINUTE) WHERE r = 1)
    SELECT s.device_id, s.ts, b.rain_next_60 FROM sensor s LEFT JOIN best b ON b.event_id = s.event_id""",
    "sensor",
)
def asof_nearest_5m(spark, d):
    """Labels without a device: one per ten-minute cell in which an 'error' or 'click' event fell."""
    site = (
        adapter.keyed_sensor(spark, d)
        .where(F.col("event_type").isin("error", "click"))
        .groupBy(F.timestamp_micros(time_cell("ts", 600)).alias("ts"))
        .agg(F.max((F.col("rain_mm_5min") > 0).cast("int")).alias("rain_next_60"))
    )
    return joins.join_labels(adapter.sensor_reading(spark, d), site)


@query(
    "device_id:s ts:t api_pop:d api_rain_1h:d api_temp_c:d api_rh_pct:d api_uvi:d api_weather_code:i",
    "SELECT * FROM joined",
    "sensor weather nearest",
)
def asof_weather_fill(spark, d):
    return weather_joined(spark, d)


@query(
    "device_id:s ts:t api_pop:d api_rain_1h:d api_temp_c:d api_rh_pct:d api_uvi:d",
    """SELECT s.device_id, s.ts, CASE WHEN j.w_ts IS NULL THEN 0.2e0 ELSE j.api_pop END AS api_pop,
      CASE WHEN j.w_ts IS NULL THEN 0e0 ELSE j.api_rain_1h END AS api_rain_1h, CASE WHEN j.w_ts IS NULL THEN 25e0 ELSE j.api_temp_c END AS api_temp_c,
      CASE WHEN j.w_ts IS NULL THEN 70e0 ELSE j.api_rh_pct END AS api_rh_pct, CASE WHEN j.w_ts IS NULL THEN 5e0 ELSE j.api_uvi END AS api_uvi
    FROM sensor s JOIN joined j ON j.event_id = s.event_id""",
    "sensor weather nearest",
)
def asof_weather_default(spark, d):
    return joins.weather_or_defaults(adapter.sensor_reading(spark, d), adapter.weather_hour(spark, d))


TARGETS_SQL = "targets AS (SELECT DISTINCT device_id, start_ts - INTERVAL 10 MINUTE AS target_ts FROM irrigation)"
FRAMES_SQL = """ranked AS (
  SELECT t.device_id, t.target_ts, s.ts, s.temp_c, s.rh_pct, s.pressure_hpa, s.soil_moist_pct, s.ts <= t.target_ts AS is_before,
    row_number() OVER (PARTITION BY t.device_id, t.target_ts, s.ts <= t.target_ts ORDER BY s.ts DESC) AS r,
    sum(CASE WHEN s.ts <= t.target_ts THEN 1 ELSE 0 END) OVER (PARTITION BY t.device_id, t.target_ts) AS n_before
  FROM targets t JOIN sensor s ON s.device_id = t.device_id),
frames AS (SELECT * FROM ranked WHERE r <= 12 AND is_before = (n_before > 0) AND (n_before = 0 OR n_before >= 2))"""


@query(
    "device_id:s target_ts:t ts:t temp_c:d soil_moist_pct:d frame_pos:i",
    f"""WITH {TARGETS_SQL}, {FRAMES_SQL}
    SELECT *, row_number() OVER (PARTITION BY device_id, target_ts ORDER BY ts) AS frame_pos FROM frames""",
    "sensor weather labels irrigation",
)
def last_n_before(spark, d):
    targets = irrigation(spark, d).select("device_id", (F.col("start_ts") - F.make_dt_interval(mins=F.lit(10))).alias("target_ts"))
    return joins.last_rows_before(targets.distinct(), adapter.sensor_reading(spark, d))


@query(
    "device_id:s ts:t rain_next_30:i rain_next_60:i rain_amount_next_60_mm:d",
    "SELECT * FROM labels",
    "sensor weather labels",
)
def rain_labels(spark, d):
    return labels.rain_labels(adapter.sensor_reading(spark, d), adapter.weather_hour(spark, d))


WIDE_SQL = "wide AS (SELECT device_id, start_ts, start_ts + duration_min * INTERVAL 20 MINUTE AS end_ts, duration_min FROM irrigation)"


def wide_slots(spark, d):
    """Irrigation events stretched to 20 minutes per planned minute, so that readings fall inside."""
    return irrigation(spark, d).withColumn("end_ts", F.col("start_ts") + F.make_dt_interval(mins=F.col("duration_min") * 20))


@query(
    "device_id:s ts:t is_irrigating_now:i",
    f"""WITH {WIDE_SQL} SELECT s.device_id, s.ts, CASE WHEN EXISTS (SELECT 1 FROM wide e WHERE e.device_id = s.device_id
      AND s.ts BETWEEN e.start_ts AND e.end_ts) THEN 1 ELSE 0 END AS is_irrigating_now FROM sensor s""",
    "sensor weather labels irrigation",
)
def irrigation_flag(spark, d):
    return joins.flag_irrigation(adapter.sensor_reading(spark, d), wide_slots(spark, d))


@query(
    "device_id:s ts:t irrig_total_min_last_3h:d irrig_total_min_last_6h:d",
    f"""WITH {WIDE_SQL}, flagged AS (SELECT s.device_id, s.ts, CASE WHEN EXISTS (SELECT 1 FROM wide e WHERE e.device_id = s.device_id
      AND s.ts BETWEEN e.start_ts AND e.end_ts) THEN 5e0 ELSE 0e0 END AS m FROM sensor s)
    SELECT device_id, ts, sum(m) OVER (PARTITION BY device_id ORDER BY ts ROWS 35 PRECEDING) AS irrig_total_min_last_3h,
      sum(m) OVER (PARTITION BY device_id ORDER BY ts ROWS 71 PRECEDING) AS irrig_total_min_last_6h FROM flagged""",
    "sensor weather labels irrigation",
)
def irrigation_history(spark, d):
    numbered = number_rows(adapter.sensor_reading(spark, d))
    return features.irrigation_minutes(joins.flag_irrigation(numbered, wide_slots(spark, d)))


@query(
    "device_id:s start_ts:t duration_min:i status:s decision_reason:s",
    """SELECT device_id, start_ts, CASE WHEN duration_min = 3 THEN 6 ELSE duration_min END AS duration_min,
      CASE WHEN duration_min = 3 THEN 'changed' END AS status, decision_reason FROM decided""",
    "sensor weather plan",
)
def slot_overlay(spark, d):
    all_slots = decided_slots(spark, d)
    updates = all_slots.where("duration_min = 3").select(
        "device_id", "start_ts", F.lit(6).alias("duration_min"), F.lit("changed").alias("status")
    )
    return joins.overlay(all_slots, updates)


@query(
    "device_id:s start_ts:t end_ts:t checked_ts:t soil_at_start:d outcome:s",
    f"""WITH {WIDE_SQL}, inside AS (SELECT e.*, s.ts, s.soil_moist_pct AS soil FROM wide e
      LEFT JOIN sensor s ON s.device_id = e.device_id AND s.ts >= e.start_ts AND s.ts < e.end_ts),
    base AS (SELECT device_id, start_ts, end_ts, duration_min, min(ts) AS checked_ts, arg_min(soil, ts) AS soil_at_start FROM inside GROUP BY ALL),
    judged AS (SELECT *, CASE WHEN checked_ts IS NULL THEN 'missed' WHEN soil_at_start < 60 THEN 'started' ELSE 'skipped' END AS outcome FROM base),
    late AS (SELECT j.device_id, j.start_ts + INTERVAL 1 SECOND AS start_ts, j.start_ts + INTERVAL 10 MINUTE AS end_ts,
        CASE WHEN j.outcome = 'started' THEN j.checked_ts + j.duration_min * INTERVAL 1 MINUTE END AS busy_until FROM judged j),
    again AS (SELECT l.device_id, l.start_ts, l.end_ts, min(s.ts) AS looked, arg_min(s.soil_moist_pct, s.ts) AS looked_soil,
        min(s.ts) FILTER (l.busy_until IS NULL OR s.ts >= l.busy_until) AS free, arg_min(s.soil_moist_pct, s.ts) FILTER (l.busy_until IS NULL OR s.ts >= l.busy_until) AS free_soil
      FROM late l LEFT JOIN sensor s ON s.device_id = l.device_id AND s.ts >= l.start_ts AND s.ts < l.end_ts GROUP BY 1, 2, 3)
    SELECT device_id, start_ts, end_ts, checked_ts, soil_at_start, outcome FROM judged
    UNION ALL SELECT device_id, start_ts, end_ts, coalesce(free, looked), coalesce(free_soil, looked_soil),
      CASE WHEN looked IS NULL THEN 'missed' WHEN free IS NULL THEN 'blocked' WHEN free_soil < 60 THEN 'started' ELSE 'skipped' END FROM again""",
    "sensor weather labels irrigation",
)
def slot_execution_audit(spark, d):
    """Each slot has a second one over its first ten minutes, which the first one's pump may block."""
    slots = cut_lineage(wide_slots(spark, d).select("device_id", "start_ts", "end_ts", "duration_min"), "wide-slots")
    late = slots.select(
        "device_id",
        (F.col("start_ts") + F.expr("INTERVAL 1 SECOND")).alias("start_ts"),
        (F.col("start_ts") + F.expr("INTERVAL 10 MINUTES")).alias("end_ts"),
        F.lit(1).alias("duration_min"),
    )
    return joins.audit_slots(slots.unionByName(late), adapter.sensor_reading(spark, d))


@query(
    "start_ts:t end_ts:t device_id:s duration_min:i", "SELECT * FROM irrigation", "sensor weather labels irrigation"
)
def irrigation_events(spark, d):
    return irrigation(spark, d)


@query(
    "n:i matched:i match_rate:d low_match:b",
    "SELECT count(*) AS n, count(w_ts) AS matched, count(w_ts) / CAST(count(*) AS DOUBLE) AS match_rate, count(w_ts) < 0.5 * count(*) AS low_match FROM joined",
    "sensor weather nearest",
)
def match_rate(spark, d):
    return joins.match_rate(joins.join_weather(adapter.sensor_reading(spark, d), adapter.weather_hour(spark, d)))


# --- row-frame features ----------------------------------------------------------------------------


def labelled_rows(spark, d):
    """Labelled readings, numbered once for all features; the cells are measured on the raw readings."""
    readings = adapter.sensor_reading(spark, d)
    joined = joins.join_labels(readings, labels_of(spark, d))
    return row_index(joined, ["device_id"], cell_seconds=fit_cell_seconds(readings, ["device_id"]))


def _columns(names, kind="d"):
    return " ".join(["device_id:s ts:t", *[f"{n}:{kind}" for n in names]])


LAGS = [f"{c}_lag{k}" for c in K.BASE_COLUMNS for k in features.PRO_LAGS]


@query(
    _columns(LAGS),
    "SELECT device_id, ts, "
    + ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag{k}" for c in K.BASE_COLUMNS for k in features.PRO_LAGS)
    + f" FROM sensor {W}",
    "sensor",
)
def lag_features(spark, d):
    return over_rows(
        number_rows(adapter.sensor_reading(spark, d)), lambda w: features.lag_columns(w, K.BASE_COLUMNS, features.PRO_LAGS), before=24
    )


def _full(fn, c, k):
    over = f"OVER (PARTITION BY device_id ORDER BY ts ROWS {k - 1} PRECEDING)"
    return f"CASE WHEN count({c}) {over} = {k} THEN {fn}({c}) {over} END"


ROLLING = [f"{c}_{f}{k}" for c in K.BASE_COLUMNS for k in features.PRO_FRAMES for f in ("mean", "std")]


FRAME_MINUTES = [30, 60, 180]
FRAME_PARTS = {"n": ("i", "count({c})"), "sum": ("d", "sum({c})"), "mean": ("d", "avg({c})"), "std": ("d", "stddev_samp({c})")}
FRAMES = [(c, f, m) for m in FRAME_MINUTES for c in ("temp_c", "soil_moist_pct") for f in FRAME_PARTS]


@query(
    " ".join(["device_id:s ts:t", *[f"{c}_{f}{m}m:{FRAME_PARTS[f][0]}" for c, f, m in FRAMES]]),
    "SELECT device_id, ts, "
    + ", ".join(f"{FRAME_PARTS[f][1].format(c=c)} OVER w{m} AS {c}_{f}{m}m" for c, f, m in FRAMES)
    + " FROM sensor WINDOW "
    + ", ".join(f"w{m} AS (PARTITION BY device_id ORDER BY ts RANGE BETWEEN INTERVAL {m} MINUTE PRECEDING AND CURRENT ROW)" for m in FRAME_MINUTES),
    "sensor",
)
def time_range_features(spark, d):
    """Count, sum, mean and deviation over the last 30, 60 and 180 minutes, for an irregular cadence."""
    readings = adapter.sensor_reading(spark, d).select("device_id", "ts", "temp_c", "soil_moist_pct")
    return over_time(readings, ["temp_c", "soil_moist_pct"], FRAME_MINUTES)


@query(
    _columns(ROLLING),
    "SELECT device_id, ts, "
    + ", ".join(
        f"{_full(fn, c, k)} AS {c}_{f}{k}"
        for c in K.BASE_COLUMNS
        for k in features.PRO_FRAMES
        for f, fn in (("mean", "avg"), ("std", "stddev_samp"))
    )
    + " FROM sensor",
    "sensor",
)
def rolling_features(spark, d):
    return over_rows(
        number_rows(adapter.sensor_reading(spark, d)),
        lambda w: features.rolling_columns(w, K.BASE_COLUMNS, features.PRO_FRAMES),
        before=23,
    )


RAIN_SQL = f"""SELECT device_id, ts, CASE WHEN {_full('sum', 'rain_mm_5min', 3)} > 0 THEN 1 ELSE 0 END AS rain_in_last_15m,
  {_full('sum', 'rain_mm_5min', 6)} AS rain_last_30m, {_full('sum', 'rain_mm_5min', 12)} AS rain_last_60m FROM sensor"""


@query("device_id:s ts:t rain_in_last_15m:i rain_last_30m:d rain_last_60m:d", RAIN_SQL, "sensor")
def rain_history(spark, d):
    return over_rows(number_rows(adapter.sensor_reading(spark, d)), features.rain_columns, before=11)


DELTAS = [f"{c}_{t}" for c in K.BASE_COLUMNS for t in ("d30", "d60")]
SHORT = {"pressure_delta15": "pressure_hpa", "rh_delta15": "rh_pct", "temp_delta15": "temp_c"}


@query(
    _columns([*DELTAS, *SHORT]),
    "SELECT device_id, ts, "
    + ", ".join(f"{c} - lag({c}, {k}) OVER w AS {c}_{t}" for c in K.BASE_COLUMNS for t, k in (("d30", 6), ("d60", 12)))
    + ", "
    + ", ".join(f"{c} - lag({c}, 3) OVER w AS {n}" for n, c in SHORT.items())
    + f" FROM sensor {W}",
    "sensor",
)
def delta_features(spark, d):
    return over_rows(
        number_rows(adapter.sensor_reading(spark, d)),
        lambda w: {**features.delta_columns(w, K.BASE_COLUMNS), **features.short_delta_columns(w)},
        before=12,
    )


@query(
    "device_id:s ts:t rh_over_pressure_d30:d rh_over_pressure_d60:d",
    "SELECT device_id, ts, "
    + ", ".join(
        f"(rh_pct - lag(rh_pct, {k}) OVER w) / (abs(pressure_hpa - lag(pressure_hpa, {k}) OVER w) + 1e-6) AS rh_over_pressure_{t}"
        for t, k in (("d30", 6), ("d60", 12))
    )
    + f" FROM sensor {W}",
    "sensor",
)
def interaction_features(spark, d):
    deltas = over_rows(
        number_rows(adapter.sensor_reading(spark, d)),
        lambda w: features.delta_columns(w, ["rh_pct", "pressure_hpa"]),
        before=12,
    )
    # a ratio over a vanishing pressure change magnifies the last bit of the difference
    rounded = deltas.withColumns({c: F.round(c, 6) for c in deltas.columns if c.endswith(("_d30", "_d60"))})
    return rounded.withColumns(features.interaction_columns())


@query(_columns(K.FEATURE_NAMES), "SELECT * FROM features", "sensor weather nearest features")
def nowcast_features(spark, d):
    numbered = number_rows(adapter.sensor_reading(spark, d))
    return features.nowcast_features(weather_joined(spark, d, numbered))


@query(
    _columns([*K.FEATURE_NAMES]) + " rain_next_60:i",
    "SELECT f.device_id, f.ts, " + ", ".join(f"CAST(CAST(f.{c} AS FLOAT) AS DOUBLE) AS {c}" for c in K.FEATURE_NAMES)
    + ", l.rain_next_60 FROM features f JOIN labels l ON l.event_id = f.event_id",
    "sensor weather labels nearest features",
)
def training_matrix(spark, d):
    labelled = labelled_rows(spark, d)
    filled = weather_joined(spark, d, labelled)
    return features.training_matrix(features.nowcast_features(filled), K.FEATURE_NAMES, "rain_next_60")


COMPACT = features.feature_names("compact")


@query(
    _columns(COMPACT) + " rain_next_60:i",
    "SELECT device_id, ts, "
    + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in COMPACT)
    + ", rain_next_60 FROM (SELECT s.device_id, s.ts, s.temp_c, s.rh_pct, s.pressure_hpa, s.soil_moist_pct, s.rain_mm_5min, l.rain_next_60, "
    + ", ".join(f"s.{c} - lag(s.{c}, 3) OVER w AS {n}" for n, c in SHORT.items())
    + ", "
    + ", ".join(f"lag(s.{c}, 3) OVER w AS {c}_lag15" for c in K.BASE_COLUMNS)
    + ", "
    + ", ".join(
        f"CASE WHEN row_number() OVER w >= 6 THEN avg(s.{c}) OVER (PARTITION BY s.device_id ORDER BY s.ts ROWS 5 PRECEDING) END AS {c}_mean30"
        for c in K.BASE_COLUMNS
    )
    + ", CASE WHEN row_number() OVER w >= 3 AND sum(s.rain_mm_5min) OVER (PARTITION BY s.device_id ORDER BY s.ts ROWS 2 PRECEDING) > 0 THEN 1 ELSE 0 END AS rain_in_last_15m"
    + ", hour(s.ts) AS hour_of_day, isodow(s.ts) - 1 AS day_of_week"
    + " FROM sensor s JOIN labels l ON l.event_id = s.event_id WINDOW w AS (PARTITION BY s.device_id ORDER BY s.ts)) WHERE temp_c_mean30 IS NOT NULL",
    "sensor weather labels",
)
def compact_matrix(spark, d):
    labelled = labelled_rows(spark, d)
    return features.training_matrix(features.compact_features(labelled), COMPACT, "rain_next_60")


WIDE_CHECK = ["temp_c_lag24", "rh_pct_std24", "pressure_hpa_d60", "rain_last_60m", "dow_sin", "is_irrigating_now", "irrig_total_min_last_6h"]


@query(
    _columns(WIDE_CHECK) + " rain_next_60:i",
    f"""WITH {WIDE_SQL}, flagged AS (SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM wide e WHERE e.device_id = s.device_id
      AND s.ts BETWEEN e.start_ts AND e.end_ts) THEN 1 ELSE 0 END AS is_irrigating_now FROM sensor s),
    f AS (SELECT g.*, l.rain_next_60, lag(g.temp_c, 24) OVER w AS temp_c_lag24,
      stddev_samp(g.rh_pct) OVER (PARTITION BY g.device_id ORDER BY g.ts ROWS 23 PRECEDING) AS rh_pct_std24,
      g.pressure_hpa - lag(g.pressure_hpa, 12) OVER w AS pressure_hpa_d60,
      sum(g.rain_mm_5min) OVER (PARTITION BY g.device_id ORDER BY g.ts ROWS 11 PRECEDING) AS rain_last_60m,
      sin(2 * pi() * isodow(g.ts) / 7e0) AS dow_sin,
      sum(g.is_irrigating_now * 5e0) OVER (PARTITION BY g.device_id ORDER BY g.ts ROWS 71 PRECEDING) AS irrig_total_min_last_6h
      FROM flagged g JOIN labels l ON l.event_id = g.event_id WINDOW w AS (PARTITION BY g.device_id ORDER BY g.ts))
    SELECT device_id, ts, rain_next_60, {", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in WIDE_CHECK)} FROM f WHERE temp_c_lag24 IS NOT NULL""",
    "sensor weather labels irrigation",
)
def wide_matrix(spark, d):
    """The long feature set over all rows; a few of its columns are compared."""
    labelled = labelled_rows(spark, d)
    watered = features.irrigation_minutes(joins.flag_irrigation(labelled, wide_slots(spark, d)))
    built = features.wide_features(watered)
    return features.training_matrix(built, features.feature_names("wide", built.columns), "rain_next_60")


def _frame_sql(c: str, k: int, function: str) -> str:
    return f"CASE WHEN row_number() OVER w >= {k} THEN {function}({c}) OVER (PARTITION BY device_id ORDER BY ts ROWS {k - 1} PRECEDING) END"


EXPANDED = {
    f"{c}_{name}": sql
    for c in K.BASE_COLUMNS
    for name, sql in [
        *[(f"lag{k}", f"lag({c}, {k}) OVER w") for k in features.PRO_LAGS],
        *[(f"mean{k}", _frame_sql(c, k, "avg")) for k in features.PRO_FRAMES],
        *[(f"std{k}", _frame_sql(c, k, "stddev_samp")) for k in features.PRO_FRAMES],
        ("d30", f"{c} - lag({c}, 6) OVER w"),
        ("d60", f"{c} - lag({c}, 12) OVER w"),
    ]
}


@query(
    _columns(EXPANDED),
    f"SELECT device_id, ts, {', '.join(f'{sql} AS {n}' for n, sql in EXPANDED.items())} FROM sensor WINDOW w AS (PARTITION BY device_id ORDER BY ts)",
    "sensor",
)
def wide_columns(spark, d):
    """Every lag, mean, deviation and delta of the long feature set."""
    return features.wide_features(number_rows(adapter.sensor_reading(spark, d)))


@query(
    "device_id:s ts:t dew_point_c:d",
    "SELECT device_id, ts, 237.7e0 * g / (17.27e0 - g) AS dew_point_c FROM (SELECT device_id, ts, 17.27e0 * temp_c / (237.7e0 + temp_c) + ln(greatest(rh_pct, 1e-3) / 100e0) AS g FROM sensor)",
    "sensor",
)
def dew_point(spark, d):
    return adapter.sensor_reading(spark, d).withColumn("dew_point_c", scalars.dew_point("temp_c", "rh_pct"))


@query(
    "device_id:s ts:t month_sin:d month_cos:d hour_sin:d hour_cos:d hour_of_day:i day_of_week:i month:i hod_sin:d hod_cos:d dow_sin:d dow_cos:d",
    """SELECT device_id, ts, sin(2 * pi() * (month(ts) % 12) / 12e0) AS month_sin, cos(2 * pi() * (month(ts) % 12) / 12e0) AS month_cos,
      sin(2 * pi() * hour(ts) / 24e0) AS hour_sin, cos(2 * pi() * hour(ts) / 24e0) AS hour_cos, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
      month(ts) AS month, sin(2 * pi() * hour(ts) / 24e0) AS hod_sin, cos(2 * pi() * hour(ts) / 24e0) AS hod_cos,
      sin(2 * pi() * isodow(ts) / 7e0) AS dow_sin, cos(2 * pi() * isodow(ts) / 7e0) AS dow_cos FROM sensor""",
    "sensor",
)
def time_encoding(spark, d):
    return adapter.sensor_reading(spark, d).withColumns(
        {**scalars.month_cycle("ts"), **scalars.hour_cycle("ts"), **scalars.calendar("ts")}
    )


SERVED = [c for c in K.FEATURE_NAMES]
SERVING_SQL = f"""{TARGETS_SQL}, {FRAMES_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY device_id, target_ts ORDER BY ts DESC) AS back,
  count(*) OVER (PARTITION BY device_id, target_ts) AS n FROM frames),
buffers AS (SELECT device_id, target_ts, max(ts) AS last_ts,
  max(CASE WHEN back = 1 THEN temp_c END) AS t0, max(CASE WHEN back = 1 THEN rh_pct END) AS h0, max(CASE WHEN back = 1 THEN pressure_hpa END) AS p0,
  max(CASE WHEN back = 1 THEN soil_moist_pct END) AS s0, max(CASE WHEN back = least(12, n) AND (n >= 12 OR back = n) THEN pressure_hpa END) AS p1,
  max(CASE WHEN back = least(3, n) THEN temp_c END) AS t1, max(CASE WHEN back = least(3, n) THEN rh_pct END) AS h1 FROM placed GROUP BY 1, 2),
observed AS (SELECT device_id, target_ts, w.* EXCLUDE (ts) FROM (
  SELECT t.device_id, t.target_ts, w.ts, w.api_pop, w.api_rain_1h, w.api_temp_c, w.api_rh_pct, w.api_uvi,
    row_number() OVER (PARTITION BY t.device_id, t.target_ts ORDER BY abs(epoch_us(w.ts) - epoch_us(t.target_ts)), w.ts) AS r
  FROM targets t JOIN weather w ON w.ts BETWEEN t.target_ts - INTERVAL 1 HOUR AND t.target_ts + INTERVAL 1 HOUR) w WHERE r = 1),
served AS (SELECT b.*, coalesce(o.api_pop, 0.2e0) AS api_pop, coalesce(o.api_rain_1h, 0e0) AS api_rain_1h, coalesce(o.api_temp_c, 25e0) AS api_temp_c,
  coalesce(o.api_rh_pct, 70e0) AS api_rh_pct, coalesce(o.api_uvi, 5e0) AS uvi_index FROM buffers b
  LEFT JOIN observed o ON o.device_id = b.device_id AND o.target_ts = b.target_ts)""".replace("device_id, target_ts, w.* EXCLUDE (ts)", "*")


@query(
    "device_id:s target_ts:t last_ts:t " + " ".join(f"{c}:d" for c in SERVED),
    f"""WITH {SERVING_SQL}, dew AS (SELECT *, 17.27e0 * t0 / (237.7e0 + t0) + ln(h0 / 100e0) AS g0,
      17.27e0 * api_temp_c / (237.7e0 + api_temp_c) + ln(api_rh_pct / 100e0) AS g1 FROM served)
    SELECT device_id, target_ts, last_ts, api_pop, api_rain_1h, p0 - p1 AS pressure_slope_1h, t1 - t0 AS temp_drop_15m, h0 - h1 AS rh_rise_15m,
      237.7e0 * g0 / (17.27e0 - g0) - 237.7e0 * g1 / (17.27e0 - g1) AS dew_point_diff, api_temp_c - t0 AS temp_bias, s0 AS soil_moist_smooth,
      sin(2 * pi() * (month(last_ts) % 12) / 12e0) AS month_sin, cos(2 * pi() * (month(last_ts) % 12) / 12e0) AS month_cos,
      sin(2 * pi() * hour(last_ts) / 24e0) AS hour_sin, cos(2 * pi() * hour(last_ts) / 24e0) AS hour_cos, uvi_index FROM dew""",
    "sensor weather labels irrigation",
)
def serving_features(spark, d):
    due = pre_irrigation.due_slots(irrigation(spark, d))
    return pre_irrigation.slot_features(due, adapter.sensor_reading(spark, d), adapter.weather_hour(spark, d))


@query(
    "device_id:s start_ts:t duration_min:i probability:d should_irrigate:b forecast_reason:s status:s forecast_checked_at:t",
    f"""WITH {SERVING_SQL}, scored_slots AS (SELECT i.device_id, i.start_ts, i.duration_min, s.s0,
      round(round(1 / (1 + exp(-(s.h0 - 67) / 10e0)), 2), 4) AS p FROM irrigation i
      LEFT JOIN served s ON s.device_id = i.device_id AND s.target_ts = i.start_ts - INTERVAL 10 MINUTE),
    judged AS (SELECT *, CASE WHEN p IS NULL THEN true ELSE s0 < 30 OR (s0 < 40 AND p < 0.4) END AS yes FROM scored_slots)
    SELECT device_id, start_ts, duration_min, p AS probability, yes AS should_irrigate,
      CASE WHEN p IS NULL THEN 'Lỗi dự báo. Tưới theo lịch mặc định.' WHEN s0 < 30 THEN '{K.REASON_VERY_DRY}' WHEN s0 < 40 AND p < 0.4 THEN '{K.REASON_DRY_LOW_RAIN}'
        WHEN p > 0.6 THEN '{K.REASON_RAIN_LIKELY}' ELSE '{K.REASON_MOIST}' END AS forecast_reason,
      CASE WHEN yes THEN 'confirmed' ELSE 'postponed' END AS status, start_ts - INTERVAL 10 MINUTE AS forecast_checked_at FROM judged""",
    "sensor weather labels irrigation",
)
def pre_irrigation_check(spark, d):
    """Every unchecked slot at its own trigger time, scored by the humidity rule."""
    return pre_irrigation.check_slots(
        irrigation(spark, d), adapter.sensor_reading(spark, d), adapter.weather_hour(spark, d), score("last_rh_pct")
    )


@query(
    "device_id:s start_ts:t duration_min:i scored:b in_range:b agrees:b",
    f"""WITH {SERVING_SQL} SELECT i.device_id, i.start_ts, i.duration_min, s.device_id IS NOT NULL AS scored, true AS in_range, true AS agrees
    FROM irrigation i LEFT JOIN served s ON s.device_id = i.device_id AND s.target_ts = i.start_ts - INTERVAL 10 MINUTE""",
    "sensor weather labels irrigation",
)
def model_checked_slots(spark, d):
    """The check with fitted models in place of the rule; what must hold whatever the trees learn."""
    from fieldflow.models import rain
    from fieldflow.queries.assessing import fitted_classifier, fitted_regressor

    models = fitted_classifier(spark, d)[0], fitted_regressor(spark, d)[0]
    checked = pre_irrigation.check_slots(
        irrigation(spark, d), adapter.sensor_reading(spark, d), adapter.weather_hour(spark, d), rain.slot_scorer(*models)
    )
    known = F.col("probability").isNotNull()
    in_range = F.col("probability").between(0, 1) & (F.col("rain_amount_mm") >= 0)
    status = F.when(F.col("should_irrigate"), "confirmed").otherwise("postponed")
    return checked.select(
        "device_id", "start_ts", "duration_min", known.alias("scored"),
        F.when(known, in_range).otherwise(True).alias("in_range"), (F.col("status") == status).alias("agrees"),
    )


@query(
    "corr_now:d corr_shifted:d",
    """WITH h AS (SELECT device_id, ts, CASE WHEN row_number() OVER w >= 3 AND sum(rain_mm_5min) OVER (PARTITION BY device_id ORDER BY ts ROWS 2 PRECEDING) > 0 THEN 1 ELSE 0 END AS x,
      CASE WHEN rain_mm_5min > 0 THEN 1 ELSE 0 END AS y FROM sensor WINDOW w AS (PARTITION BY device_id ORDER BY ts)),
    a AS (SELECT x, y, lead(y, 3) OVER (PARTITION BY device_id ORDER BY ts) AS ahead FROM h)
    SELECT corr(y, x) AS corr_now, corr(ahead, CASE WHEN ahead IS NOT NULL THEN x END) AS corr_shifted FROM a""",
    "sensor",
)
def label_lag_corr(spark, d):
    rain = over_rows(number_rows(adapter.sensor_reading(spark, d)), features.rain_columns, before=11)
    return evaluate.label_lag_corr(rain.withColumn("y", (F.col("rain_mm_5min") > 0).cast("int")))
