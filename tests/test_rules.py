from datetime import date, datetime

import pytest
from helpers import at, readings
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.functions import scalars
from fieldflow.operators import clean, features
from fieldflow.plans import planning, schedule


@pytest.mark.parametrize(
    "soil, prob, yes, reason",
    [
        (29.9, 0.9, True, K.REASON_VERY_DRY),
        (39.9, 0.39, True, K.REASON_DRY_LOW_RAIN),
        (39.9, 0.61, False, K.REASON_RAIN_LIKELY),
        (39.9, 0.4, False, K.REASON_MOIST),
        (40.0, 0.1, False, K.REASON_MOIST),
    ],
)
def test_irrigation_decision(spark, soil, prob, yes, reason):
    df = spark.createDataFrame([(soil, prob)], "s double, p double")
    row = df.select(*[c.alias(n) for n, c in scalars.decide_irrigation("s", "p").items()]).first()
    assert (row.should_irrigate, row.reason) == (yes, reason)


def test_season_of_every_month(spark):
    days = spark.createDataFrame([(date(2024, m, 1),) for m in range(1, 13)], "d date")
    got = [r.season for r in days.withColumns(scalars.season_columns("d")).orderBy("d").collect()]
    f, s, u = "fall_winter_saving", "spring_anti_nom", "summer_fast_reaction"
    assert got == [f, s, s, s, u, u, u, f, f, f, f, f]


# January: critical 25, ok 38, heavy 12, medium 3
@pytest.mark.parametrize(
    "rain, pop, code, soil, branch, minutes",
    [
        (12.0, 0.6, 500, 10.0, "heavy_rain", []),
        (12.0, 0.59, 500, 10.0, "medium_rain_dry", [1]),
        (3.0, 0.9, 500, 25.0, "medium_rain", []),
        (2.9, 0.9, 500, 24.9, "dry", [3, 3]),
        (30.0, 0.9, 741, 24.9, "dry", [3, 3]),
        (30.0, 0.9, 800, 24.9, "heavy_rain", []),
        (0.0, 0.0, 500, 37.9, "fairly_dry", [2]),
        (0.0, 0.0, 500, 38.0, "moist", []),
        (0.0, 0.0, 500, None, "fairly_dry", [2]),
    ],
)
def test_day_plan_branches(spark, rain, pop, code, soil, branch, minutes):
    day = date(2024, 1, 5)
    forecast = spark.createDataFrame([(day, rain, pop, code)], "date date, rain_mm double, pop_max double, weather_code_main int")
    soils = spark.createDataFrame([("d", day if soil is not None else date(2024, 1, 6), soil or 1.0)], "device_id string, date date, soil_moist_mean double")
    row = planning.build_day_plans(forecast, soils).first()
    assert row.branch == branch and [s.duration_min for s in row.slots] == minutes
    assert row.soil_moist_ref == (soil if soil is not None else 35.0)
    if minutes:
        assert row.slots[0].start_ts == datetime(2024, 1, 5, 7) and f"{minutes[0]} phút" in row.note
    if branch == "dry":
        assert row.slots[1].start_ts == datetime(2024, 1, 5, 17)


def test_plan_covers_every_device_and_day_in_horizons(spark):
    days = [date(2024, 1, 1 + i) for i in range(7)]
    forecast = spark.createDataFrame([(d, 0.0, 0.0, 500) for d in days], "date date, rain_mm double, pop_max double, weather_code_main int")
    soils = spark.createDataFrame([("a", days[0], 20.0), ("b", days[1], 50.0)], "device_id string, date date, soil_moist_mean double")
    plans = planning.build_day_plans(forecast, soils)
    got = [(r.device_id, r.horizon_group) for r in plans.orderBy("device_id", "date").collect()]
    groups = ["d1_2"] * 2 + ["d3_5"] * 3 + ["d6_7"] * 2
    assert got == [("a", g) for g in groups] + [("b", g) for g in groups]
    balance = {r.device_id: r for r in planning.water_balance(plans).collect()}
    assert balance["a"].irrigation_min_7d == 6 + 6 * 2 and balance["a"].status == "deficit"


def test_soil_reference_with_fewer_than_seven_days(spark):
    r = readings(spark, [("d", 0, 1, 1, 1, 10), ("d", 10, 1, 1, 1, 20), ("d", 1500, 1, 1, 1, 40)])
    got = planning.soil_reference(r, F.lit("2024-05-01").cast("date")).orderBy("date").collect()
    assert [(x.date, x.soil_moist_mean) for x in got] == [(date(2024, 5, 2), 15.0), (date(2024, 5, 3), 40.0)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2025-12-15T07:00:00", datetime(2025, 12, 15, 0, 0)),
        ("2025-12-15 07:00:00", datetime(2025, 12, 15, 0, 0)),
        ("2025-12-15T00:00:00Z", datetime(2025, 12, 15, 0, 0)),
        ("2025-12-15T07:00:00+07:00", datetime(2025, 12, 15, 0, 0)),
        ("2025-12-15T08:00:00.250+08:00", datetime(2025, 12, 15, 0, 0, 0, 250000)),
        ("2025-12-14T20:30:00-03:30", datetime(2025, 12, 15, 0, 0)),
        ("2025-12-15", None),
        ("2025-12-15T07:00:00 or so", None),
        ("yesterday", None),
        (None, None),
    ],
)
def test_parse_timestamp(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(scalars.parse_timestamp("t", K.SITE_TZ)).first()[0] == expected


def test_soil_calibration_clamps(spark):
    df = spark.createDataFrame([(500,), (1000,), (2000,), (3000,), (4095,)], "raw int")
    assert [r.soil_moist_pct for r in clean.calibrate_soil(df, "raw").collect()] == [100.0, 100.0, 50.0, 0.0, 0.0]


def test_round_follows_the_binary_value(spark):
    df = spark.createDataFrame([(20.275,), (1.005,), (2.5,), (34.126,)], "v double")
    assert [r[0] for r in df.select(scalars.round_two("v")).collect()] == [20.27, 1.0, 2.5, 34.13]


def test_normalize_validate_and_reject(spark):
    schema = "device_id string, deviceId string, temperature double, humidity double, pressure double, pressure_hpa double, soilMoisture double, timestamp string"
    rows = [
        (None, "x", 1.0, 2.0, None, 3.0, 4.0, "2024-01-01T00:00:00Z"),
        ("y", None, 1.0, 2.0, 3.0, None, 4.0, "2024-01-01T00:00:00Z"),
        (None, None, None, 2.0, 3.0, None, 4.0, "2024-01-01T00:00:00Z"),
        (None, None, 1.0, 2.0, None, None, 4.0, "2024-01-01T00:00:00Z"),
    ]
    df = spark.createDataFrame(rows, schema)
    got = clean.normalize_telemetry(df).collect()
    assert [r.device_id for r in got] == ["x", "y", K.DEFAULT_DEVICE_ID, K.DEFAULT_DEVICE_ID]
    assert [r.pressure_hpa for r in got] == [3.0, 3.0, 3.0, 0.0]
    assert [r.reject_reason for r in clean.validate_telemetry(df).collect()] == [None, None, "missing temperature", "missing pressure"]


def test_trailing_window_per_device_and_overall(spark):
    r = readings(spark, [("a", 0, 1, 1, 1, 1), ("a", 1440 * 3, 1, 1, 1, 1), ("b", 1440 * 9, 1, 1, 1, 1)])
    assert clean.trailing_window(r, 2).count() == 2
    assert clean.trailing_window(r, 6, by=[]).count() == 2
    assert clean.trailing_window(r, 3).count() == 3


def test_keep_last_prefers_later_table_then_recency(spark):
    t = lambda rows: spark.createDataFrame(rows, "device_id string, ts timestamp, n int, v string")
    old = t([("d", at(0), 1, "old1"), ("d", at(0), 2, "old2"), ("d", at(5), 1, "only")])
    new = t([("d", at(0), 1, "new1"), ("d", at(0), 3, "new3")])
    got = clean.keep_last([old, new], recency=["n"]).orderBy("ts").collect()
    assert [r.v for r in got] == ["new3", "only"]


def slots_of(spark, minutes, **cols):
    df = spark.createDataFrame([("d", at(m), at(m + 3), 3) for m in minutes], "device_id string, start_ts timestamp, end_ts timestamp, duration_min int")
    return df.withColumn("date", F.date_format("start_ts", "yyyy-MM-dd"))


def test_upcoming_slots_window_and_next(spark):
    slots = slots_of(spark, [4, 5, 25, 26, 500])
    now = F.lit(at(0)).cast("timestamp")
    starts = lambda df: [r.start_ts for r in df.orderBy("start_ts").collect()]
    assert starts(schedule.upcoming_slots(slots, now)) == [at(5), at(25)]
    late = F.lit(at(100)).cast("timestamp")
    assert starts(schedule.upcoming_slots(slots, late)) == [at(500)]
    assert starts(schedule.upcoming_slots(slots, late, find_next=False)) == []
    assert starts(schedule.upcoming_slots(slots, F.lit(at(900)).cast("timestamp"))) == []


def test_decisions_due_once_with_defaults(spark):
    slots = slots_of(spark, [0, 1, 2]).withColumn("decision_published", F.minute("start_ts") == 0)
    got = schedule.decisions_due(slots, F.lit(at(0.5)).cast("timestamp")).collect()
    assert [(r.slot_id, r.probability, r.should_irrigate, r.reason) for r in got] == [(at(1), 0.3, True, "Demo decision")]


def test_today_shows_decisions_for_begun_and_nearest_slots(spark):
    rows = slots_of(spark, [60, 200, 400]).withColumn("decision", F.lit(False))
    got = schedule.today_schedule(rows, F.lit(at(150)).cast("timestamp")).orderBy("start").collect()
    assert [r.decision for r in got] == [False, False, None]


def test_executable_slots_stop_at_32(spark):
    rows = slots_of(spark, range(0, 400, 10)).withColumn("decision", F.when(F.minute("start_ts") != 0, True))
    got = schedule.executable_slots(rows).collect()
    assert len(got) == 32 and all(r.start_ts.minute for r in got)


def test_retime_only_between_8_and_17(spark):
    slots = slots_of(spark, [420, 1020])
    early = schedule.retime_first_slot(slots, F.lit(at(6 * 60)).cast("timestamp"))
    assert not any(r.retimed for r in early.collect())
    moved = schedule.retime_first_slot(slots, F.lit(at(17 * 60 + 59.5)).cast("timestamp")).where("retimed").collect()
    assert [(r.start_ts, r.end_ts) for r in moved] == [(at(17 * 60 + 59), at(17 * 60 + 62))]


def test_slot_status_paths(spark):
    df = spark.createDataFrame(
        [("confirm", False), ("postpone", True), ("skip", True), (None, True), (None, False), (None, None)], "decision string, should_irrigate boolean"
    )
    paths = ["confirmed", "postponed", "skipped", "confirmed", "postponed", "confirmed"]
    assert [r.status for r in schedule.slot_status(df).collect()] == paths
    assert schedule.slot_status(df, missing=False).collect()[-1].status == "postponed"


def test_label_columns_are_refused_as_features(spark):
    df = spark.createDataFrame([(1.0, 1)], "a double, rain_next_60 int")
    with pytest.raises(ValueError, match="rain_next_60"):
        features.training_matrix(df, ["a", "rain_next_60"], "rain_next_60", keys=())


def test_feature_sets():
    assert len(features.feature_names("nowcast")) == 13
    assert len(features.feature_names("compact")) == 19
    assert features.feature_names("wide", ["temp_c", "cloud_pct", "cloud_pct_lag3"]) == ["temp_c", "cloud_pct", "cloud_pct_lag3"]


def test_serving_features_fall_back_to_the_first_row(spark):
    frames = readings(spark, [("d", m, 20 + m, 50 + m, 1000 + m, 30 + m) for m in (0, 5)]).withColumn("target_ts", F.lit(at(9)).cast("timestamp"))
    for name, value in K.WEATHER_DEFAULTS.items():
        frames = frames.withColumn(name, F.lit(value))
    row = features.serving_features(frames, ["device_id", "target_ts"]).first()
    assert (row.pressure_slope_1h, row.temp_drop_15m, row.rh_rise_15m, row.soil_moist_smooth) == (5.0, -5.0, 5.0, 35.0)
    one = features.serving_features(frames.limit(1), ["device_id", "target_ts"]).first()
    assert (one.pressure_slope_1h, one.api_pop, one.soil_moist_smooth) == (0.0, 0.0, one.last_soil_moist_pct)


def test_missing_measures_have_no_band(spark):
    steps = [(1.0, False, "low"), (None, False, "high")]
    df = spark.createDataFrame([(0.5,), (2.0,), (None,), (float("nan"),)], "v double")
    assert [r.b for r in df.select(scalars.band("v", steps).alias("b")).collect()] == ["low", "high", None, None]
