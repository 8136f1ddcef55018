from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import at, random_readings, readings
from pyspark.sql import functions as F

from fieldflow.operators import devices


def greedy(times, gap):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t - last >= gap:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("cell_minutes, n", [(60, 600), (7, 600), (1440, 600), (25, 3000)])
def test_thinning_equals_the_greedy_chain(spark, cell_minutes, n):
    df = random_readings(spark, n, seed=cell_minutes)
    got = devices.thin_readings(df, 600, cell_minutes * 60).toPandas()
    for device, rows in df.toPandas().groupby("device_id"):
        kept = sorted(got[got.device_id == device]["ts"])
        assert kept == greedy(rows["ts"], pd.Timedelta("10min"))
        assert all(b - a >= timedelta(minutes=10) for a, b in zip(kept, kept[1:]))


def test_thinning_across_long_gaps_and_exact_ten_minutes(spark):
    minutes = [0, 9.999, 10, 20, 29.5, 30, 5000, 5001, 5010, 200000]
    df = readings(spark, [("d", m, 1, 1, 1, 1) for m in minutes])
    got = sorted(r.ts for r in devices.thin_readings(df, 600, 3600).collect())
    assert got == [at(m) for m in (0, 10, 20, 30, 5000, 5010, 200000)]


def test_step_functions_compose_like_running_the_cells():
    rng = np.random.default_rng(0)
    for _ in range(50):
        times = np.unique(rng.integers(0, 400, 60))
        cells = [times[(times >= s) & (times < s + 100)] for s in range(0, 400, 100)]
        parts = [devices._cell_steps(c, 37, s + 37) for c, s in zip(cells, range(0, 400, 100)) if len(c)]
        u, x = parts[0]
        for p in parts[1:]:
            u, x = devices._compose(u, x, *p)
        end = devices._apply_steps(u, x, np.asarray([devices.START]))[0]
        assert end == greedy(times, 37)[-1] + 37


def test_sessions_and_last_status(spark):
    rows = [("d", 0, "online"), ("d", 0.05, "online"), ("d", 0.15, "offline"), ("d", 0.2501, "online"), ("e", 3, "online")]
    df = spark.createDataFrame([(d, at(m), s) for d, m, s in rows], "device_id string, ts timestamp, status string")
    got = devices.device_sessions(df).orderBy("device_id", "session_start").collect()
    assert [(r.device_id, r.session_start, r.session_end, r.messages, r.last_status) for r in got] == [
        ("d", at(0), at(0.15), 3, "offline"),
        ("d", at(0.2501), at(0.2501), 1, "online"),
        ("e", at(3), at(3), 1, "online"),
    ]
    assert devices.online_devices(df).first().online == 2


def test_silence_is_above_the_limit_and_reaches_to_now(spark):
    df = readings(spark, [("d", m, 1, 1, 1, 1) for m in (0, 15, 31)])
    got = devices.silent_devices(df, F.lit(at(60)).cast("timestamp")).orderBy("silent_from").collect()
    assert [(r.silent_from, r.silent_until) for r in got] == [(at(15), at(31)), (at(31), at(60))]


def test_pump_runs_and_stop_rules(spark):
    rows = [("d", 0, "OFF"), ("d", 1, "ON"), ("d", 2, "ON"), ("d", 4, "OFF"), ("d", 10, "ON"), ("d", 31, "OFF"), ("d", 50, "ON")]
    messages = spark.createDataFrame([(d, at(m), p, 3) for d, m, p in rows], "device_id string, ts timestamp, pump string, planned_minutes int")
    soil = readings(spark, [("d", 3, 1, 1, 1, 59.9), ("d", 12, 1, 1, 1, 60), ("d", 31, 1, 1, 1, 99)])
    got = devices.pump_runs(messages, soil).orderBy("on_ts").collect()
    flags = [(r.on_ts, r.off_ts, r.ran_in_wet_soil, r.past_planned_end, r.past_limit) for r in got]
    assert flags == [
        (at(1), at(4), False, False, False),
        (at(10), at(31), True, True, True),
        (at(50), None, False, False, False),
    ]


def test_series_are_long(spark):
    df = readings(spark, [("d", 0, 1, 2, 3, 4)])
    assert {(r.series, r.value) for r in devices.to_series(df).collect()} == {("temp_c", 1.0), ("pressure_hpa", 3.0), ("soil_moist_pct", 4.0)}


@pytest.mark.parametrize("start_minute", [-28_401_125.0, -1000.0, 0.0])  # the first one lies around 1970
@pytest.mark.parametrize("cell_seconds", [90.0, 3600.0, None])
def test_thinning_does_not_depend_on_where_the_series_lies(spark, start_minute, cell_seconds):
    rng = np.random.default_rng(5)
    minutes = np.unique(np.round(rng.uniform(0, 2500, 500), 3)) + start_minute
    df = readings(spark, [("d", float(m), 1, 1, 1, 1) for m in minutes])
    got = sorted(r.ts for r in devices.thin_readings(df, 600, cell_seconds).collect())
    assert got == greedy([at(float(m)) for m in minutes], timedelta(minutes=10))


def test_thinning_keeps_one_of_equal_times_and_whole_rows(spark):
    df = readings(spark, [("d", m, m, 1, 1, 1) for m in (0, 0, 10, 10, 10, 15, 20)]).withColumn("big", F.lit(2**60 + 1))
    df = df.unionByName(df.limit(1).withColumns({"device_id": F.lit(None).cast("string")}))
    got = devices.thin_readings(df, 600).orderBy("ts").collect()
    assert [(r.ts, r.temp_c, r.big) for r in got] == [(at(m), float(m), 2**60 + 1) for m in (0, 10, 20)]
    assert devices.thin_readings(df.limit(0)).collect() == []


def test_a_device_that_fell_silent_is_not_online(spark):
    df = spark.createDataFrame([("a", at(0), "online"), ("b", at(9), "online"), ("c", at(9), "offline")], "device_id string, ts timestamp, status string")
    got = devices.online_devices(df, F.lit(at(9.05)).cast("timestamp")).first()
    assert (got.online, got.known) == (1, 3)


def test_messages_of_one_instant_have_an_order(spark):
    """Online and offline, ON and OFF at one time: the same result for any order and partitioning."""
    status = [("a", at(0), "online"), ("a", at(0), "offline"), ("b", at(0), "offline"), ("b", at(0.05), "offline"), ("b", at(0.05), "online")]
    pump = [("a", at(0), "ON", 1), ("a", at(5), "ON", 2), ("a", at(5), "OFF", 2), ("a", at(9), "OFF", 2)]
    dry = readings(spark, [("a", 1, 20, 50, 1000, 30)])
    for turn in (1, -1):
        m = spark.createDataFrame(status[::turn], "device_id string, ts timestamp, status string").repartition(3)
        assert devices.online_devices(m).first().online == 2
        sessions = {(r.device_id, r.messages, r.last_status) for r in devices.device_sessions(m).collect()}
        assert sessions == {("a", 2, "online"), ("b", 3, "online")}
        p = spark.createDataFrame(pump[::turn], "device_id string, ts timestamp, pump string, planned_minutes int").repartition(3)
        runs = {(r.on_ts, r.off_ts) for r in devices.pump_runs(p, dry).collect()}
        assert runs == {(at(0), at(5)), (at(5), at(9))}
