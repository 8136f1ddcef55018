from datetime import timedelta

import numpy as np
import pandas as pd
from helpers import at, random_readings, readings
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.operators import joins, labels
from fieldflow.operators.spans import asof_nearest, coverage_spans


def weather(spark, rows):
    """rows: (minutes, rain)"""
    return spark.createDataFrame([(at(m), r) for m, r in rows], "ts timestamp, api_rain_1h double")


def points(spark, minutes):
    return spark.createDataFrame([("d", at(m)) for m in minutes], "device_id string, ts timestamp")


def test_asof_nearest_equals_sorted_merge(spark):
    left = random_readings(spark)
    rng = np.random.default_rng(3)
    right = spark.createDataFrame(
        [(at(float(m)), i) for i, m in enumerate(np.unique(rng.uniform(-20, 3100, 150).round(3)))], "ts timestamp, v bigint"
    )
    got = asof_nearest(left, right, 300).toPandas().sort_values("ts").reset_index(drop=True)
    expected = pd.merge_asof(
        left.toPandas().sort_values("ts"), right.toPandas().sort_values("ts"), on="ts", direction="nearest", tolerance=pd.Timedelta("5min")
    ).reset_index(drop=True)
    pd.testing.assert_series_equal(got["v"].astype(float), expected["v"].astype(float))
    matched = got.dropna(subset=["match_ts"])
    assert (abs(matched["ts"] - matched["match_ts"]) <= pd.Timedelta("5min")).all()
    assert 0 < len(matched) < len(got)


def test_asof_tie_goes_to_the_earlier_row_and_the_limit_is_included(spark):
    right = spark.createDataFrame([(at(0), 1), (at(4), 2)], "ts timestamp, v bigint")
    got = asof_nearest(points(spark, [-5, -5.001, 2, 2.001, 9, 9.001]), right, 300).orderBy("ts").collect()
    assert [r.v for r in got] == [None, 1, 1, 2, 2, None]


def test_buckets_narrow_where_spans_are_dense(spark, monkeypatch):
    from fieldflow.operators import spans as S

    monkeypatch.setattr(S, "SPANS_PER_BUCKET", 4)
    dense = spark.createDataFrame([(at(i / 60), i) for i in range(600)], "ts timestamp, v bigint")
    _, width = S.fitted_buckets(S.nearest_spans(dense, 300), (), 150 * S.SECOND)
    assert width < 10 * S.SECOND
    left = points(spark, [0.004, 1.0083, 1.009, 5, 9.99, 20])
    got = asof_nearest(left, dense, 300).orderBy("ts").collect()
    assert [r.v for r in got] == [0, 60, 61, 300, 599, None]


def test_asof_by_site(spark):
    left = spark.createDataFrame([("x", at(1)), ("y", at(1)), ("z", at(1))], "site string, ts timestamp")
    right = spark.createDataFrame([("x", at(0), 1), ("y", at(3), 2)], "site string, ts timestamp, v bigint")
    assert {r.site: r.v for r in asof_nearest(left, right, 300, by=["site"]).collect()} == {"x": 1, "y": 2, "z": None}


def test_labels_without_device_keep_unmatched_readings(spark):
    lbl = spark.createDataFrame([(at(0), 1)], "ts timestamp, rain_next_60 int")
    got = joins.join_labels(points(spark, [2, 30]), lbl).orderBy("ts").collect()
    assert [r.rain_next_60 for r in got] == [1, None]


def test_weather_fill_and_all_defaults(spark):
    r = readings(spark, [("d", 0, 20, 50, 1000, 30), ("d", 300, 21, 51, 1000, 30)])
    w = spark.createDataFrame([(at(10), 0.9, 1.5, 18.0, None, 3.0)], "ts timestamp, api_pop double, api_rain_1h double, api_temp_c double, api_rh_pct double, api_uvi double")
    near, far = joins.fill_weather(joins.join_weather(r, w)).orderBy("ts").collect()
    assert (near.api_pop, near.api_temp_c, near.api_rh_pct, near.api_weather_code) == (0.9, 18.0, 50.0, 800)
    assert (far.api_pop, far.api_rain_1h, far.api_temp_c, far.api_uvi) == (0.2, 0.0, 21.0, 5.0)
    near, far = joins.weather_or_defaults(r, w).orderBy("ts").collect()
    assert (near.api_pop, near.api_rh_pct) == (0.9, None)
    assert [far[c] for c in K.WEATHER_DEFAULTS] == list(K.WEATHER_DEFAULTS.values())


def test_match_rate_counts_before_filling(spark):
    r = readings(spark, [("d", m, 20, 50, 1000, 30) for m in (0, 300, 600)])
    w = spark.createDataFrame([(at(10), 0.9)], "ts timestamp, api_pop double")
    row = joins.match_rate(joins.join_weather(r, w)).first()
    assert (row.n, row.matched, row.low_match) == (3, 1, True)


def brute_label(t, rows):
    ahead = [(m, r) for m, r in sorted(rows) if t < m <= t + 60]
    if ahead:
        s60 = sum(r or 0 for _, r in ahead)
        s30 = sum(r or 0 for m, r in ahead if m <= t + 30)
    else:
        s60 = s30 = next(((r or 0.0) for m, r in sorted(rows) if m > t), 0.0)
    return int(round(s30, 6) > 0.1), int(round(s60, 6) > 0.1), round(s60, 6)


def labelled(spark, minutes, rows):
    got = labels.rain_labels(points(spark, minutes), weather(spark, rows)).orderBy("ts").collect()
    return [(r.rain_next_30, r.rain_next_60, r.rain_amount_next_60_mm) for r in got]


def test_label_edges(spark):
    rows = [(60, 0.1), (90, 0.5), (400, None), (5000, 2.0)]
    minutes = [-900, 0, 0.001, 30, 60, 60.001, 89.999, 90, 300, 340, 400, 4900, 4940, 5000, 6000]
    assert labelled(spark, minutes, rows) == [brute_label(m, rows) for m in sorted(minutes)]


def test_label_rules_one_by_one(spark):
    assert labelled(spark, [0], [(60, 0.2)]) == [(0, 1, 0.2)]  # exactly 60 minutes ahead counts
    assert labelled(spark, [0], [(0, 0.2), (10, 0.0)]) == [(0, 0, 0.0)]  # the instant itself does not
    assert labelled(spark, [0], [(10, 0.1)]) == [(0, 0, 0.1)]  # 0.1 mm is no rain
    assert labelled(spark, [0], [(500, 0.7)]) == [(1, 1, 0.7)]  # nothing near: next one at any distance
    assert labelled(spark, [0], [(-10, 0.7)]) == [(0, 0, 0.0)]  # nothing ahead


def test_labels_equal_brute_force_on_uneven_weather(spark):
    rng = np.random.default_rng(5)
    rows = [(float(m), float(r)) for m, r in zip(np.unique(rng.integers(0, 6000, 60)), rng.choice([0, 0.1, 0.3, 2.5], 60))]
    minutes = sorted(set(rng.uniform(-200, 6500, 300).round(2).tolist()))
    got = labelled(spark, minutes, rows)
    assert got == [brute_label(m, rows) for m in minutes]
    dense = [g for g, m in zip(got, minutes) if any(m < w <= m + 60 for w, _ in rows)]
    assert all(h >= f for f, h, _ in dense)


def test_coverage_merges_overlaps(spark):
    intervals = spark.createDataFrame(
        [("d", at(0), at(10)), ("d", at(5), at(20)), ("d", at(5), at(6)), ("d", at(300), at(310)), ("e", at(2), at(3))],
        "device_id string, start_ts timestamp, end_ts timestamp",
    )
    spans = coverage_spans(intervals, "start_ts", "end_ts").toPandas()
    assert not spans.empty
    flagged = joins.flag_irrigation(points(spark, [-0.001, 0, 10, 20, 20.001, 300, 310, 311]), intervals).orderBy("ts").collect()
    assert [r.is_irrigating_now for r in flagged] == [0, 1, 1, 1, 0, 1, 1, 0]


def test_last_rows_before_has_no_look_back_limit(spark):
    r = readings(spark, [("d", m, i, 50, 1000, 30) for i, m in enumerate([*range(0, 50, 5), 90_000])] + [("e", 0, 1, 1, 1, 1)])
    targets = spark.createDataFrame(
        [("d", at(60)), ("d", at(100_000)), ("d", at(-5)), ("d", at(0)), ("e", at(60))], "device_id string, target_ts timestamp"
    )
    got = joins.last_rows_before(targets, r, n=4).toPandas()
    frames = {k: v.sort_values("frame_pos")["temp_c"].tolist() for k, v in got.groupby(["device_id", "target_ts"])}
    stamp = lambda m: ("d", pd.Timestamp(at(m)))
    assert frames == {stamp(60): [6, 7, 8, 9], stamp(100_000): [7, 8, 9, 10], stamp(-5): [7, 8, 9, 10]}


def test_overlay_keeps_row_count(spark):
    slots = spark.createDataFrame([("d", at(0), 1, "keep"), ("d", at(60), 2, "old")], "device_id string, start_ts timestamp, duration_min int, note string")
    updates = spark.createDataFrame([("d", at(60), 5, None), ("d", at(999), 9, "x")], "device_id string, start_ts timestamp, duration_min int, note string")
    got = joins.overlay(slots, updates).orderBy("start_ts").collect()
    assert [(r.duration_min, r.note) for r in got] == [(1, "keep"), (5, None)]


def test_slot_audit_outcomes(spark):
    slots = spark.createDataFrame(
        [("d", at(0), at(10), 5), ("d", at(4), at(8), 3), ("d", at(100), at(110), 5), ("d", at(200), at(210), 5)],
        "device_id string, start_ts timestamp, end_ts timestamp, duration_min int",
    )
    r = readings(spark, [("d", 1, 20, 50, 1000, 40), ("d", 5, 20, 50, 1000, 41), ("d", 100, 20, 50, 1000, 60), ("d", 210, 20, 50, 1000, 10)])
    got = joins.audit_slots(slots, r).orderBy("start_ts").collect()
    assert [s.outcome for s in got] == ["started", "blocked", "skipped", "missed"]


def test_irrigation_events_equal_the_sequential_rule(spark):
    rng = np.random.default_rng(7)
    minutes = np.unique(rng.uniform(0, 6 * 1440, 3000).round(2))
    rows = [("d" if i % 3 else "e", float(m), 20, 50, 1000, round(float(rng.uniform(15, 60)), 1)) for i, m in enumerate(minutes)]
    r = readings(spark, rows)
    lbl = r.select("ts", "device_id", (F.minute("ts") % 4 == 0).cast("int").alias("rain_next_60"))
    got = {(e.device_id, e.start_ts, e.end_ts, e.duration_min) for e in labels.irrigation_events(r, lbl).collect()}
    expected, last = set(), {}
    for device, m, *_, soil in rows:
        t = at(m)
        if soil < 35 and t.minute % 4 and t.hour in (7, 17) and (device not in last or t - last[device] >= timedelta(hours=6)):
            minutes_ = 3 if soil < 25 else 2 if soil < 30 else 1
            start = t.replace(minute=0, second=0, microsecond=0)
            expected.add((device, start, start + timedelta(minutes=minutes_), minutes_))
            last[device] = t
    assert got == expected and len(got) > 10


def test_slot_audit_looks_again_and_crosses_midnight(spark):
    late = 23 * 60 + 50
    slots = spark.createDataFrame(
        [("d", at(late), at(late + 20), 30), ("d", at(late + 14), at(late + 24), 3), ("d", at(late + 25), at(late + 60), 3), ("e", at(5), at(9), 1)],
        "device_id string, start_ts timestamp, end_ts timestamp, duration_min int",
    )
    r = readings(spark, [("d", late + m, 20, 50, 1000, 40) for m in (1, 16, 20, 26, 29, 40)] + [("d", late + 33, 20, 50, 1000, 70)])
    got = joins.audit_slots(slots, r).orderBy("device_id", "start_ts").collect()
    assert [(s.outcome, s.checked_ts) for s in got] == [
        ("started", at(late + 1)),
        ("blocked", at(late + 16)),
        ("skipped", at(late + 33)),
        ("missed", None),
    ]


def test_missing_and_nan_rain_do_not_spread(spark):
    weather = spark.createDataFrame(
        [(at(60 * h), v) for h, v in enumerate([0.0, float("nan"), 0.3, None, 0.1, 0.2])], "ts timestamp, api_rain_1h double"
    )
    r = readings(spark, [("d", m, 1, 1, 1, 1) for m in (30, 90, 210, 290)])
    got = [(x.rain_amount_next_60_mm, x.rain_next_60) for x in labels.rain_labels(r, weather).orderBy("ts").collect()]
    assert got == [(0.0, 0), (0.3, 1), (0.1, 0), (0.2, 1)]
