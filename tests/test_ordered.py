from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import at, random_readings, readings
from pyspark.sql import functions as F

from fieldflow.operators import ordered
from fieldflow.operators.ordered import (
    exact_median,
    fit_cell_seconds,
    micros,
    number_cell,
    number_rows,
    over_rows,
    over_time,
    in_order,
    neighbours,
    row_index,
)


def test_row_index_matches_rank(spark):
    df = random_readings(spark)
    got = row_index(df, ["device_id"]).toPandas()
    expected = got.groupby("device_id")["ts"].rank().astype(int)
    assert (got["row_index"] == expected).all()


def test_row_index_without_key(spark):
    got = row_index(random_readings(spark), []).toPandas().sort_values("ts")
    assert got["row_index"].tolist() == list(range(1, len(got) + 1))


def test_frames_are_whole_across_small_chunks(spark):
    df = random_readings(spark)
    build = lambda w: {
        "lag5": F.lag("temp_c", 5).over(w),
        "lead2": F.lead("temp_c", 2).over(w),
        "mean6": F.avg("temp_c").over(w.rowsBetween(-5, 0)),
    }
    got = over_rows(df, build, before=5, after=2, chunk_rows=7).toPandas().sort_values(["device_id", "ts"])
    groups = got.groupby("device_id")["temp_c"]
    assert len(got) == df.count()
    pd.testing.assert_series_equal(got["lag5"], groups.shift(5), check_names=False)
    pd.testing.assert_series_equal(got["lead2"], groups.shift(-2), check_names=False)
    mean = groups.rolling(6, min_periods=1).mean().reset_index(level=0, drop=True)
    pd.testing.assert_series_equal(got["mean6"], mean, check_names=False)


def test_given_row_index_is_used_and_kept(spark):
    numbered = row_index(random_readings(spark, 100), ["device_id"])
    out = over_rows(numbered, lambda w: {"prev": F.lag("ts").over(w)}, before=1, chunk_rows=4)
    assert "row_index" in out.columns
    firsts = out.where("prev IS NULL").select("row_index").distinct().collect()
    assert [r.row_index for r in firsts] == [1]


def test_running_totals_both_directions(spark):
    df = spark.createDataFrame([("k", i, i % 5) for i in range(200)], "k string, pos bigint, v bigint")
    cell = number_cell(F.col("pos"), 16)
    up = in_order(df, ["k"], ["pos"], cell, {"s": F.col("v")}).orderBy("pos").toPandas()
    down = in_order(df, ["k"], ["pos"], cell, {"s": F.col("v")}, descending=True).orderBy("pos").toPandas()
    assert up["s"].tolist() == up["v"].cumsum().tolist()
    assert down["s"].tolist() == down["v"][::-1].cumsum()[::-1].tolist()


def test_neighbours_cross_empty_cells(spark):
    df = random_readings(spark).withColumn("temp_c", F.when(F.col("temp_c") > 24, F.col("temp_c")))
    got = neighbours(df, prev=["ts", "temp_c"], next=["ts", "temp_c"], cell_seconds=120).toPandas().sort_values(["device_id", "ts"])
    groups = got.groupby("device_id")
    for c in ("ts", "temp_c"):
        pd.testing.assert_series_equal(got[f"prev_{c}"], groups[c].shift(1), check_names=False)
        pd.testing.assert_series_equal(got[f"next_{c}"], groups[c].shift(-1), check_names=False)


def test_exact_median_even_odd_and_repeated(spark):
    rows = [("even", v) for v in (1, 2, 10, 11)] + [("odd", v) for v in (5, 5, 9)] + [("one", 7)]
    got = exact_median(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", cell_width=2)
    assert {r.k: (r.n, r.median) for r in got.collect()} == {"even": (4, 6.0), "odd": (3, 5.0), "one": (1, 7.0)}


def test_cell_width_shrinks_for_a_hot_cell(spark):
    df = readings(spark, [("hot", i / 60, 1, 1, 1, 1) for i in range(600)])
    width = fit_cell_seconds(df, ["device_id"], max_rows=100)
    fullest = df.groupBy(number_cell(micros("ts"), int(width * 1_000_000))).count().agg(F.max("count")).first()[0]
    assert width < 3600 and fullest <= 100


def test_rows_without_key_or_time_keep_their_place(spark):
    rows = [("d", at(0)), ("d", at(1)), ("d", None), (None, at(5)), (None, None), ("e", at(90))]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp")
    got = sorted(((r.device_id or "", r.ts or at(-1), r.row_index) for r in number_rows(df).collect()), key=str)
    assert got == sorted([("d", at(-1), 1), ("d", at(0), 2), ("d", at(1), 3), ("", at(-1), 1), ("", at(5), 2), ("e", at(90), 1)], key=str)
    back = neighbours(df, prev=["ts"], next=["ts"], cell_seconds=30).where("device_id = 'd'").orderBy("ts").collect()
    assert [(r.prev_ts, r.next_ts) for r in back] == [(None, at(0)), (None, at(1)), (at(0), None)]


def test_a_fleet_on_one_tick_is_reported(spark):
    df = readings(spark, [(f"d{i}", 1, 1, 1, 1, 1) for i in range(300)])
    with pytest.warns(UserWarning, match="share a key"):
        width = fit_cell_seconds(df, [], max_rows=100)
    assert width == pytest.approx(0.001)


def test_time_frames_equal_a_plain_count(spark):
    """A device with most rows in one hour, repeated instants, nulls, NaN, a null device, rows without a time."""
    rng = np.random.default_rng(11)
    minutes = [*rng.integers(0, 60, 300), *rng.integers(0, 3000, 100).tolist()]
    rows = [(str(rng.choice(["hot", "hot", "b"])), at(float(m)), round(float(rng.normal(1000, 5)), 2)) for m in minutes]
    rows += [("b", at(70), None), ("b", at(71), float("nan")), (None, at(10), 4.5), (None, at(40), 5.5), ("hot", None, 1.0)]
    df = spark.createDataFrame(rows, "device_id string, ts timestamp, v double")
    for cell in (None, 420):
        got = over_time(df, ["v"], [30, 180], cell_seconds=cell).collect()
        assert len(got) == len(rows)
        for r in got:
            for m in (30, 180):
                frame = [
                    v for d, t, v in rows
                    if r.ts and t and d == r.device_id and r.ts - timedelta(minutes=m) <= t <= r.ts and v is not None and v == v
                ]
                assert r[f"v_n{m}m"] == len(frame)
                if not frame:
                    assert r[f"v_sum{m}m"] is r[f"v_mean{m}m"] is r[f"v_std{m}m"] is None
                else:
                    assert r[f"v_sum{m}m"] == pytest.approx(sum(frame), abs=1e-6)
                    assert r[f"v_mean{m}m"] == pytest.approx(np.mean(frame), abs=1e-9)
                    std = np.std(frame, ddof=1) if len(frame) > 1 else None
                    assert r[f"v_std{m}m"] == (None if std is None else pytest.approx(std, abs=1e-9))
    assert over_time(df.limit(0), ["v"], [30]).count() == 0


def test_frames_of_minutes_are_dealt_by_rows_and_not_by_bytes(spark, monkeypatch):
    frame = random_readings(spark, n=2000, span_minutes=6000).select("device_id", "ts", "temp_c")
    whole = {tuple(r) for r in ordered.over_time(frame, ["temp_c"], [30]).collect()}
    widest = []

    def seen(*args, **named):
        out = in_order(*args, **named)
        widest.append(out.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ordered, "FRAME_TASK_ROWS", 200)
    monkeypatch.setattr(ordered, "in_order", seen)
    cut = {tuple(r) for r in ordered.over_time(frame, ["temp_c"], [30]).collect()}
    assert cut == whole
    assert widest[0] <= 800  # 4000 marks: the session's own exchange packs them into one task
