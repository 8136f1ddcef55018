"""The slot audit against the sequential loop."""

from collections import Counter
from datetime import timedelta

import numpy as np
import pytest
from helpers import START, at, readings
from pyspark.sql import functions as F

from fieldflow.operators import slots as S

SLOTS = "device_id string, start_ts timestamp, end_ts timestamp, duration_min int"


def sequential(slots, rows, ref=60.0):
    """One slot after the other, one reading after the other."""
    by_device, out = {}, Counter()
    for d, m, *_, soil in rows:
        by_device.setdefault(d, []).append((at(m), soil))
    for d in by_device.values():
        d.sort()
    busy, times = {}, {d: np.array([t for t, _ in v], "datetime64[us]") for d, v in by_device.items()}
    for d, start, end, minutes in sorted(slots, key=lambda s: (s[0], s[1], s[2], -1 if s[3] is None else s[3])):
        lo, hi = (np.searchsorted(times[d], np.datetime64(x, "us")) for x in (start, end)) if d in times else (0, 0)
        seen = by_device.get(d, [])[lo:hi]
        free = [r for r in seen if busy.get(d) is None or r[0] >= busy[d]]
        outcome = "missed" if not seen else "blocked" if not free else "started" if free[0][1] < ref else "skipped"
        checked = (free or seen or [(None, None)])[0]
        if outcome == "started":
            busy[d] = None if minutes is None else checked[0] + timedelta(minutes=minutes)
        out[(d, start, end, minutes, *checked, outcome)] += 1
    return out


def audited(spark, slots, rows):
    got = S.audit_slots(spark.createDataFrame(slots, SLOTS), readings(spark, rows)).drop("date")
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_equal_the_sequential_loop(spark, seed):
    """Nested, equal, long and repeated slots, some without minutes; a busy device and quiet ones."""
    rng = np.random.default_rng(seed)
    rows = [
        ("hot" if rng.random() < 0.7 else "a", float(m), 20, 50, 1000, round(float(rng.uniform(30, 90)), 1))
        for m in np.unique(rng.uniform(0, 3000, 900).round(2))
    ]
    slots = []
    for _ in range(1400):
        start, length = float(rng.integers(0, 3000)), float(rng.choice([1, 5, 20, 200]))
        minutes = None if rng.random() < 0.05 else int(rng.choice([0, 1, 7, 60]))
        slots.append((str(rng.choice(["hot", "hot", "a", "none"])), at(start), at(start + length), minutes))
    got = audited(spark, slots + slots[:20], rows)
    assert got == sequential(slots + slots[:20], rows)
    assert {o[-1] for o in got} == {"started", "skipped", "blocked", "missed"}


def test_a_long_chain_of_overlapping_slots(spark):
    """A slot a minute for ten, on one device, never apart: every group in Python stays at 32 slots."""
    n = 100_000
    rng = np.random.default_rng(5)
    soil = rng.uniform(40, 80, n // 2).round(1)
    rows = [("d", 2.0 * i, 20, 50, 1000, float(soil[i])) for i in range(n // 2)]
    starts = spark.range(n).withColumn("start_ts", F.lit(START).cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int")))
    slots = starts.select(
        F.lit("d").alias("device_id"), "start_ts", (F.col("start_ts") + F.expr("INTERVAL 10 MINUTES")).alias("end_ts"),
        (F.col("id") % 13).cast("int").alias("duration_min"),
    )
    got = S.audit_slots(slots, readings(spark, rows)).groupBy("outcome").count().collect()
    expected = Counter()
    for key, c in sequential([("d", at(i), at(i + 10), i % 13) for i in range(n)], rows).items():
        expected[key[-1]] += c
    assert {r.outcome: r["count"] for r in got} == dict(expected)


def test_rows_without_keys_and_empty_tables(spark):
    rows = [("d", 1, 20, 50, 1000, 40)]
    slots = [(None, at(0), at(10), 5), ("d", None, at(10), 5), ("d", at(0), None, 5), ("d", at(10), at(0), 5), ("d", at(0), at(10), 5)]
    got = S.audit_slots(spark.createDataFrame(slots, SLOTS), readings(spark, rows))
    assert sorted(r.outcome for r in got.collect()) == ["missed"] * 4 + ["started"]
    assert got.columns == ["device_id", "date", "start_ts", "end_ts", "duration_min", "checked_ts", "soil_at_start", "outcome"]
    assert S.audit_slots(spark.createDataFrame([], SLOTS), readings(spark, rows)).count() == 0
    unseen = S.audit_slots(spark.createDataFrame(slots, SLOTS), readings(spark, [])).collect()
    assert {r.outcome for r in unseen} == {"missed"}
