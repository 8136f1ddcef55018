"""Device state over time: message sessions, silences, pump runs, and thinned series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.operators.ordered import fit_cell_seconds, micros, neighbours
from fieldflow.operators.spans import SECOND, span_lookup
from fieldflow.session import cut_lineage


def device_sessions(messages: DataFrame, silence_seconds: float = 6.0, **cells) -> DataFrame:
    """Runs of status messages of a device with no silence above the limit, and the last status of each.

    Of messages at one instant the greatest status counts as the last. Only session starts leave the first step; a session's end is what stood before the next start.
    """
    gap = int(silence_seconds * SECOND)
    marked = neighbours(
        messages.select("device_id", "ts", "status"),
        sums={"pos": F.lit(1).cast("bigint")},
        prev=["ts", "status"],
        then=["status"],
        **cells,
    )
    starts = marked.where(F.col("prev_ts").isNull() | (micros("ts") - micros("prev_ts") > gap))
    paired = neighbours(starts.drop("status"), next=["prev_ts", "prev_status", "pos"], **cells)
    last = cut_lineage(
        messages.groupBy("device_id").agg(
            F.max("ts").alias("_last"), F.max(F.struct("ts", "status"))["status"].alias("_last_status"), F.count(F.lit(1)).alias("_n")
        ),
        "last-messages",
    )
    return paired.join(last, "device_id").select(
        "device_id",
        F.col("ts").alias("session_start"),
        F.coalesce("next_prev_ts", "_last").alias("session_end"),
        (F.coalesce(F.col("next_pos"), F.col("_n") + 1) - F.col("pos")).alias("messages"),
        F.coalesce("next_prev_status", "_last_status").alias("last_status"),
    )


def online_devices(messages: DataFrame, now: Column | None = None, silence_seconds: float = 6.0) -> DataFrame:
    """Devices whose last word was "online" and, given ``now``, not longer ago than the silence allows.

    Of messages at one instant the greatest status counts, so "online" stands over "offline".
    """
    latest = messages.groupBy("device_id").agg(F.max(F.struct("ts", "status")).alias("_m")).select("device_id", "_m.*")
    heard = F.lit(True) if now is None else micros(now) - micros("ts") <= int(silence_seconds * SECOND)
    return latest.agg(
        F.count_if((F.col("status") == "online") & heard).alias("online"), F.count(F.lit(1)).alias("known")
    )


def silent_devices(readings: DataFrame, now: Column, limit_minutes: float = 15.0, **cells) -> DataFrame:
    """Silences above the limit, up to ``now`` for a device's last reading."""
    nexted = neighbours(readings.select("device_id", "ts"), next=["ts"], **cells).withColumn(
        "until", F.coalesce(F.col("next_ts"), now)
    )
    quiet = (micros("until") - micros("ts")) / SECOND
    return nexted.where(quiet > limit_minutes * 60).select(
        "device_id", F.col("ts").alias("silent_from"), F.col("until").alias("silent_until"), quiet.alias("silent_seconds")
    )


def pump_runs(
    messages: DataFrame, readings: DataFrame, soil_stop: float = 60.0, limit_seconds: int = K.PUMP_LIMIT_SECONDS, **cells
) -> DataFrame:
    """ON..OFF pairs of each device (repeats dropped) with the stop rules they broke.

    ``messages``: device_id, ts, pump, planned_minutes. A run whose OFF never came is left open. At one instant
    OFF goes before ON.
    """
    changes = neighbours(messages, prev=["pump"], then=["pump", "planned_minutes"], **cells).where(
        F.col("prev_pump").isNull() | (F.col("prev_pump") != F.col("pump"))
    )
    runs = (
        neighbours(changes.drop("prev_pump"), next=["ts"], then=["pump"], **cells)
        .where("pump = 'ON'")
        .select("device_id", F.col("ts").alias("on_ts"), F.col("next_ts").alias("off_ts"), "planned_minutes")
    )
    spans = runs.where("off_ts IS NOT NULL").select(
        "device_id", "on_ts", micros("on_ts").alias("span_lo"), (micros("off_ts") - 1).alias("span_hi")
    )
    soaked = readings.where(F.col("soil_moist_pct") >= soil_stop).select("device_id", "ts")
    wet = span_lookup(soaked, spans, ["device_id"], how="inner").groupBy("device_id", "on_ts").agg(F.min("ts").alias("wet_ts"))
    seconds = (micros("off_ts") - micros("on_ts")) / SECOND
    return runs.join(wet, ["device_id", "on_ts"], "left").select(
        "device_id",
        "on_ts",
        "off_ts",
        seconds.alias("run_seconds"),
        F.col("wet_ts").isNotNull().alias("ran_in_wet_soil"),
        F.coalesce(seconds > F.col("planned_minutes") * 60, F.lit(False)).alias("past_planned_end"),
        F.coalesce(seconds > limit_seconds, F.lit(False)).alias("past_limit"),
    )


# --- greedy thinning -------------------------------------------------------------------------------
#
# A reading is kept if it lies at least ``gap`` after the last kept one. That is a chain, but what a
# time cell does to it depends only on one number: the earliest time at which a reading may be kept.
# Each cell is therefore summed up as a step function "earliest time in -> earliest time out"
# (``u``: upper ends of the steps, ``x``: results; beyond the last step the number passes unchanged).
# Step functions of neighbouring cells compose, 32 at a time, up to one per device; going back down
# gives every cell its earliest time, and the cells then keep their readings independently.

FAN_IN = 32
START = -(2**62)
STEP_SCHEMA = "device_id string, cell bigint, u array<bigint>, x array<bigint>"


def _cell_steps(times: np.ndarray, gap: int, cell_end_of_entry: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of one cell. Only entry times below ``cell_end_of_entry`` can occur."""
    entries = min(int(np.searchsorted(times, cell_end_of_entry)) + 1, len(times))
    at = np.arange(entries)
    while True:
        nxt = np.searchsorted(times, times[at] + gap)
        moving = nxt < len(times)
        if not moving.any():
            break
        at = np.where(moving, nxt, at)
    return _merge_steps(times[:entries], times[at] + gap)


def _merge_steps(u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring steps with one result become one step."""
    last = np.append(x[1:] != x[:-1], True)
    return u[last], x[last]


def _apply_steps(u: np.ndarray, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    i = np.searchsorted(u, t)
    return np.where(i < len(u), x[np.minimum(i, len(u) - 1)], t)


def _compose(u1, x1, u2, x2):
    beyond = u2 > u1[-1]
    return _merge_steps(np.concatenate([u1, u2[beyond]]), np.concatenate([_apply_steps(u2, x2, x1), x2[beyond]]))


def thin_readings(readings: DataFrame, gap_seconds: float = 600, cell_seconds: float | None = None) -> DataFrame:
    """Readings at least ``gap_seconds`` apart, chosen greedily from the first one of each device.

    Every group handled in Python is one (device, cell) or 32 step functions. Without ``cell_seconds``
    the cell starts at a day and is halved until no (device, cell) is too large for a task. Cells are
    counted from the first one that occurs, and there are as many levels as the span of cells needs.
    Of readings with equal time one is kept. Rows without a device or a time have no place in a series
    and are left out.
    """
    readings = readings.where("device_id is not null and ts is not null")
    if cell_seconds is None:
        cell_seconds = fit_cell_seconds(readings, ["device_id"], start=24 * 3600)
    gap, width = int(gap_seconds * SECOND), int(cell_seconds * SECOND)
    timed = readings.withColumn("_t", micros("ts"))
    low, high = timed.agg(F.min("_t"), F.max("_t")).first()
    if low is None:
        return readings
    base, levels = low // width, 1
    while FAN_IN**levels < high // width - base + 1:
        levels += 1
    start = F.col("_t") - F.pmod(F.col("_t"), F.lit(width).cast("bigint"))
    celled = timed.withColumn("_c", (F.floor(start / width) - base).cast("bigint"))
    keys = celled.select("device_id", F.col("_c").alias("cell"), F.col("_t").alias("t"))

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["t"].to_numpy())
        u, x = _cell_steps(times, gap, (key[1] + base) * width + gap)
        return pd.DataFrame({"device_id": [key[0]], "cell": [key[1]], "u": [u.tolist()], "x": [x.tolist()]})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        parts = [(np.asarray(u), np.asarray(x)) for u, x in zip(pdf["u"], pdf["x"])]
        u, x = parts[0]
        for u2, x2 in parts[1:]:
            u, x = _compose(u, x, u2, x2)
        return pd.DataFrame({"device_id": [key[0]], "cell": [key[1]], "u": [u.tolist()], "x": [x.tolist()]})

    def descend(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        t, out = np.asarray([pdf["entry"].iloc[0]]), []
        for u, x in zip(pdf["u"], pdf["x"]):
            out.append(int(t[0]))
            t = _apply_steps(np.asarray(u), np.asarray(x), t)
        return pd.DataFrame({"device_id": key[0], "cell": pdf["cell"].to_numpy(), "entry": out})

    parent = F.floor(F.col("cell") / FAN_IN).cast("bigint")
    steps = [cut_lineage(keys.groupBy("device_id", "cell").applyInPandas(summarise, STEP_SCHEMA), "thin-steps")]
    for _ in range(levels):
        up = steps[-1].withColumn("parent", parent)
        steps.append(up.groupBy("device_id", "parent").applyInPandas(merge, STEP_SCHEMA))
    entry = steps[-1].select("device_id", "cell", F.lit(START).cast("bigint").alias("entry"))
    for level in reversed(steps[:-1]):
        child = level.withColumn("parent", parent).join(
            entry.withColumnRenamed("cell", "parent"), ["device_id", "parent"]
        )
        entry = child.groupBy("device_id", "parent").applyInPandas(
            descend, "device_id string, cell bigint, entry bigint"
        )

    columns = readings.columns

    def keep(rows: pa.Table) -> pa.Table:
        times = rows["_t"].to_numpy()
        order = np.argsort(times, kind="stable")
        times, kept = times[order], []
        i = int(np.searchsorted(times, rows["_entry"][0].as_py()))
        while i < len(times):
            kept.append(int(order[i]))
            i = int(np.searchsorted(times, times[i] + gap))
        return rows.take(pa.array(kept, pa.int64())).select(columns)

    entries = entry.withColumnsRenamed({"cell": "_c", "entry": "_entry"})
    return celled.join(entries, ["device_id", "_c"]).groupBy("device_id", "_c").applyInArrow(keep, readings.schema)


def to_series(readings: DataFrame, columns: tuple[str, ...] = ("temp_c", "pressure_hpa", "soil_moist_pct")) -> DataFrame:
    """Long form: one row per reading and series."""
    return readings.unpivot(["device_id", "ts"], list(columns), "series", "value")
