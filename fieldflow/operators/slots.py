"""What a device does with its slots, one after the other, without a task that sees all of them.

A slot's outcome depends on the slots before it through one number only: until when the pump is busy.
Each slot is therefore a step function "busy until, before" -> "busy until, after" (``u``: upper ends of
the steps, ``x``: results, ``SAME`` where the number passes unchanged, as it does beyond the last step).
Slots are numbered per device; functions of 32 slots in a row compose to one, 32 of those to the next, up
to one per device. The way back down gives every 32 slots their number, and these are then walked alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.operators.ordered import micros, row_index
from fieldflow.operators.spans import SECOND, contained_pairs
from fieldflow.session import cut_lineage

FAN_IN = 32
SAME = -(2**63)
FREE = -(2**62)
Steps = tuple[np.ndarray, np.ndarray]
UNCHANGED: Steps = (np.empty(0, np.int64), np.empty(0, np.int64))


def _value(steps: Steps, t: np.ndarray) -> np.ndarray:
    """Result of the step that ``t`` lies in, ``SAME`` where it passes."""
    u, x = steps
    return np.append(x, SAME)[np.searchsorted(u, t)]


def _apply(steps: Steps, t: np.ndarray) -> np.ndarray:
    found = _value(steps, t)
    return np.where(found == SAME, t, found)


def _tidy(u: np.ndarray, x: np.ndarray, limit: int) -> Steps:
    """Steps up to the one that holds ``limit``; neighbours with one result become one step."""
    reach = int(np.searchsorted(u, limit)) + 1
    u, x = u[:reach], x[:reach]
    last = np.append(x[1:] != x[:-1], True) if len(x) else np.empty(0, bool)
    u, x = u[last], x[last]
    return (u[:-1], x[:-1]) if len(x) and x[-1] == SAME else (u, x)


def _compose(first: Steps, then: Steps, limit: int) -> Steps:
    ends = np.union1d(first[0], then[0])
    middle = _value(first, ends)
    return _tidy(ends, np.where(middle == SAME, _value(then, ends), _apply(then, middle)), limit)


def _slot_steps(times: np.ndarray, dry: np.ndarray, run: int | None, limit: int) -> Steps:
    """A slot's function: the first reading at which the pump is free starts it if the soil is dry."""
    times, first = np.unique(times, return_index=True)
    stop = np.full(len(times), FREE) if run is None else times + run
    return _tidy(times, np.where(dry[first], stop, SAME), limit)


def _slots_of(pdf: pd.DataFrame):
    """(number, start, run, times, soil) of each slot of a group, in order. A row at ``SAME`` stands for the slot."""
    soil = pdf["soil"].to_numpy(float)
    rn, t, start, run = (pdf[c].to_numpy(np.int64) for c in ("rn", "t", "start", "run"))
    order = np.lexsort((soil, ~np.isnan(soil), t, rn))
    soil, rn, t, start, run = soil[order], rn[order], t[order], start[order], run[order]
    heads = np.flatnonzero(np.append(True, rn[1:] != rn[:-1]))
    for i, j in zip(heads, np.append(heads[1:], len(rn))):
        yield int(rn[i]), int(start[i]), None if run[i] == SAME else int(run[i]), t[i + 1 : j], soil[i + 1 : j]


def audit_slots(slots: DataFrame, readings: DataFrame, soil_ref: float = K.SLOT_SOIL_REF) -> DataFrame:
    """What the device would do with each slot.

    The first reading inside [start, end) at which no pump runs decides: soil under the reference starts
    the pump, else the slot is skipped. Without readings a slot was missed; if the pump of earlier slots ran
    at all of them, it is ``blocked``. A pump runs for its slot's minutes, also over midnight; without minutes
    it runs for no time. Slots without device, start or end meet no reading and are missed. A reading without
    soil does not start the pump.

    A group in Python holds 32 slots with their readings, or 32 step functions. A pump that runs when a slot
    starts was started at most the longest slot and its minutes before, so a function ends there.
    """
    numbered = cut_lineage(
        row_index(
            slots.select("device_id", "start_ts", "end_ts", "duration_min"),
            ["device_id"], ["start_ts", "end_ts", "duration_min"], "_rn",
        ),
        "slots",
    )
    run = (F.col("duration_min") * F.lit(60.0 * SECOND)).cast("bigint")
    count, longest = numbered.agg(
        F.max("_rn"), F.max(micros("end_ts") - micros("start_ts") + F.coalesce(run, F.lit(0)))
    ).first()
    count, longest, levels = count or 0, longest or 0, 0
    while FAN_IN ** (levels + 1) < count:
        levels += 1

    known = numbered.where("device_id is not null")
    no_time = F.lit(SAME).cast("bigint")
    marks = known.select(
        "device_id", F.col("_rn").alias("rn"), no_time.alias("t"), F.lit(None).cast("double").alias("soil"),
        F.coalesce(micros("start_ts"), no_time).alias("start"), F.coalesce(run, no_time).alias("run"),
    )
    whole = known.where("start_ts is not null and end_ts > start_ts").select("device_id", "_rn", "start_ts", "end_ts")
    seen = contained_pairs(whole, readings.select("device_id", "ts", "soil_moist_pct"), "start_ts", "end_ts").select(
        "device_id", F.col("_rn").alias("rn"), micros("ts").alias("t"),
        F.col("soil_moist_pct").cast("double").alias("soil"), no_time.alias("start"), no_time.alias("run"),
    )
    node = F.floor((F.col("rn") - 1) / FAN_IN).cast("bigint")
    rows = cut_lineage(marks.unionByName(seen).withColumn("node", node), "slot-readings")

    device = slots.schema["device_id"].dataType.simpleString()
    step_schema = f"device_id {device}, node bigint, lim bigint, u array<bigint>, x array<bigint>"

    def summary(key: tuple, limit: int, steps: Steps) -> pd.DataFrame:
        return pd.DataFrame(
            {"device_id": [key[0]], "node": [key[1]], "lim": [limit], "u": [steps[0].tolist()], "x": [steps[1].tolist()]}
        )

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        steps, limit = UNCHANGED, FREE
        for _, start, minutes, times, soil in _slots_of(pdf):
            if start != SAME:
                own = start + longest
                limit = own if limit == FREE else limit
                steps = _compose(steps, _slot_steps(times, soil < soil_ref, minutes, own), limit)
        return summary(key, limit, steps)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        met = pdf.loc[pdf["lim"] != FREE, "lim"]
        limit, steps = (int(met.iloc[0]) if len(met) else FREE), UNCHANGED
        for u, x in zip(pdf["u"], pdf["x"]):
            steps = _compose(steps, (np.asarray(u, np.int64), np.asarray(x, np.int64)), limit)
        return summary(key, limit, steps)

    def descend(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        t, out = np.asarray([pdf["entry"].iloc[0]]), []
        for u, x in zip(pdf["u"], pdf["x"]):
            out.append(int(t[0]))
            t = _apply((np.asarray(u, np.int64), np.asarray(x, np.int64)), t)
        return pd.DataFrame({"device_id": key[0], "node": pdf["node"].to_numpy(), "entry": out})

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        busy, out = int(pdf["entry"].iloc[0]), []
        for rn, _, minutes, times, soil in _slots_of(pdf):
            i = int(np.searchsorted(times, busy))
            at = i if i < len(times) else 0
            if not len(times):
                out.append((key[0], rn, None, None, "missed"))
                continue
            outcome = "blocked" if i == len(times) else "started" if soil[i] < soil_ref else "skipped"
            if outcome == "started":
                busy = FREE if minutes is None else int(times[i]) + minutes
            out.append((key[0], rn, int(times[at]), soil[at], outcome))
        done = pd.DataFrame(out, columns=["device_id", "_rn", "checked", "soil_at_start", "outcome"])
        return done.astype({"checked": "Int64"})

    parent = F.floor(F.col("node") / FAN_IN).cast("bigint")
    steps = [cut_lineage(rows.groupBy("device_id", "node").applyInPandas(summarise, step_schema), "slot-steps")]
    for _ in range(levels):
        up = steps[-1].withColumn("parent", parent)
        steps.append(up.groupBy("device_id", "parent").applyInPandas(merge, step_schema))
    entry = steps[-1].select("device_id", "node", F.lit(FREE).cast("bigint").alias("entry"))
    for level in reversed(steps[:-1]):
        child = level.withColumn("parent", parent).join(entry.withColumnRenamed("node", "parent"), ["device_id", "parent"])
        entry = child.groupBy("device_id", "parent").applyInPandas(descend, f"device_id {device}, node bigint, entry bigint")
    walked = (
        rows.join(entry, ["device_id", "node"])
        .groupBy("device_id", "node")
        .applyInPandas(walk, f"device_id {device}, _rn bigint, checked bigint, soil_at_start double, outcome string")
    )
    return numbered.join(walked, ["device_id", "_rn"], "left").select(
        "device_id",
        F.to_date("start_ts").alias("date"),
        "start_ts",
        "end_ts",
        "duration_min",
        F.timestamp_micros("checked").alias("checked_ts"),
        "soil_at_start",
        F.coalesce("outcome", F.lit("missed")).alias("outcome"),
    )
