"""Keyed stream state: bounded reading buffers and device sessions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldflow.functions import constants as K
from fieldflow.operators.ordered import micros, neighbours
from fieldflow.operators.spans import SECOND

FIELDS = ["ts", *K.BASE_COLUMNS]
BUFFER_SCHEMA = "device_id string, buffer_rows int, rows array<struct<ts: timestamp, temp_c: double, rh_pct: double, pressure_hpa: double, soil_moist_pct: double>>"


def _newest(frames: list[pd.DataFrame], size: int) -> pd.DataFrame:
    joined = pd.concat(frames).drop_duplicates(["device_id", "t"], keep="last")
    return joined.sort_values("t").groupby("device_id", sort=False).tail(size)


def prune_to_newest(readings: DataFrame, size: int = 24) -> DataFrame:
    """Keep each device's newest rows of every input partition: all a buffer can use, and no more is shuffled.

    A device that sends most of the rows thus contributes ``size`` rows per partition.
    """
    slim = readings.select("device_id", F.unix_micros("ts").alias("t"), *K.BASE_COLUMNS)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            kept = _newest([pdf] if kept is None else [kept, pdf], size)
        if kept is not None:
            yield kept

    return slim.mapInPandas(prune, slim.schema)


def buffer_stream(readings: DataFrame, size: int = 24, ready: int = 12) -> DataFrame:
    """The newest ``size`` readings of each device, sent out after every micro-batch once ``ready`` are there."""
    fields = ["t", *K.BASE_COLUMNS]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pd.DataFrame(json.loads(state.get[0]), columns=fields).assign(device_id=key[0])] if state.exists else []
        for pdf in batches:
            held = [_newest([*held, pdf], size)]
        buffer = held[0][fields]
        state.update((json.dumps(buffer.to_numpy(dtype=object).tolist()),))
        if len(buffer) >= ready:
            yield pd.DataFrame(
                {"device_id": [key[0]], "buffer_rows": [len(buffer)], "buffer": [json.dumps(buffer.to_dict("records"))]}
            )

    out = (
        prune_to_newest(readings, size)
        .groupBy("device_id")
        .applyInPandasWithState(
            update, "device_id string, buffer_rows int, buffer string", "buffer string", "append", GroupStateTimeout.NoTimeout
        )
    )
    item = "array<struct<t: bigint, temp_c: double, rh_pct: double, pressure_hpa: double, soil_moist_pct: double>>"
    return out.withColumn("rows", F.from_json("buffer", item)).drop("buffer")


def buffer_frames(buffers: DataFrame) -> DataFrame:
    """Buffers as frames for ``serving_features``, keyed by device and the buffer's last time."""
    last = F.timestamp_micros(F.array_max(F.transform("rows", lambda r: r["t"])))
    return buffers.select("device_id", last.alias("target_ts"), F.explode("rows").alias("r")).select(
        "device_id", "target_ts", F.timestamp_micros("r.t").alias("ts"), *[f"r.{c}" for c in K.BASE_COLUMNS]
    )


def session_stream(messages: DataFrame, silence: str = "6 seconds", late: str = "10 minutes") -> DataFrame:
    """Device sessions from status messages, sent out once the watermark has passed their silence.

    With ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` (``build_session`` sets it)
    sessions are merged inside each partition before the shuffle, so a busy device sends few rows.
    """
    return (
        messages.withWatermark("ts", late)
        .groupBy("device_id", F.session_window("ts", silence))
        .agg(
            F.min("ts").alias("session_start"),
            F.max("ts").alias("session_end"),
            F.count(F.lit(1)).alias("messages"),
            F.max(F.struct("ts", "status"))["status"].alias("last_status"),
        )
        .drop("session_window")
    )


def silence_stream(readings: DataFrame, limit_minutes: float = 15.0, late: str = "10 minutes") -> DataFrame:
    """A warning for each time a device says nothing for longer than the limit, sent out once the watermark is past it.

    ``awake_from`` and ``silent_from`` are the first and last reading before the silence, ``warned_at`` the moment
    the limit was passed. Only event time decides: a replay warns of the same silences, however the readings are cut
    into micro-batches, and a reading that comes late, but within ``late``, ends a silence before it is warned of.
    State is one open run of readings per device (a null device is one too); runs are merged inside each partition
    before the shuffle. Readings without a time are left out.
    """
    limit = F.expr(f"INTERVAL '{limit_minutes * 60:.6f}' SECOND")
    return (
        readings.where("ts is not null")
        .select("device_id", "ts")
        .withWatermark("ts", late)
        .groupBy("device_id", F.session_window("ts", f"{round(limit_minutes * 60_000_000)} microseconds"))
        .agg(
            F.min("ts").alias("awake_from"),
            F.max("ts").alias("silent_from"),
            F.count(F.lit(1)).alias("readings"),
        )
        .select("device_id", "awake_from", "silent_from", (F.col("silent_from") + limit).alias("warned_at"), "readings")
    )


def silences(warnings: DataFrame, now: Column, **cells) -> DataFrame:
    """Warnings of ``silence_stream`` with the end of each silence: the device's next reading, or ``now``.

    A silence that had not passed the limit by ``now`` is left out: the stream may know more than ``now`` does.
    """
    paired = neighbours(warnings.drop("readings"), ts="silent_from", next=["awake_from"], **cells)
    until = F.coalesce("next_awake_from", now)
    return paired.where(until > F.col("warned_at")).select(
        "device_id",
        "silent_from",
        until.alias("silent_until"),
        ((micros(until) - micros("silent_from")) / SECOND).alias("silent_seconds"),
    )


def presence_stream(messages: DataFrame, silence_seconds: float = 6.0) -> DataFrame:
    """``device_id``, ``ts``, ``status`` whenever a device's state changes; silence makes it offline by a timer.

    The state holds one device's last status and time. A timer on the clock fires ``silence_seconds`` after
    a device's last message whether or not anything else arrives, so the trigger must keep running. Of each
    input partition only a device's newest message is shuffled.
    """

    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            both = pdf if kept is None else pd.concat([kept, pdf])
            kept = both.sort_values("ts", kind="stable").drop_duplicates("device_id", keep="last")
        if kept is not None:
            yield kept

    def change(device: str, ts, status: str) -> pd.DataFrame:
        return pd.DataFrame({"device_id": [device], "ts": [ts], "status": [status]})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, micros = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            if status == "online":
                yield change(key[0], pd.Timestamp(micros, unit="us") + pd.Timedelta(seconds=silence_seconds), "offline")
            return
        latest = pd.concat(list(batches)).sort_values("ts", kind="stable").iloc[-1]
        at = int(pd.Timestamp(latest["ts"]).value // 1000)
        if at >= micros:
            if latest["status"] != status:
                yield change(key[0], latest["ts"], latest["status"])
            state.update((latest["status"], at))
        else:
            state.update((status, micros))
        state.setTimeoutDuration(int(silence_seconds * 1000))

    slim = messages.select("device_id", "ts", "status")
    return (
        slim.mapInPandas(newest, slim.schema)
        .groupBy("device_id")
        .applyInPandasWithState(
            update, "device_id string, ts timestamp, status string", "status string, micros bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
        )
    )
