"""Forecast check ahead of irrigation slots, for all due slots at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.functions.scalars import decide_irrigation, round_to
from fieldflow.operators.features import serving_features
from fieldflow.operators.joins import last_rows_before, overlay, weather_or_defaults
from fieldflow.operators.ordered import micros
from fieldflow.plans.schedule import slot_status, trigger_time


def due_slots(slots: DataFrame, now: Column | None = None, lead_minutes: int = 10, window_minutes: float = 5) -> DataFrame:
    """Unchecked slots whose trigger is within the window of ``now``; without ``now``, every unchecked slot.

    A slot that was checked before is never due again, so a rerun does nothing twice.
    """
    due = slots.withColumn("target_ts", trigger_time("start_ts", lead_minutes))
    if "forecast_checked_at" in slots.columns:
        due = due.where(F.col("forecast_checked_at").isNull())
    if now is None:
        return due
    return due.where(F.abs(micros("target_ts") - micros(now)) <= int(window_minutes * 60_000_000))


def slot_features(due: DataFrame, readings: DataFrame, weather: DataFrame, cadence_seconds: int = 300) -> DataFrame:
    """Serving features of each due slot from its last hour of readings and its nearest weather."""
    targets = due.select("device_id", "target_ts").distinct()
    frames = last_rows_before(targets, readings, K.CADENCE_ROWS[cadence_seconds][0] + 1)
    observed = weather_or_defaults(targets, weather, ts="target_ts")
    return serving_features(frames.join(observed, ["device_id", "target_ts"]), ["device_id", "target_ts"], cadence_seconds)


def check_slots(
    slots: DataFrame,
    readings: DataFrame,
    weather: DataFrame,
    score: Column | Callable[[DataFrame], DataFrame],
    now: Column | None = None,
    lead_minutes: int = 10,
    cadence_seconds: int = 300,
) -> DataFrame:
    """Slots with forecast, advice and status on those that were due.

    ``score`` is the probability as a column over the features, or a function that adds ``probability`` and,
    if it can, ``rain_amount_mm`` to the feature rows, as a fitted model does. A due slot without usable
    readings keeps a null probability and is confirmed by default.
    """
    due = due_slots(slots, now, lead_minutes)
    features = slot_features(due, readings, weather, cadence_seconds)
    scored = score(features) if callable(score) else features.withColumn("probability", score)
    if "rain_amount_mm" not in scored.columns:
        scored = scored.withColumn("rain_amount_mm", F.lit(None).cast("double"))
    scored = due.join(scored, ["device_id", "target_ts"], "left")
    advice = decide_irrigation("last_soil_moist_pct", "probability")
    failed = F.col("probability").isNull()
    updates = scored.select(
        "device_id",
        "start_ts",
        round_to("probability", 4).alias("probability"),
        round_to("rain_amount_mm", 2).alias("rain_amount_mm"),
        F.when(failed, F.lit(True)).otherwise(advice["should_irrigate"]).alias("should_irrigate"),
        F.when(failed, F.lit("Lỗi dự báo. Tưới theo lịch mặc định.")).otherwise(advice["reason"]).alias("forecast_reason"),
        (now if now is not None else F.col("target_ts")).alias("forecast_checked_at"),
    ).withColumn("decision", F.lit(None).cast("string"))
    return overlay(slots, slot_status(updates).drop("decision"))
