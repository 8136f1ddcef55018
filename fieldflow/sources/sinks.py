"""Batch sinks and report shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldflow.functions.scalars import clock, day_minute, round_two


def append_rows(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def newest_payload(slots: DataFrame, keys: Sequence[str] = ("device_id", "date"), at: str = "payload_ts") -> DataFrame:
    """Of each key the slots of its newest payload alone, where ``at`` tells payloads apart."""
    newest = slots.groupBy(*keys).agg(F.max(at).alias("_newest"))
    return slots.join(newest, list(keys)).where(F.col(at) == F.col("_newest")).drop("_newest", at)


def replace_dates(df: DataFrame, path: str, keys: Sequence[str] = ("device_id", "date")) -> None:
    """Overwrite only the partitions (by default a device's date) that occur in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def replaced_dates(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("device_id", "date")) -> DataFrame:
    """The table that ``replace_dates`` leaves behind, as a query."""
    replaced = incoming.select(*keys).distinct()
    return stored.join(replaced, list(keys), "left_anti").unionByName(incoming)


def sensor_report(readings: DataFrame, site_tz: str = "UTC") -> DataFrame:
    """Report columns in time order (the order is by instant, not by the formatted text)."""
    return readings.orderBy("ts", "device_id").select(
        day_minute("ts", site_tz).alias("date_time"),
        round_two("temp_c").alias("temperature"),
        round_two("rh_pct").alias("humidity"),
        round_two("pressure_hpa").alias("pressure_hpa"),
        round_two("soil_moist_pct").alias("soil_moisture"),
    )


def slot_note(start: str = "start_ts", end: str = "end_ts", minutes: str = "duration_min"):
    return F.format_string("Tưới %d phút [%s - %s]", F.col(minutes), clock(start), clock(end))


def schedule_rows(slots: DataFrame) -> DataFrame:
    """Stored form of a slot: local date, note, and the decision (missing means yes)."""
    return slots.select(
        "device_id",
        "start_ts",
        "end_ts",
        "duration_min",
        F.date_format("start_ts", "yyyy-MM-dd").alias("date"),
        F.coalesce(F.col("decision") == "confirm", F.lit(True)).alias("decision")
        if "decision" in slots.columns
        else F.lit(True).alias("decision"),
        slot_note().alias("note"),
    ).where(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())


def schedule_report(rows: DataFrame) -> DataFrame:
    return rows.orderBy("date", "start_ts", "device_id").select(
        "date", clock("start_ts").alias("start"), clock("end_ts").alias("end"), "duration_min", "note"
    )


def write_report(report: DataFrame, path: str, bom: bool = False) -> None:
    """CSV with a header. ``bom`` marks the header's first name for spreadsheet programs."""
    out = report.withColumnRenamed(report.columns[0], "﻿" + report.columns[0]) if bom else report
    out.write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)


def forecast_rows(payloads: DataFrame) -> DataFrame:
    """Flat forecast rows from nested payloads."""
    return payloads.select(
        F.col("timestamp").alias("date"),
        F.col("predictions.rain_60min.probability").alias("chance_of_rain"),
        F.col("recommendation.reason").alias("reason"),
        F.col("recommendation.should_irrigate").alias("should_irrigate"),
        F.col("slot_id").alias("slot_time"),
    )


def decision_rows(slots: DataFrame) -> DataFrame:
    """One row per slot that carries a decision."""
    return slots.where(F.col("decision").isNotNull() & (F.col("decision") != "")).select(
        F.col("forecast_trigger_ts").alias("date"),
        (F.col("decision") == "confirm").alias("decision"),
        F.col("decision_reason").alias("reason"),
    )


def audit_rows(df: DataFrame, actor, event, details, created_at) -> DataFrame:
    return df.select(actor.alias("actor"), event.alias("event"), details.alias("details"), created_at.alias("created_at"))
