"""Sensor and weather tables as a deterministic view of the ``events`` table.

The test tables hold no sensor data; every column below is arithmetic on ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldflow.session import use_utc


EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = use_utc(spark).read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sensor_columns() -> dict:
    e = F.col("event_id")
    return {
        "device_id": F.concat(F.lit("esp32-0"), F.col("user_id") % 4),
        "temp_c": 18 + ((e * 37) % 170) / 10,
        "rh_pct": 40 + ((e * 53) % 550) / 10,
        "pressure_hpa": 1000 + ((e * 29) % 200) / 10,
        "soil_moist_pct": 15 + ((F.dayofmonth("ts") * 7) % 40) + ((e * 41) % 100) / 10,
        "rain_mm_5min": F.when(F.col("event_type") == "error", F.col("value") / 100).otherwise(F.lit(0.0)),
    }


def sensor_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sensor_columns()
    return events(spark, sf_dir).select("ts", *[v.alias(k) for k, v in c.items()])


def keyed_sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the event's own columns kept."""
    return events(spark, sf_dir).withColumns(sensor_columns())


def weather_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = (
        events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.min("event_id").alias("m"))
    )
    m = F.col("m")
    return hours.select(
        "ts",
        F.when((m * 31) % 10 < 1, ((m * 17) % 60) / 10).otherwise(F.lit(0.0)).alias("api_rain_1h"),
        (((m * 13) % 100) / 100).alias("api_pop"),
        (18 + (m % 150) / 10).alias("api_temp_c"),
        (40 + (m % 500) / 10).alias("api_rh_pct"),
        (m % 11).cast("double").alias("api_uvi"),
        (500 + 100 * ((F.dayofmonth("ts") + m % 2) % 4)).cast("int").alias("api_weather_code"),
    )
