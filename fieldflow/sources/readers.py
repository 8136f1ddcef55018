"""Batch readers. Paths and formats are parameters; schemas are explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fieldflow import schemas
from fieldflow.functions import constants as K
from fieldflow.functions.scalars import dew_point, parse_timestamp
from fieldflow.session import use_utc


def read_table(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> DataFrame:
    reader = use_utc(spark).read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    return reader.format(fmt).load(path)


def existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """First path that exists: a real file goes before a synthetic one."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    return None


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_sensor(spark: SparkSession, paths: Sequence[str], fmt: str = "csv", schema: str = schemas.SENSOR_READING) -> DataFrame:
    path = existing(spark, paths)
    if path is None:
        raise FileNotFoundError(", ".join(paths))
    return read_table(spark, path, schema, fmt)


def read_labels(
    spark: SparkSession,
    paths: Sequence[str],
    fmt: str = "csv",
    schema: str = schemas.RAIN_LABEL,
    required: Sequence[str] = ("ts", "rain_amount_next_60_mm"),
) -> DataFrame:
    """First existing label file. The amount column must be there (pass ``required`` for other targets)."""
    path = existing(spark, paths)
    if path is None:
        raise FileNotFoundError(", ".join(paths))
    return require_columns(read_table(spark, path, schema, fmt), required)


def read_forecast(spark: SparkSession, path: str, fmt: str = "csv", schema: str = schemas.WEATHER_HOUR) -> DataFrame:
    """Hourly forecast. Time, rain and rain chance must be columns of the file itself.

    Columns are taken by name, in any order; others of the schema that the file lacks are null, further ones are left out.
    """
    reader = use_utc(spark).read.format(fmt)
    held = require_columns((reader.option("header", "true") if fmt == "csv" else reader).load(path), ["ts", "api_rain_1h", "api_pop"])
    declared = {f.name: f.dataType for f in StructType.fromDDL(schema)}
    own = StructType([StructField(f.name, declared.get(f.name, f.dataType)) for f in held.schema])
    rows = read_table(spark, path, own, fmt)
    return rows.select(*[F.col(c) if c in held.columns else F.lit(None).cast(t).alias(c) for c, t in declared.items()])


def read_irrigation(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Irrigation intervals; an absent file reads as no intervals."""
    if existing(spark, [path]) is None:
        return spark.createDataFrame([], schemas.IRRIGATION_EVENT)
    return read_table(spark, path, schemas.IRRIGATION_EVENT, fmt)


def harmonize_weather(df: DataFrame) -> DataFrame:
    """Legacy column names to current ones; constants for columns the file does not have."""
    out = df.withColumnsRenamed({k: v for k, v in K.LEGACY_WEATHER_NAMES.items() if k in df.columns})
    for name in ("api_temp_c", "api_rh_pct", "api_uvi"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(K.WEATHER_DEFAULTS[name]))
    return out


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return use_utc(spark).read.schema(schemas.SCHEDULE_JSON).option("multiLine", "true").json(path)


def explode_slots(documents: DataFrame, site_tz: str = "UTC") -> DataFrame:
    """One row per slot of each schedule document, with times parsed."""
    slots = documents.select(F.explode("slots").alias("slot")).select("slot.*")
    return slots.withColumns(
        {c: parse_timestamp(c, site_tz) for c in ("start_ts", "end_ts", "forecast_trigger_ts", "forecast_checked_at")}
    )


def _weather_row(item: str, nested: bool) -> dict:
    f = lambda path, zero: F.coalesce(F.col(f"{item}.{path}"), F.lit(zero))
    first = F.get(F.col(f"{item}.weather"), 0)
    part = {"temp": "main.temp", "humidity": "main.humidity", "pressure": "main.pressure", "wind": "wind.speed", "clouds": "clouds.all"}
    flat = {"temp": "temp", "humidity": "humidity", "pressure": "pressure", "wind": "wind_speed", "clouds": "clouds"}
    at = part if nested else flat
    temp, rh = f(at["temp"], 0.0), f(at["humidity"], 0.0)
    return {
        "ts": F.timestamp_seconds(F.col(f"{item}.dt")),
        "api_temp_c": temp,
        "api_rh_pct": rh,
        "api_pressure_hpa": f(at["pressure"], 0.0),
        "api_uvi": f("uvi", 0.0),
        "api_wind_speed": f(at["wind"], 0.0),
        "api_cloud_pct": f(at["clouds"], 0.0),
        "api_weather_code": F.coalesce(first.getField("id"), F.lit(0)),
        "api_weather_main": F.coalesce(first.getField("main"), F.lit("")),
        "api_weather_desc": F.coalesce(first.getField("description"), F.lit("")),
        "api_dew_point": F.when((temp > 0) & (rh > 0), dew_point(temp, rh)).otherwise(F.lit(0.0)),
        "api_rain_1h": F.coalesce(F.col(f"{item}.rain").getField("1h"), F.lit(0.0)),
        "api_pop": F.lit(0.0) if nested else f("pop", 0.0),
    }


def flatten_current(df: DataFrame, column: str) -> DataFrame:
    """The nested "current weather" document (``main.temp``, ``wind.speed``, ...)."""
    parsed = df.withColumn("_doc", F.from_json(column, schemas.CURRENT_WEATHER_JSON))
    return parsed.select(*[v.alias(k) for k, v in _weather_row("_doc", nested=True).items()])


def flatten_hourly(df: DataFrame, column: str) -> DataFrame:
    """The flat one-call document: its ``current`` row (rain chance of the first hour) and every ``hourly`` row."""
    parsed = df.withColumn("_doc", F.from_json(column, schemas.ONECALL_JSON))
    current = parsed.where("_doc.current IS NOT NULL").select(
        F.col("_doc.current").alias("_item"), F.get(F.col("_doc.hourly"), 0).getField("pop").alias("_pop")
    )
    hourly = parsed.select(F.explode("_doc.hourly").alias("_item"))
    row = _weather_row("_item", nested=False)
    first = {**row, "api_pop": F.coalesce("_pop", F.lit(0.0))}
    return current.select(*[v.alias(k) for k, v in first.items()]).unionByName(
        hourly.select(*[v.alias(k) for k, v in row.items()])
    )
