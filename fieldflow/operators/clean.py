"""Cleaning, validation, profiling and merging of telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.functions.scalars import parse_timestamp, round_two, soil_percent
from fieldflow.operators.ordered import exact_median, micros, neighbours
from fieldflow.session import cut_lineage

KEY = ("device_id", "ts")


def normalize_telemetry(messages: DataFrame, site_tz: str = "UTC", device: str = K.DEFAULT_DEVICE_ID) -> DataFrame:
    """Parsed messages to canonical names. Both spellings of device and pressure are read; gaps become 0."""
    pick = lambda *names: [F.col(n) for n in names if n in messages.columns]
    return messages.select(
        parse_timestamp("timestamp", site_tz).alias("ts"),
        F.coalesce(*pick("device_id", "deviceId"), F.lit(device)).alias("device_id"),
        F.coalesce(*pick("temperature"), F.lit(0.0)).alias("temp_c"),
        F.coalesce(*pick("humidity"), F.lit(0.0)).alias("rh_pct"),
        F.coalesce(*pick("pressure_hpa", "pressure"), F.lit(0.0)).alias("pressure_hpa"),
        F.coalesce(*pick("soilMoisture"), F.lit(0.0)).alias("soil_moist_pct"),
    )


def drop_empty(readings: DataFrame) -> DataFrame:
    empty = (F.col("temp_c") == 0) & (F.col("rh_pct") == 0) & (F.col("soil_moist_pct") == 0)
    return readings.where(~empty)


def reject_reason(messages: DataFrame) -> Column:
    """Name of the first required field a message lacks, or null. Either pressure spelling will do."""
    pressure = F.coalesce(*[F.col(c) for c in ("pressure_hpa", "pressure") if c in messages.columns])
    checks = [("temperature", F.col("temperature")), ("humidity", F.col("humidity")), ("pressure", pressure), ("soilMoisture", F.col("soilMoisture"))]
    return F.coalesce(*[F.when(c.isNull(), F.lit(f"missing {name}")) for name, c in checks])


def validate_telemetry(messages: DataFrame) -> DataFrame:
    """Messages with a ``reject_reason`` (null = accepted); nothing is lost."""
    return messages.withColumn("reject_reason", reject_reason(messages))


def standardize(readings: DataFrame) -> DataFrame:
    """The six standard columns; pressure from ``pressure`` or the standard atmosphere."""
    options = [F.col(c) for c in ("pressure_hpa", "pressure") if c in readings.columns]
    pressure = options[0] if options else F.lit(K.DEFAULT_PRESSURE_HPA)
    return readings.select(
        F.col("ts").cast("timestamp").alias("ts"),
        "device_id",
        "temp_c",
        "rh_pct",
        pressure.alias("pressure_hpa"),
        "soil_moist_pct",
    )


def trailing_window(readings: DataFrame, days: int = 60, by: Sequence[str] = ("device_id",)) -> DataFrame:
    """Rows within ``days`` of the latest reading, per key or (``by=[]``) over all.

    The table of latest times is written first: its known size decides between broadcast and shuffle.
    """
    span = F.make_dt_interval(days=F.lit(days))
    if not by:
        return readings.where(F.col("ts") >= readings.select(F.max("ts")).scalar() - span)
    latest = cut_lineage(readings.groupBy(*by).agg(F.max("ts").alias("_latest")), "latest")
    return readings.join(latest, list(by)).where(F.col("ts") >= F.col("_latest") - span).drop("_latest")


LOOKBACKS = {"3h": 3, "24h": 24, "3d": 72, "7d": 168}


def lookback(readings: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return readings.where(F.col("ts").between(now - F.make_dt_interval(hours=F.lit(hours)), now))


def lookback_counts(readings: DataFrame, now: Column) -> DataFrame:
    """Readings and mean temperature per lookback range, in one pass over the widest range."""
    ranges = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("hours")) for n, h in LOOKBACKS.items()])
    age = micros(now) - micros("ts")
    return (
        lookback(readings, now, max(LOOKBACKS.values()))
        .withColumn("age", age)
        .withColumn("r", F.explode(ranges))
        .where(F.col("age") <= F.col("r.hours").cast("bigint") * 3_600_000_000)
        .groupBy(F.col("r.name").alias("range"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("temp_c").alias("temp_mean"))
    )


def formatted_readings(readings: DataFrame, site_tz: str = "UTC") -> DataFrame:
    local = F.from_utc_timestamp("ts", site_tz)
    return readings.select(
        "device_id",
        F.date_format(local, "dd/MM/yyyy HH:mm").alias("minute_text"),
        F.date_format(local, "dd/MM/yyyy HH:mm:ss").alias("second_text"),
        *[round_two(c).alias(c) for c in K.BASE_COLUMNS],
    )


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows and violations per rule, from one scan. A rule is a condition that must hold; null violates."""
    broken = [F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(name) for name, ok in rules.items()]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *broken)
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return one.select("_n", F.explode(pairs).alias("p")).select("p.rule", F.col("_n").alias("n_rows"), "p.violations")


def forecast_rules() -> dict[str, Column]:
    return {
        "forecast_date_required": F.col("date").isNotNull(),
        "forecast_slot_time_required": F.col("slot_time").isNotNull(),
        "forecast_chance_in_unit_range": F.col("chance_of_rain").isNull() | F.col("chance_of_rain").between(0, 1),
    }


def audit_rules() -> dict[str, Column]:
    return {
        "audit_actor_required": F.length(F.trim("actor")) > 0,
        "audit_event_known": F.col("event").isin(*K.AUDIT_EVENTS),
        "audit_details_required": F.length(F.trim("details")) > 0,
    }


def account_rules() -> dict[str, Column]:
    required = ["password", "email", "full_name", "address", "phone_number"]
    return {
        "account_username_min_length": F.length(F.trim("username")) >= 3,
        **{f"account_{c}_required": F.length(F.trim(c)) > 0 for c in required},
        "account_email_suffix": F.endswith(F.trim("email"), F.lit(K.EMAIL_SUFFIX)),
        "account_role_known": F.col("role").isin(*K.ACCOUNT_ROLES),
    }


def public_accounts(accounts: DataFrame) -> DataFrame:
    """Every account column but the password, by allow-list."""
    return accounts.select("username", "email", "full_name", "address", "phone_number", "role")


def status_bands(readings: DataFrame) -> DataFrame:
    """Rows per band of each measure."""
    from fieldflow.functions.scalars import band

    measures = F.array(
        *[
            F.struct(F.lit(c).alias("measure"), band(c, steps).alias("band"))
            for c, steps in K.STATUS_BANDS.items()
        ]
    )
    return (
        readings.select(F.explode(measures).alias("m"))
        .groupBy("m.measure", "m.band")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def calibrate_soil(df: DataFrame, raw: str) -> DataFrame:
    return df.withColumn("soil_moist_pct", soil_percent(raw))


def sampling_interval(readings: DataFrame, warn_seconds: float = 20.0, **cells) -> DataFrame:
    """Median positive gap between neighbouring readings of a device."""
    gaps = (
        neighbours(readings.select(*KEY), prev=["ts"], **cells)
        .withColumn("gap_us", micros("ts") - micros("prev_ts"))
        .where("gap_us > 0")
    )
    return exact_median(gaps, ["device_id"], "gap_us").select(
        "device_id",
        "n",
        (F.col("median") / 1_000_000).alias("median_seconds"),
        (F.col("median") / 1_000_000 > warn_seconds).alias("sparse"),
    )


def time_profile(tables: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """Rows and time range of each named table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(
            F.lit(name).alias("table_name"), "n", "first_ts", "last_ts"
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_count(df: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("distinct_keys")
    )


def keep_last(tables: Sequence[DataFrame], keys: Sequence[str] = KEY, recency: Sequence[str] = ()) -> DataFrame:
    """Union of the tables with one row per key: the later table wins, then the higher ``recency`` columns.

    ``row_number = 1`` prunes copies on the map side, so a key with very many copies stays cheap.
    """
    out = None
    for priority, df in enumerate(tables):
        tagged = df.withColumn("_priority", F.lit(priority))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    newest = Window.partitionBy(*keys).orderBy(F.desc("_priority"), *[F.desc(c) for c in recency])
    return out.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank", "_priority")


def latest_rows(df: DataFrame, n: int = 12, by: Sequence[str] = ("device_id",), ts: str = "ts") -> DataFrame:
    newest = Window.partitionBy(*by).orderBy(F.desc(ts))
    return df.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def latest_reading(df: DataFrame, by: Sequence[str] = ("device_id",), ts: str = "ts") -> DataFrame:
    return latest_rows(df, 1, by, ts).drop("recency")
