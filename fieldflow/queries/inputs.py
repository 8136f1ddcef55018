"""Inputs the queries share, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.operators import joins, labels
from fieldflow.plans import planning
from fieldflow.session import cut_lineage, use_utc
from fieldflow.sources import adapter, sinks


def plan_date(ts: str):
    """Spreads the month of data over all seasons; distinct days stay distinct."""
    day = F.to_date(ts)
    return F.date_add(day, 30 * (F.dayofmonth(day) % 12))


def plans(spark: SparkSession, d: str) -> DataFrame:
    daily = planning.daily_forecast(adapter.weather_hour(spark, d))
    forecast = daily.withColumn("date", plan_date("date"))
    soil = (
        adapter.sensor_reading(spark, d)
        .groupBy("device_id", plan_date("ts").alias("date"))
        .agg(F.avg("soil_moist_pct").alias("soil_moist_mean"))
    )
    return planning.build_day_plans(forecast, soil)


def slots(spark: SparkSession, d: str) -> DataFrame:
    return planning.plan_slots(plans(spark, d))


def decided_slots(spark: SparkSession, d: str) -> DataFrame:
    third = F.dayofmonth("start_ts") % 3
    return slots(spark, d).withColumns(
        {
            "decision": F.when(third == 0, "confirm").when(third == 1, "postpone"),
            "decision_reason": F.concat(F.lit("r"), third),
            "forecast_trigger_ts": F.col("start_ts") - F.make_dt_interval(mins=F.lit(10)),
        }
    )


def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """The stored schedule table."""
    return cut_lineage(sinks.schedule_rows(decided_slots(spark, d)), "schedule")


def rain_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label table, written once: everything after it reads the file, as a training run would."""
    return cut_lineage(
        labels.rain_labels(adapter.sensor_reading(spark, d), adapter.weather_hour(spark, d)), "rain-labels"
    )


def weather_joined(spark: SparkSession, d: str, readings: DataFrame | None = None) -> DataFrame:
    base = adapter.sensor_reading(spark, d) if readings is None else readings
    return joins.fill_weather(joins.join_weather(base, adapter.weather_hour(spark, d)))


def irrigation(spark: SparkSession, d: str) -> DataFrame:
    """The irrigation event table, written once. Only readings that could start one are labelled."""
    dry = labels.irrigation_candidates(adapter.sensor_reading(spark, d))
    ahead = labels.rain_labels(dry, adapter.weather_hour(spark, d))
    return cut_lineage(labels.irrigation_events(dry, ahead), "irrigation")


def score(rh: str = "rh_pct"):
    """A fixed logistic score of humidity: a model whose output both engines can compute."""
    return F.round(1 / (1 + F.exp(-(F.col(rh) - 67) / 10)), 2)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return adapter.sensor_reading(spark, d).select(
        "device_id", "ts", (F.col("rain_mm_5min") > 0).cast("int").alias("y"), score().alias("p")
    )


def telemetry_json(spark: SparkSession, d: str) -> DataFrame:
    """Messages with both spellings, omitted fields, empty readings and mixed time formats."""
    e = F.col("event_id")
    empty = e % 25 == 7
    local = F.date_format(F.from_utc_timestamp("ts", K.SITE_TZ), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zulu = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    value = lambda c, gap: F.when(empty, F.lit(0.0)).when(e % gap != 0, F.col(c))
    pressure = F.when((e % 35 != 0) | empty, F.col("pressure_hpa"))
    body = F.to_json(
        F.struct(
            F.when(e % 6 < 3, F.col("device_id")).alias("deviceId"),
            F.when((e % 6 >= 3) & (e % 6 < 5), F.col("device_id")).alias("device_id"),
            value("temp_c", 10).alias("temperature"),
            value("rh_pct", 15).alias("humidity"),
            F.when(e % 2 == 0, pressure).alias("pressure_hpa"),
            F.when(e % 2 == 1, pressure).alias("pressure"),
            value("soil_moist_pct", 45).alias("soilMoisture"),
            F.when(e % 3 == 0, zulu).when(e % 3 == 1, F.concat(local, F.lit("+07:00"))).otherwise(local).alias("timestamp"),
        )
    )
    return adapter.keyed_sensor(spark, d).select("event_id", body.alias("body"))


def forecast_payloads(spark: SparkSession, d: str) -> DataFrame:
    from fieldflow import schemas

    e = F.col("event_id")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    body = F.to_json(
        F.struct(
            text("ts").alias("timestamp"),
            F.when(e % 9 != 0, text(F.date_trunc("hour", "ts"))).alias("slot_id"),
            F.struct(F.struct(score().alias("probability")).alias("rain_60min")).alias("predictions"),
            F.struct((e % 2 == 0).alias("should_irrigate"), F.concat(F.lit("k"), F.col("user_id") % 5).alias("reason")).alias(
                "recommendation"
            ),
        )
    )
    messages = adapter.keyed_sensor(spark, d).select(F.from_json(body, schemas.FORECAST_JSON).alias("m"))
    return messages.select("m.*")


def accounts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return use_utc(spark).read.schema(schema).parquet(f"{d}/customer.parquet").select(
        F.col("c_name").alias("username"),
        F.lit("secret").alias("password"),
        F.concat(
            F.lower(F.replace("c_name", F.lit("#"), F.lit("."))),
            F.when(k % 3 == 0, "@example.com").otherwise("@gmail.com"),
        ).alias("email"),
        F.col("c_name").alias("full_name"),
        F.when(k % 17 == 0, "").otherwise(F.col("c_mktsegment")).alias("address"),
        k.cast("string").alias("phone_number"),
        F.when(k % 11 == 0, "ROOT").when(k % 10 == 0, "ADMIN").otherwise("USER").alias("role"),
    )


def audit(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("click", "view", "signup", "purchase")
    event = None
    for kind, text in zip(kinds, K.AUDIT_EVENTS):
        event = F.when(F.col("event_type") == kind, text) if event is None else event.when(F.col("event_type") == kind, text)
    return sinks.audit_rows(
        adapter.events(spark, d),
        F.concat(F.lit("user-"), F.col("user_id")),
        event.otherwise("other"),
        F.col("props"),
        F.col("ts"),
    )


def status_messages(spark: SparkSession, d: str) -> DataFrame:
    e = adapter.keyed_sensor(spark, d).where(F.col("event_type").isin("click", "view"))
    return e.select("device_id", "ts", F.when(F.col("event_type") == "click", "online").otherwise("offline").alias("status"))


def pump_messages(spark: SparkSession, d: str) -> DataFrame:
    e = adapter.keyed_sensor(spark, d).where(F.col("event_type").isin("signup", "purchase"))
    return e.select(
        "device_id",
        "ts",
        F.when(F.col("event_type") == "signup", "ON").otherwise("OFF").alias("pump"),
        (F.col("event_id") % 3 + 1).alias("planned_minutes"),
    )
