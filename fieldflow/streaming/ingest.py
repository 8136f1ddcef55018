"""Telemetry streams: source, parsing, validation, de-duplication, storage and topic dispatch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldflow import schemas
from fieldflow.functions import constants as K
from fieldflow.operators.clean import drop_empty, normalize_telemetry, reject_reason
from fieldflow.session import use_utc


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return use_utc(spark).readStream.format(fmt).schema(schema).options(**options).load(path)


def kafka_stream(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Messages as ``topic``, ``body``, ``arrived_at``. Needs the Kafka connector on the classpath."""
    raw = (
        use_utc(spark)
        .readStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topics, **options})
        .load()
    )
    return raw.select("topic", F.col("value").cast("string").alias("body"), F.col("timestamp").alias("arrived_at"))


def parse_telemetry(messages: DataFrame, body: str = "body") -> DataFrame:
    """Message bodies as columns. Text that is no JSON object comes out with all fields null."""
    return messages.withColumn("_m", F.from_json(body, schemas.TELEMETRY_JSON, {"mode": "PERMISSIVE"})).select(
        *[c for c in messages.columns if c != "timestamp"], "_m.*"
    )


def accepted(messages: DataFrame, site_tz: str = "UTC") -> DataFrame:
    """Valid, non-empty readings under canonical names."""
    return drop_empty(normalize_telemetry(messages.where(reject_reason(messages).isNull()), site_tz)).where(
        F.col("ts").isNotNull()
    )


def rejected(messages: DataFrame, site_tz: str = "UTC") -> DataFrame:
    """Everything ``accepted`` leaves out, with the reason."""
    from fieldflow.functions.scalars import parse_timestamp

    empty = (F.col("temperature") == 0) & (F.col("humidity") == 0) & (F.col("soilMoisture") == 0)
    reason = F.coalesce(
        reject_reason(messages),
        F.when(parse_timestamp("timestamp", site_tz).isNull(), F.lit("bad timestamp")),
        F.when(empty, F.lit("empty reading")),
    )
    return messages.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("body", "reason")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, overwritten on a retry: a batch that runs twice is stored once."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def append_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batches(df: DataFrame, handle, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest(messages: DataFrame, table: str, rejects: str, checkpoint: str, late: str = "1 hour", site_tz: str = "UTC") -> list[StreamingQuery]:
    """Store accepted readings once per (device, ts) and rejected messages with their reason.

    Re-delivered messages are dropped while they are within the lateness; the batch merge removes later ones.
    A rejected message is stored once per delivery: it has no valid time that could bound a memory of it.
    """
    parsed = parse_telemetry(messages)
    unique = accepted(parsed, site_tz).withWatermark("ts", late).dropDuplicatesWithinWatermark(["device_id", "ts"])
    return [
        append_stream(unique, table, f"{checkpoint}/accepted"),
        append_stream(rejected(parsed, site_tz), rejects, f"{checkpoint}/rejected"),
    ]


def topic_kind(topic: str = "topic") -> Column:
    t = F.col(topic)
    return (
        F.when(t == K.TOPIC_SENSOR, "sensor")
        .when(F.startswith(t, F.lit(K.TOPIC_STATUS_PREFIX)), "status")
        .when(t == K.TOPIC_FORECAST, "forecast")
        .when(t == K.TOPIC_SCHEDULE, "schedule")
        .otherwise("unhandled")
    )


def route(messages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Every message to the table of its kind (one write, partitioned by kind); unknown topics are kept apart."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        device = F.when(F.col("kind") == "status", F.get(F.split("topic", "/"), 2))
        kinds = batch.withColumn("kind", topic_kind()).withColumn("status_device", device)
        kinds.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/batch={batch_id}")

    return batches(messages, handle, checkpoint)


def replace_schedules(
    slots: DataFrame, table: str, checkpoint: str, keys: Sequence[str] = ("device_id", "date")
) -> StreamingQuery:
    """Each payload replaces the stored slots of the keys it holds (dynamic partition overwrite).

    A ``payload_ts`` column tells payloads apart: of several in one micro-batch the newest stands for its keys.
    """
    from fieldflow.sources.sinks import newest_payload, replace_dates

    def handle(batch: DataFrame, _: int) -> None:
        replace_dates(newest_payload(batch, keys) if "payload_ts" in batch.columns else batch, table, keys)

    return batches(slots, handle, checkpoint)
