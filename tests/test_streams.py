import json
from collections import Counter
import time
from datetime import datetime, timedelta

from helpers import at, random_readings
from pyspark.sql import functions as F

from fieldflow.operators import clean
from fieldflow.queries import QUERIES
from fieldflow.queries.inputs import stored_rows
from fieldflow.streaming import ingest, state


def run(query):
    query.awaitTermination()


def message(minutes, **changes):
    body = {"deviceId": "d", "temperature": 20.0, "humidity": 50.0, "pressure_hpa": 1000.0, "soilMoisture": 30.0,
            "timestamp": at(minutes).strftime("%Y-%m-%dT%H:%M:%SZ")}
    return json.dumps({k: v for k, v in {**body, **changes}.items() if v is not None})


def test_ingest_stores_once_and_keeps_rejects(spark, tmp_path):
    bodies = [message(0), message(0), message(1), message(2, temperature=None), "no json",
              message(3, temperature=0, humidity=0, soilMoisture=0), message(4, timestamp="soon")]
    source = str(tmp_path / "in")
    spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1).write.parquet(source)
    stream = ingest.file_stream(spark, source, "body string")
    start = lambda: [run(q) for q in ingest.ingest(stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "state"))]
    start()
    spark.createDataFrame([(message(1),), (message(5),)], "body string").coalesce(1).write.mode("append").parquet(source)
    start()
    stored = spark.read.parquet(str(tmp_path / "ok"))
    assert sorted(r.ts for r in stored.collect()) == [at(0), at(1), at(5)]
    reasons = sorted(r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect())
    assert reasons == ["bad timestamp", "empty reading", "missing temperature", "missing temperature"]


def test_buffers_equal_the_latest_rows(spark, tmp_path):
    df = random_readings(spark, 300).withColumn("part", F.floor(F.minute("ts") / 20))
    source = str(tmp_path / "in")
    ordered = df.orderBy("ts").drop("part").toPandas()
    third = len(ordered) // 3
    for i in range(3):
        spark.createDataFrame(ordered[i * third : (i + 1) * third], df.drop("part").schema).coalesce(2).write.mode("append").parquet(source)
    stream = ingest.file_stream(spark, source, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.drop("part").schema), maxFilesPerTrigger="2")
    run(ingest.append_stream(state.buffer_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")))
    frames = state.buffer_frames(spark.read.parquet(str(tmp_path / "out")))
    last = frames.groupBy("device_id").agg(F.max("target_ts").alias("target_ts"))
    got = frames.join(last, ["device_id", "target_ts"]).select("device_id", "ts", "temp_c")
    seen = spark.read.parquet(source)
    expected = clean.latest_rows(seen, 24).select("device_id", "ts", "temp_c")
    assert got.exceptAll(expected).count() == 0 and got.count() == expected.count() == 72


def test_buffer_is_silent_until_ready(spark, tmp_path):
    source = str(tmp_path / "in")
    few = random_readings(spark, 11, hot=1.1)
    few.write.parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema)
    run(ingest.append_stream(state.buffer_stream(ingest.file_stream(spark, source, schema)), str(tmp_path / "out"), str(tmp_path / "state")))
    assert spark.read.schema(state.BUFFER_SCHEMA).parquet(str(tmp_path / "out")).count() == 0


def test_stream_sessions_equal_batch(spark, sf_dir):
    batch = QUERIES["device_sessions"](spark, sf_dir)
    stream = QUERIES["stream_device_state"](spark, sf_dir)
    assert stream.exceptAll(batch).count() == 0 and stream.count() == batch.count()


def test_routes_hold_every_message(spark, sf_dir):
    rows = {r.kind: r for r in QUERIES["stream_route"](spark, sf_dir).collect()}
    assert set(rows) == {"sensor", "status", "forecast", "schedule", "unhandled"}
    assert sum(r.rows for r in rows.values()) == 1000 and rows["status"].status_devices == 4 and rows["sensor"].status_devices == 0


def test_stream_replaces_dates(spark, sf_dir):
    rows = stored_rows(spark, sf_dir).collect()
    three = {(r.device_id, r.date) for r in rows if r.duration_min == 3}
    expected = Counter()
    for r in rows:
        if (r.device_id, r.date) not in three:
            expected[r.date] += r.duration_min
        elif r.duration_min == 3:
            expected[r.date] += 6
    after = {r.date: r.minutes for r in QUERIES["stream_schedule_replace"](spark, sf_dir).collect()}
    assert three and after == dict(expected)


def test_ingest_query_drops_redelivered_messages(spark, sf_dir):
    rows = {r.kind: r.rows for r in QUERIES["stream_ingest"](spark, sf_dir).collect()}
    accepted = QUERIES["telemetry_validate"](spark, sf_dir).where("reject_reason IS NULL").count()
    empty = rows["empty reading"] // 2
    assert rows["stored"] == accepted - empty


def test_silence_is_noticed_without_a_later_message(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, 0, 0, 3), "online"), ("a", datetime(2024, 1, 1), "offline"), ("b", datetime(2024, 1, 1), "offline")]
    spark.createDataFrame(rows, "device_id string, ts timestamp, status string").write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), "device_id string, ts timestamp, status string")
    writer = state.presence_stream(stream, 2.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query = writer.trigger(processingTime="1 second").start(str(tmp_path / "out"))
    expected = {("a", rows[0][1], "online"), ("b", rows[2][1], "offline"), ("a", datetime(2024, 1, 1, 0, 0, 5), "offline")}
    found, deadline = set(), time.time() + 90
    while found != expected and time.time() < deadline:
        time.sleep(1)
        if (tmp_path / "out" / "_spark_metadata").exists():
            found = {tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}
    query.stop()
    assert found == expected


def warnings_of(spark, folder, lots, per_trigger):
    """Each lot is one file, in order; then another device's reading an hour on."""
    schema = "device_id string, ts timestamp"
    source, out = f"{folder}/in", f"{folder}/out"
    for lot in [*lots, [("clock", at(5000))]]:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    stream = state.silence_stream(ingest.file_stream(spark, source, schema, maxFilesPerTrigger=str(per_trigger)), late="30 minutes")
    run(ingest.append_stream(stream, out, f"{folder}/state"))
    return spark.read.schema(stream.schema).parquet(out)


def test_silence_warnings_follow_event_time_alone(spark, tmp_path):
    """Exactly the limit is no silence; a late reading closes one; the cut into micro-batches does not matter."""
    lots = [
        [("a", at(0)), ("a", at(15)), ("b", at(3)), (None, at(4)), ("a", None)],
        [("a", at(30.1)), ("b", at(25))],
        [("b", at(14)), ("a", at(31)), ("e", at(29)), ("e", at(44) + timedelta(microseconds=1))],
        [("a", at(100)), ("b", at(101)), ("b", at(101))],
    ]
    expected = {
        ("a", at(0), at(15), at(30), 2), ("a", at(30.1), at(31), at(46), 2), ("a", at(100), at(100), at(115), 1),
        ("b", at(3), at(25), at(40), 3), ("b", at(101), at(101), at(116), 2), (None, at(4), at(4), at(19), 1),
        ("e", at(29), at(29), at(44), 1), ("e", *[at(44) + timedelta(microseconds=1)] * 2, at(59) + timedelta(microseconds=1), 1),
    }
    for per_trigger in (1, 9):
        found = warnings_of(spark, str(tmp_path / str(per_trigger)), lots, per_trigger)
        assert {tuple(r) for r in found.collect()} == expected
    ended = {tuple(r)[:3] for r in state.silences(found, F.lit(at(200)).cast("timestamp")).collect()}
    assert ended == {
        ("a", at(15), at(30.1)), ("a", at(31), at(100)), ("a", at(100), at(200)),
        ("b", at(25), at(101)), ("b", at(101), at(200)), (None, at(4), at(200)),
        ("e", at(29), at(44) + timedelta(microseconds=1)), ("e", at(44) + timedelta(microseconds=1), at(200)),
    }
    early = {tuple(r)[:2] for r in state.silences(found, F.lit(at(116)).cast("timestamp")).collect()}
    assert ("b", at(101)) not in early and ("a", at(100)) in early
