import json
from datetime import date, datetime

import pytest
from helpers import at, readings
from pyspark.sql import functions as F

from fieldflow.plans import planning
from fieldflow.queries.inputs import plans, stored_rows
from fieldflow.sources import readers, sinks


def test_sensor_csv_prefers_the_first_existing_file(spark, tmp_path):
    real, synth = tmp_path / "real.csv", tmp_path / "synth.csv"
    head = "ts,device_id,temp_c,rh_pct,pressure_hpa,soil_moist_pct,rain_mm_5min\n"
    synth.write_text(head + "2024-01-01 00:00:00,synth,1,2,3,4,0\n")
    paths = [str(real), str(synth)]
    assert readers.read_sensor(spark, paths).first().device_id == "synth"
    real.write_text(head + "2024-01-01 00:00:00,real,1,2,3,4,0\n")
    row = readers.read_sensor(spark, paths).first()
    assert (row.device_id, row.ts, row.soil_moist_pct) == ("real", datetime(2024, 1, 1), 4.0)
    with pytest.raises(FileNotFoundError):
        readers.read_sensor(spark, [str(tmp_path / "none.csv")])


def test_labels_need_the_amount_column(spark, tmp_path):
    f = tmp_path / "labels.csv"
    f.write_text("ts,rain_next_60\n2024-01-01 00:00:00,1\n")
    with pytest.raises(ValueError, match="rain_amount_next_60_mm"):
        readers.read_labels(spark, [str(f)], schema="ts timestamp, rain_next_60 int")


def test_absent_irrigation_file_reads_as_nothing(spark, tmp_path):
    assert readers.read_irrigation(spark, str(tmp_path / "none.csv")).count() == 0


def test_harmonize_renames_and_fills_absent_columns(spark):
    df = spark.createDataFrame([(0.3, 1.0, 9.0)], "api_rain_prob_60 double, api_rain_mm_60 double, api_uvi double")
    row = readers.harmonize_weather(df).first()
    assert (row.api_pop, row.api_rain_1h, row.api_temp_c, row.api_rh_pct, row.api_uvi) == (0.3, 1.0, 25.0, 70.0, 9.0)


def test_flatten_current_with_missing_parts(spark):
    docs = [
        {"dt": 0, "main": {"temp": 20, "humidity": 50, "pressure": 1000}, "weather": [{"id": 500, "main": "Rain", "description": "x"}, {"id": 1}], "rain": {"1h": 0.4}},
        {"dt": 3600},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "body string")
    full, empty = readers.flatten_current(df, "body").orderBy("ts").collect()
    assert (full.api_weather_code, full.api_rain_1h) == (500, 0.4) and full.api_dew_point == pytest.approx(9.25, abs=0.02)
    assert (empty.api_temp_c, empty.api_weather_code, empty.api_weather_main, empty.api_dew_point) == (0.0, 0, "", 0.0)


def test_flatten_one_call(spark):
    hour = lambda dt, pop: {"dt": dt, "temp": 20.5, "humidity": 60, "clouds": 40, "pop": pop, "weather": []}
    doc = {"current": {k: v for k, v in hour(0, 0).items() if k != "pop"}, "hourly": [hour(0, 0.7), hour(3600, 0.1)]}
    df = spark.createDataFrame([(json.dumps(doc),)], "body string")
    got = readers.flatten_hourly(df, "body").orderBy("ts", "api_pop").collect()
    assert [(r.api_temp_c, r.api_cloud_pct, r.api_pop) for r in got] == [(20.5, 40.0, 0.7), (20.5, 40.0, 0.7), (20.5, 40.0, 0.1)]


def test_schedule_document_round_trip(spark, sf_dir, tmp_path):
    made = plans(spark, sf_dir)
    docs = planning.schedule_documents(made, F.lit(at(0)).cast("timestamp"))
    row = docs.orderBy("device_id").first()
    f = tmp_path / "schedule.json"
    f.write_text(json.dumps(json.loads(row.document), indent=2))
    back = readers.read_schedule(spark, str(f))
    slots = readers.explode_slots(back)
    expected = planning.plan_slots(made).where(F.col("device_id") == row.device_id)
    pick = ["device_id", "start_ts", "end_ts", "duration_min", "date", "season"]
    assert slots.select(pick).exceptAll(expected.select(pick)).count() == 0 and slots.count() == expected.count()
    doc = json.loads(row.document)
    assert doc["meta"]["days"] == len(doc["days_detail"]) and doc["water_balance"]["status"] in ("deficit", "ok", "excess")
    assert doc["summary"]["horizon_1_2_days"].count(" | ") == 1


def test_replace_dates_on_disk_equals_the_query(spark, sf_dir, tmp_path):
    rows = stored_rows(spark, sf_dir)
    incoming = rows.where("duration_min = 3").withColumn("note", F.lit("new"))
    table = str(tmp_path / "table")
    sinks.replace_dates(rows, table)
    sinks.replace_dates(incoming, table)
    on_disk = spark.read.parquet(table).withColumn("date", F.date_format("date", "yyyy-MM-dd")).select(rows.columns)
    query = sinks.replaced_dates(rows, incoming).select(rows.columns)
    assert on_disk.exceptAll(query).count() == 0 and on_disk.count() == query.count()


def test_report_file_has_header_and_mark(spark, tmp_path):
    report = sinks.sensor_report(readings(spark, [("d", 0, 1.234, 2, 3, 4), ("d", 61, 5, 6, 7, 8)]))
    sinks.write_report(report.coalesce(1), str(tmp_path / "r"), bom=True)
    text = next((tmp_path / "r").glob("*.csv")).read_text(encoding="utf-8")
    assert text.splitlines()[0].startswith('"﻿date_time"') and "01/03/2024 00:00" in text and "1.23" in text


def test_decisions_only_where_made(spark):
    df = spark.createDataFrame([("confirm", "a", at(0)), ("skip", "b", at(1)), (None, "c", at(2)), ("", "d", at(3))], "decision string, decision_reason string, forecast_trigger_ts timestamp")
    assert [(r.decision, r.reason) for r in sinks.decision_rows(df).orderBy("date").collect()] == [(True, "a"), (False, "b")]


def test_newest_payload_stands_for_its_key_and_other_devices_stay(spark, tmp_path):
    rows = [("a", "2024-01-01", 1, 10), ("a", "2024-01-01", 2, 20), ("a", "2024-01-02", 1, 30), ("b", "2024-01-01", 1, 40)]
    df = spark.createDataFrame(rows, "device_id string, date string, payload_ts int, v int")
    newest = sinks.newest_payload(df)
    assert sorted(r.v for r in newest.collect()) == [20, 30, 40]
    path = str(tmp_path / "slots")
    sinks.replace_dates(newest, path)
    sinks.replace_dates(newest.where("device_id = 'a' and v = 20").withColumn("v", F.lit(99)), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [30, 40, 99]


def test_appended_rows_add_up(spark, tmp_path):
    from fieldflow.streaming import ingest

    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int")
    for _ in range(2):
        sinks.append_rows(df, str(tmp_path / "rows"), "date")
        ingest.write_batch(df, str(tmp_path / "batches"), 7)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4
    assert spark.read.parquet(str(tmp_path / "batches")).count() == 2


def test_forecast_file_becomes_days(spark, tmp_path):
    """Columns in another order, one that is not ours, several of ours absent."""
    f = tmp_path / "forecast.csv"
    f.write_text(
        "api_pop,site,ts,api_weather_code,api_rain_1h\n"
        "0.2,x,2024-01-01 00:00:00,500,1.5\n0.7,x,2024-01-01 23:00:00,500,\n0.1,x,2024-01-02 00:00:00,,0.25\n"
    )
    hourly = readers.read_forecast(spark, str(f))
    assert hourly.columns[:2] == ["ts", "api_temp_c"] and "site" not in hourly.columns
    days = [tuple(r) for r in planning.daily_forecast(hourly).orderBy("date").collect()]
    assert days == [(date(2024, 1, 1), 1.5, 0.7, 500), (date(2024, 1, 2), 0.25, 0.1, 0)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_forecast_needs_its_columns_in_the_file(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(at(0), 0.5)], "ts timestamp, api_pop double")
    rows.write.option("header", "true").format(fmt).save(str(tmp_path / "f"))
    with pytest.raises(ValueError, match="missing columns: api_rain_1h"):
        readers.read_forecast(spark, str(tmp_path / "f"), fmt)
    rows.withColumn("api_rain_1h", F.lit(2.0)).write.option("header", "true").format(fmt).save(str(tmp_path / "g"))
    row = readers.read_forecast(spark, str(tmp_path / "g"), fmt).first()
    assert (row.ts, row.api_pop, row.api_rain_1h, row.api_uvi) == (at(0), 0.5, 2.0, None)
