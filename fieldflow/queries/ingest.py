"""Sources, sinks, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldflow import schemas
from fieldflow.functions import constants as K
from fieldflow.functions.scalars import parse_timestamp
from fieldflow.operators import clean
from fieldflow.plans import planning
from fieldflow.queries.inputs import accounts, audit, decided_slots, forecast_payloads, plans, stored_rows, telemetry_json
from fieldflow.queries.registry import dew_sql, query
from fieldflow.sources import adapter, readers, sinks
from fieldflow.streaming.ingest import parse_telemetry

NOW = "2024-01-20 12:00:00"


@query(
    "ts:t api_pop:d api_rain_1h:d api_temp_c:d api_rh_pct:d api_uvi:d",
    "SELECT ts, api_pop, api_rain_1h, 25e0 AS api_temp_c, 70e0 AS api_rh_pct, 5e0 AS api_uvi FROM weather",
    "weather",
)
def weather_harmonize(spark, d):
    w = adapter.weather_hour(spark, d)
    legacy = w.select("ts", F.col("api_pop").alias("api_rain_prob_60"), F.col("api_rain_1h").alias("api_rain_mm_60"))
    return readers.harmonize_weather(legacy)


FLAT_COLUMNS = (
    "shape:s ts:t api_temp_c:d api_rh_pct:d api_pressure_hpa:d api_uvi:d api_wind_speed:d api_cloud_pct:d "
    "api_weather_code:i api_weather_main:s api_weather_desc:s api_dew_point:d api_rain_1h:d api_pop:d"
)
FLAT_SQL = f"""
WITH raw AS (
  SELECT ts, CASE WHEN m % 10 = 0 THEN 0e0 ELSE api_temp_c END AS t, api_rh_pct AS rh, 1000e0 + m % 20 AS pr, api_uvi,
    (m % 80) / 10e0 AS wind, CAST(m % 100 AS DOUBLE) AS cloud,
    CASE WHEN m % 7 = 0 THEN 0 ELSE api_weather_code END AS code, CASE WHEN m % 7 = 0 THEN '' ELSE 'main' || CAST(m % 5 AS VARCHAR) END AS main,
    CASE WHEN m % 7 = 0 THEN '' ELSE 'text' END AS descr, api_rain_1h, api_pop FROM weather),
shaped AS (SELECT *, CASE WHEN t > 0 AND rh > 0 THEN {dew_sql('t', 'rh')} ELSE 0e0 END AS dew FROM raw),
firsts AS (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS r FROM shaped)
SELECT 'current' AS shape, ts, t AS api_temp_c, rh AS api_rh_pct, pr AS api_pressure_hpa, api_uvi, wind AS api_wind_speed, cloud AS api_cloud_pct,
  code AS api_weather_code, main AS api_weather_main, descr AS api_weather_desc, dew AS api_dew_point, api_rain_1h, 0e0 AS api_pop FROM shaped
UNION ALL SELECT 'onecall', ts, t, rh, pr, api_uvi, wind, cloud, code, main, descr, dew, api_rain_1h, api_pop FROM firsts
UNION ALL SELECT 'onecall', ts, t, rh, pr, api_uvi, wind, cloud, code, main, descr, dew, api_rain_1h, api_pop FROM firsts WHERE r = 1
"""


@query(FLAT_COLUMNS, FLAT_SQL, "weather")
def json_flatten(spark, d):
    """Weather documents of both shapes, built from the hourly rows (one document per hour, one per day)."""
    hours = adapter.events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(F.min("event_id").alias("m"))
    rows = hours.join(adapter.weather_hour(spark, d), "ts")
    m = F.col("m")
    temp = F.when(m % 10 != 0, F.col("api_temp_c"))
    weather = F.when(
        m % 7 != 0,
        F.array(
            F.struct(
                F.col("api_weather_code").alias("id"),
                F.concat(F.lit("main"), m % 5).alias("main"),
                F.lit("text").alias("description"),
            )
        ),
    )
    rain = F.when(F.col("api_rain_1h") > 0, F.struct(F.col("api_rain_1h").alias("1h")))
    pressure, wind, cloud = F.lit(1000.0) + m % 20, (m % 80) / 10, (m % 100).cast("double")
    nested = F.to_json(
        F.struct(
            F.unix_seconds("ts").alias("dt"),
            F.struct(temp.alias("temp"), F.col("api_rh_pct").alias("humidity"), pressure.alias("pressure")).alias("main"),
            F.col("api_uvi").alias("uvi"),
            F.struct(wind.alias("speed")).alias("wind"),
            F.struct(cloud.alias("all")).alias("clouds"),
            weather.alias("weather"),
            rain.alias("rain"),
        )
    )
    flat = F.struct(
        F.unix_seconds("ts").alias("dt"),
        temp.alias("temp"),
        F.col("api_rh_pct").alias("humidity"),
        pressure.alias("pressure"),
        F.col("api_uvi").alias("uvi"),
        wind.alias("wind_speed"),
        cloud.alias("clouds"),
        weather.alias("weather"),
        rain.alias("rain"),
        F.col("api_pop").alias("pop"),
    )
    current = readers.flatten_current(rows.select(nested.alias("body")), "body")
    # a one-call document holds the 24 hours of its day
    days = rows.groupBy(F.to_date("ts")).agg(F.sort_array(F.collect_list(flat)).alias("hourly"))
    onecall = days.select(F.to_json(F.struct(F.get("hourly", 0).alias("current"), "hourly")).alias("body"))
    return (
        current.withColumn("shape", F.lit("current"))
        .unionByName(readers.flatten_hourly(onecall, "body").withColumn("shape", F.lit("onecall")))
    )


@query(
    "date_time:s temperature:d humidity:d pressure_hpa:d soil_moisture:d",
    """SELECT strftime(ts + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M') AS date_time, round(temp_c, 2) AS temperature,
      round(rh_pct, 2) AS humidity, round(pressure_hpa, 2) AS pressure_hpa, round(soil_moist_pct, 2) AS soil_moisture FROM sensor""",
    "sensor",
)
def sensor_report(spark, d):
    return sinks.sensor_report(adapter.sensor_reading(spark, d), K.SITE_TZ)


@query(
    "date:s start:s end:s duration_min:i note:s",
    """SELECT date, strftime(start_ts, '%H:%M') AS start, strftime(end_ts, '%H:%M') AS "end", duration_min, note FROM stored""",
    "sensor weather plan",
)
def schedule_report(spark, d):
    return sinks.schedule_report(stored_rows(spark, d))


@query("device_id:s document:s")
def schedule_document(spark, d):
    return planning.schedule_documents(plans(spark, d), F.lit(NOW).cast("timestamp"))


def placed_documents(spark, d):
    return planning.schedule_documents(
        plans(spark, d),
        F.lit(NOW).cast("timestamp"),
        location={"lat": 10.5, "lon": 106.25, "timezone": K.SITE_TZ},
        sources={"sensor": "events", "weather": "events"},
    )


@query(
    "device_id:s date:s season:s horizon_group:s rain_mm:d soil_moist_ref:d total_irrigation_min:i note:s",
    "SELECT device_id, date, season, horizon_group, round(rain_mm, 2) AS rain_mm, round(soil_moist_ref, 2) AS soil_moist_ref, total_min AS total_irrigation_min, note FROM noted",
    "sensor weather plan",
)
def document_days(spark, d):
    """The day details, read back from the documents."""
    parsed = placed_documents(spark, d).select("device_id", F.from_json("document", schemas.SCHEDULE_JSON).alias("doc"))
    return parsed.select("device_id", F.explode("doc.days_detail").alias("day")).select("device_id", "day.*")


@query(
    "device_id:s lat:d lon:d timezone:s source_sensor:s source_weather:s days:i mode:s first_note:s irrigation_min_7d:i slots:i",
    f"""SELECT device_id, 10.5e0 AS lat, 106.25e0 AS lon, '{K.SITE_TZ}' AS timezone, 'events' AS source_sensor, 'events' AS source_weather, count(*) AS days,
      'scheduler_rule_based_v1' AS mode, coalesce(string_agg(note, ' | ' ORDER BY date) FILTER (horizon_group = 'd1_2'), '') AS first_note,
      sum(total_min) AS irrigation_min_7d, (SELECT count(*) FROM slots s WHERE s.device_id = n.device_id) AS slots FROM noted n GROUP BY device_id""",
    "sensor weather plan",
)
def document_heads(spark, d):
    """Place, sources, summary and balance, read back from the documents."""
    read = "location struct<lat: double, lon: double, timezone: string>, meta struct<days: int, source_sensor: string, source_weather: string>, " + schemas.SCHEDULE_JSON
    doc = placed_documents(spark, d).select("device_id", F.from_json("document", read).alias("doc"))
    return doc.select(
        "device_id", "doc.location.*", "doc.meta.*", "doc.mode", F.col("doc.summary.horizon_1_2_days").alias("first_note"),
        "doc.water_balance.irrigation_min_7d", F.size("doc.slots").alias("slots"),
    )


@query(
    "device_id:s start_ts:t end_ts:t duration_min:i rain_mm_day:d soil_moist_ref:d date:s horizon_group:s season:s forecast_trigger_ts:t",
    "SELECT *, start_ts - INTERVAL 10 MINUTE AS forecast_trigger_ts FROM slots",
    "sensor weather plan",
)
def schedule_explode(spark, d):
    """Documents parsed back into slots."""
    documents = planning.schedule_documents(plans(spark, d), F.lit(NOW).cast("timestamp"))
    parsed = documents.select(F.from_json("document", schemas.SCHEDULE_JSON).alias("doc")).select("doc.*")
    return readers.explode_slots(parsed)


@query(
    "device_id:s start_ts:t end_ts:t duration_min:i date:s decision:b note:s",
    """SELECT s.* FROM stored s WHERE (s.device_id, s.date) NOT IN (SELECT (device_id, date) FROM stored WHERE duration_min = 3)
       UNION ALL SELECT device_id, start_ts + INTERVAL 30 MINUTE, end_ts + INTERVAL 30 MINUTE, duration_min, date, decision, 'new' FROM stored WHERE duration_min = 3""",
    "sensor weather plan",
)
def schedule_replace_dates(spark, d):
    """A payload that moves all three-minute slots replaces their devices' dates."""
    stored = stored_rows(spark, d)
    half = F.make_dt_interval(mins=F.lit(30))
    incoming = stored.where("duration_min = 3").withColumns(
        {"start_ts": F.col("start_ts") + half, "end_ts": F.col("end_ts") + half, "note": F.lit("new")}
    )
    return sinks.replaced_dates(stored, incoming)


@query(
    "kind:s date:s chance_of_rain:d reason:s accepted:b slot_time:s",
    """SELECT 'forecast' AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS date, round(1 / (1 + exp(-(rh_pct - 67) / 10e0)), 2) AS chance_of_rain,
         'k' || CAST(user_id % 5 AS VARCHAR) AS reason, event_id % 2 = 0 AS accepted, CASE WHEN event_id % 9 <> 0 THEN strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') END AS slot_time FROM sensor
       UNION ALL SELECT 'decision', strftime(start_ts - INTERVAL 10 MINUTE, '%Y-%m-%dT%H:%M:%S'), NULL, decision_reason, decision = 'confirm', NULL FROM decided WHERE decision IS NOT NULL""",
    "sensor weather plan",
)
def forecast_rows(spark, d):
    forecasts = sinks.forecast_rows(forecast_payloads(spark, d)).select(
        F.lit("forecast").alias("kind"), "date", "chance_of_rain", "reason", F.col("should_irrigate").alias("accepted"), "slot_time"
    )
    decisions = sinks.decision_rows(decided_slots(spark, d)).select(
        F.lit("decision").alias("kind"),
        F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.lit(None).cast("double").alias("chance_of_rain"),
        "reason",
        F.col("decision").alias("accepted"),
        F.lit(None).cast("string").alias("slot_time"),
    )
    return forecasts.unionByName(decisions)


TELEMETRY_SQL = """SELECT event_id, ts, CASE WHEN event_id % 6 = 5 THEN 'esp32-01' ELSE device_id END AS device_id,
  CASE WHEN event_id % 10 = 0 OR event_id % 25 = 7 THEN 0e0 ELSE temp_c END AS temp_c,
  CASE WHEN event_id % 15 = 0 OR event_id % 25 = 7 THEN 0e0 ELSE rh_pct END AS rh_pct,
  CASE WHEN event_id % 35 = 0 THEN 0e0 ELSE pressure_hpa END AS pressure_hpa,
  CASE WHEN event_id % 45 = 0 OR event_id % 25 = 7 THEN 0e0 ELSE soil_moist_pct END AS soil_moist_pct FROM sensor"""


@query("ts:t device_id:s temp_c:d rh_pct:d pressure_hpa:d soil_moist_pct:d", TELEMETRY_SQL, "sensor")
def telemetry_normalize(spark, d):
    return clean.normalize_telemetry(parse_telemetry(telemetry_json(spark, d)), K.SITE_TZ)


@query(
    "ts:t device_id:s temp_c:d rh_pct:d pressure_hpa:d soil_moist_pct:d",
    f"SELECT * FROM ({TELEMETRY_SQL}) WHERE NOT (temp_c = 0 AND rh_pct = 0 AND soil_moist_pct = 0)",
    "sensor",
)
def telemetry_drop_empty(spark, d):
    return clean.drop_empty(clean.normalize_telemetry(parse_telemetry(telemetry_json(spark, d)), K.SITE_TZ))


@query(
    "event_id:i reject_reason:s",
    """SELECT event_id, CASE WHEN event_id % 25 = 7 THEN NULL WHEN event_id % 10 = 0 THEN 'missing temperature' WHEN event_id % 15 = 0 THEN 'missing humidity'
       WHEN event_id % 35 = 0 THEN 'missing pressure' WHEN event_id % 45 = 0 THEN 'missing soilMoisture' END AS reject_reason FROM sensor""",
    "sensor",
)
def telemetry_validate(spark, d):
    return clean.validate_telemetry(parse_telemetry(telemetry_json(spark, d)))


@query(
    "ts:t device_id:s temp_c:d rh_pct:d pressure_hpa:d soil_moist_pct:d",
    "SELECT ts, device_id, temp_c, rh_pct, 1013.25e0 AS pressure_hpa, soil_moist_pct FROM sensor",
    "sensor",
)
def sensor_standardize(spark, d):
    """A table without any pressure column takes the standard atmosphere."""
    return clean.standardize(adapter.sensor_reading(spark, d).drop("pressure_hpa"))


@query(
    "device_id:s ts:t temp_c:d",
    """SELECT s.device_id, s.ts, s.temp_c FROM sensor s
       JOIN (SELECT device_id, max(ts) AS m FROM sensor GROUP BY 1) l ON l.device_id = s.device_id WHERE s.ts >= l.m - INTERVAL 10 DAY""",
    "sensor",
)
def trailing_window_filter(spark, d):
    return clean.trailing_window(adapter.sensor_reading(spark, d), days=10)


@query(
    "range:s n:i temp_mean:d",
    "\nUNION ALL\n".join(
        f"SELECT '{n}' AS \"range\", count(*) AS n, avg(temp_c) AS temp_mean FROM sensor WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL {h} HOUR AND TIMESTAMP '{NOW}'"
        for n, h in clean.LOOKBACKS.items()
    ),
    "sensor",
)
def lookback_ranges(spark, d):
    return clean.lookback_counts(adapter.sensor_reading(spark, d), F.lit(NOW).cast("timestamp"))


@query(
    "device_id:s minute_text:s second_text:s temp_c:d rh_pct:d pressure_hpa:d soil_moist_pct:d",
    """SELECT device_id, strftime(ts + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M') AS minute_text, strftime(ts + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M:%S') AS second_text,
       round(temp_c, 2) AS temp_c, round(rh_pct, 2) AS rh_pct, round(pressure_hpa, 2) AS pressure_hpa, round(soil_moist_pct, 2) AS soil_moist_pct FROM sensor""",
    "sensor",
)
def format_readings(spark, d):
    return clean.formatted_readings(adapter.sensor_reading(spark, d), K.SITE_TZ)


ACCOUNT_SQL = """SELECT c_name AS username, 'secret' AS password,
  lower(replace(c_name, '#', '.')) || CASE WHEN c_custkey % 3 = 0 THEN '@example.com' ELSE '@gmail.com' END AS email,
  c_name AS full_name, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_mktsegment END AS address,
  CAST(c_custkey AS VARCHAR) AS phone_number, CASE WHEN c_custkey % 11 = 0 THEN 'ROOT' WHEN c_custkey % 10 = 0 THEN 'ADMIN' ELSE 'USER' END AS role FROM customer"""


@query("username:s email:s full_name:s address:s phone_number:s role:s", ACCOUNT_SQL)
def account_projection(spark, d):
    return clean.public_accounts(accounts(spark, d))


AUDIT_EVENT_SQL = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN '{e}'" for t, e in zip(("click", "view", "signup", "purchase"), K.AUDIT_EVENTS)
) + " ELSE 'other' END"


@query(
    "rule:s n_rows:i violations:i",
    f"""WITH f AS (SELECT CASE WHEN event_id % 9 <> 0 THEN ts END AS slot_time FROM sensor),
      a AS (SELECT {AUDIT_EVENT_SQL} AS event, props AS details FROM events),
      u AS ({ACCOUNT_SQL})
    SELECT 'forecast_date_required' AS rule, count(*) AS n_rows, 0 AS violations FROM f
    UNION ALL SELECT 'forecast_slot_time_required', count(*), count(*) - count(slot_time) FROM f
    UNION ALL SELECT 'forecast_chance_in_unit_range', count(*), 0 FROM f
    UNION ALL SELECT 'audit_actor_required', count(*), 0 FROM a
    UNION ALL SELECT 'audit_event_known', count(*), sum(CASE WHEN event = 'other' THEN 1 ELSE 0 END) FROM a
    UNION ALL SELECT 'audit_details_required', count(*), sum(CASE WHEN trim(details) = '' THEN 1 ELSE 0 END) FROM a
    UNION ALL SELECT 'account_username_min_length', count(*), sum(CASE WHEN length(trim(username)) < 3 THEN 1 ELSE 0 END) FROM u
    UNION ALL SELECT 'account_password_required', count(*), 0 FROM u
    UNION ALL SELECT 'account_email_required', count(*), 0 FROM u
    UNION ALL SELECT 'account_full_name_required', count(*), 0 FROM u
    UNION ALL SELECT 'account_address_required', count(*), sum(CASE WHEN trim(address) = '' THEN 1 ELSE 0 END) FROM u
    UNION ALL SELECT 'account_phone_number_required', count(*), 0 FROM u
    UNION ALL SELECT 'account_email_suffix', count(*), sum(CASE WHEN email NOT LIKE '%@gmail.com' THEN 1 ELSE 0 END) FROM u
    UNION ALL SELECT 'account_role_known', count(*), sum(CASE WHEN role NOT IN ('USER', 'ADMIN') THEN 1 ELSE 0 END) FROM u""",
    "sensor",
)
def constraint_violations(spark, d):
    forecasts = sinks.forecast_rows(forecast_payloads(spark, d))
    return (
        clean.violations(forecasts, clean.forecast_rules())
        .unionByName(clean.violations(audit(spark, d), clean.audit_rules()))
        .unionByName(clean.violations(accounts(spark, d), clean.account_rules()))
    )


def _bands_sql() -> str:
    parts = []
    for measure, steps in K.STATUS_BANDS.items():
        case = "CASE " + " ".join(
            f"WHEN {measure} {'<=' if inc else '<'} {bound} THEN '{name}'" if bound is not None else f"ELSE '{name}' END"
            for bound, inc, name in steps
        )
        parts.append(f"SELECT '{measure}' AS measure, {case} AS band, count(*) AS n FROM sensor GROUP BY 2")
    return "\nUNION ALL\n".join(parts)


@query("measure:s band:s n:i", _bands_sql(), "sensor")
def status_bands(spark, d):
    return clean.status_bands(adapter.sensor_reading(spark, d))


@query(
    "event_id:i soil_moist_pct:d",
    "SELECT event_id, (3000 - least(greatest((event_id * 97) % 4096, 1000), 3000)) / 2000e0 * 100e0 AS soil_moist_pct FROM events",
)
def soil_calibration(spark, d):
    raw = adapter.events(spark, d).select("event_id", ((F.col("event_id") * 97) % 4096).alias("raw"))
    return clean.calibrate_soil(raw, "raw")


@query(
    "event_id:i parsed:t",
    "SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events",
)
def parse_mixed_ts(spark, d):
    """Five spellings of the same instant, and one unreadable text."""
    local = F.from_utc_timestamp("ts", K.SITE_TZ)
    texts = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'+07:00'"),
        F.date_format(local, "yyyy-MM-dd HH:mm:ss"),
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
        F.date_format(F.col("ts") - F.make_dt_interval(hours=F.lit(3), mins=F.lit(30)), "yyyy-MM-dd HH:mm:ss'-03:30'"),
        F.date_format("ts", "dd.MM.yyyy HH:mm"),
    ]
    text = F.element_at(F.array(*texts), (F.col("event_id") % 6 + 1).cast("int"))
    return adapter.events(spark, d).select("event_id", parse_timestamp(text, K.SITE_TZ).alias("parsed"))


@query(
    "device_id:s slot_no:i start_ts:t end_ts:t duration_min:i soil_ref:d",
    """SELECT * FROM (SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY start_ts, end_ts) AS slot_no,
       start_ts, end_ts, duration_min, 60e0 AS soil_ref FROM stored WHERE decision) WHERE slot_no <= 32""",
    "sensor weather plan",
)
def executable_slots(spark, d):
    from fieldflow.plans.schedule import executable_slots as run

    return run(stored_rows(spark, d))
