"""Planning, schedules, device state and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.functions import scalars
from fieldflow.operators import clean, devices
from fieldflow.operators.features import serving_features
from fieldflow.operators.joins import weather_or_defaults
from fieldflow.plans import planning, schedule
from fieldflow.queries.inputs import (
    audit,
    decided_slots,
    plan_date,
    plans,
    pump_messages,
    score,
    slots,
    status_messages,
    stored_rows,
    telemetry_json,
)
from fieldflow.queries.registry import query
from fieldflow.session import cut_lineage, scratch
from fieldflow.sources import adapter
from fieldflow.streaming import ingest, state

TODAY = "2024-01-31"
PLAN = "sensor weather plan"


@query(
    "date:s rain_mm:d pop_max:d weather_code_main:i",
    f"""SELECT CAST(DATE '{TODAY}' + CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS DATE) AS date, rain_mm, 0e0 AS pop_max, 0 AS weather_code_main
    FROM (SELECT * FROM days ORDER BY day DESC LIMIT 7)""",
    PLAN,
)
def pseudo_forecast(spark, d):
    return planning.pseudo_forecast(adapter.weather_hour(spark, d), F.lit(TODAY).cast("date"))


@query(
    "date:s rain_mm:d pop_max:d weather_code_main:i",
    "SELECT d.day AS date, rain_mm, pop_max, code AS weather_code_main FROM days d JOIN codes c ON c.day = d.day",
    PLAN,
)
def daily_forecast(spark, d):
    return planning.daily_forecast(adapter.weather_hour(spark, d))


@query(
    "device_id:s date:s soil_moist_mean:d",
    f"""SELECT device_id, CAST(DATE '{TODAY}' + CAST(row_number() OVER (PARTITION BY device_id ORDER BY day) AS INTEGER) AS DATE) AS date, m AS soil_moist_mean FROM (
      SELECT device_id, CAST(ts AS DATE) AS day, avg(soil_moist_pct) AS m, row_number() OVER (PARTITION BY device_id ORDER BY CAST(ts AS DATE) DESC) AS r
      FROM sensor GROUP BY 1, 2) WHERE r <= 7""",
    PLAN,
)
def soil_reference(spark, d):
    return planning.soil_reference(adapter.sensor_reading(spark, d), F.lit(TODAY).cast("date"))


@query(
    "device_id:s date:s rain_mm:d soil_moist_ref:d season:s horizon_group:s branch:s note:s n_slots:i",
    """SELECT *, CASE branch WHEN 'dry' THEN 2 WHEN 'fairly_dry' THEN 1 WHEN 'medium_rain_dry' THEN 1 ELSE 0 END AS n_slots FROM noted""",
    PLAN,
)
def day_plan(spark, d):
    return plans(spark, d).withColumn("n_slots", F.size("slots"))


@query(
    "device_id:s start_ts:t end_ts:t duration_min:i rain_mm_day:d soil_moist_ref:d date:s horizon_group:s season:s",
    "SELECT * FROM slots",
    PLAN,
)
def plan_slots(spark, d):
    return slots(spark, d)


@query("device_id:s date:s horizon_group:s", "SELECT * FROM plan", PLAN)
def horizon_group(spark, d):
    return plans(spark, d)


@query(
    "device_id:s date:s season:s target_mm_7d:d",
    "SELECT * FROM base",
    PLAN,
)
def season_config(spark, d):
    return plans(spark, d)


@query(
    "device_id:s rain_mm_7d:d irrigation_min_7d:d irrigation_mm_7d:d target_mm_7d:d total_mm_7d:d status:s comment:s",
    f"""WITH s AS (SELECT device_id, sum(rain_mm) AS rain, sum(total_min) AS mins, arg_min(target_mm_7d, date) AS target FROM (SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY date) <= 7) GROUP BY 1),
    t AS (SELECT *, rain + mins * 0.4e0 AS total FROM s),
    v AS (SELECT *, CASE WHEN total < 0.8e0 * target THEN 'deficit' WHEN total > 1.2e0 * target THEN 'excess' ELSE 'ok' END AS status FROM t)
    SELECT device_id, round(rain, 2) AS rain_mm_7d, mins AS irrigation_min_7d, round(mins * 0.4e0, 2) AS irrigation_mm_7d, target AS target_mm_7d,
      round(total, 2) AS total_mm_7d, status, CASE status WHEN 'deficit' THEN '{K.BALANCE_COMMENTS["deficit"]}' WHEN 'excess' THEN '{K.BALANCE_COMMENTS["excess"]}' ELSE '{K.BALANCE_COMMENTS["ok"]}' END AS comment FROM v""",
    PLAN,
)
def water_balance_week(spark, d):
    """Only the plan's first seven days count."""
    return planning.water_balance(plans(spark, d), 7)


@query(
    "device_id:s date:s rain_mm:d branch:s",
    "SELECT device_id, date, rain_mm, branch FROM noted WHERE CAST(date AS DATE) >= DATE '2024-04-01' AND CAST(date AS DATE) < DATE '2024-09-01'",
    PLAN,
)
def horizon_plan(spark, d):
    """Plans for a stretch of days cut from a longer forecast."""
    day = plan_date("ts")
    forecast = planning.daily_forecast(adapter.weather_hour(spark, d)).withColumn("date", plan_date("date"))
    soil = adapter.sensor_reading(spark, d).groupBy("device_id", day.alias("date")).agg(F.avg("soil_moist_pct").alias("soil_moist_mean"))
    first = F.lit("2024-04-01").cast("date")
    return planning.build_day_plans(planning.upcoming_days(forecast, first, 153), soil)


@query(
    "device_id:s rain_mm_7d:d irrigation_min_7d:d irrigation_mm_7d:d target_mm_7d:d total_mm_7d:d status:s comment:s",
    f"""WITH s AS (SELECT device_id, sum(rain_mm) AS rain, sum(total_min) AS mins, arg_min(target_mm_7d, date) AS target FROM plan GROUP BY 1),
    t AS (SELECT *, rain + mins * 0.4e0 AS total FROM s),
    v AS (SELECT *, CASE WHEN total < 0.8e0 * target THEN 'deficit' WHEN total > 1.2e0 * target THEN 'excess' ELSE 'ok' END AS status FROM t)
    SELECT device_id, round(rain, 2) AS rain_mm_7d, mins AS irrigation_min_7d, round(mins * 0.4e0, 2) AS irrigation_mm_7d, target AS target_mm_7d,
      round(total, 2) AS total_mm_7d, status, CASE status WHEN 'deficit' THEN '{K.BALANCE_COMMENTS["deficit"]}' WHEN 'excess' THEN '{K.BALANCE_COMMENTS["excess"]}' ELSE '{K.BALANCE_COMMENTS["ok"]}' END AS comment FROM v""",
    PLAN,
)
def water_balance(spark, d):
    return planning.water_balance(plans(spark, d))


@query("device_id:s date:s total_irrigation_min:i", "SELECT device_id, date, total_min AS total_irrigation_min FROM plan", PLAN)
def daily_minutes(spark, d):
    return planning.daily_minutes(plans(spark, d))


@query(
    "device_id:s horizon_group:s summary:s",
    "SELECT device_id, horizon_group, string_agg(note, ' | ' ORDER BY date) AS summary FROM noted GROUP BY 1, 2",
    PLAN,
)
def horizon_summary(spark, d):
    return planning.horizon_summary(plans(spark, d))


@query(
    "device_id:s date:s page:s device:s",
    """SELECT device_id, strftime(start_ts, '%Y-%m-%d') AS date,
      string_agg(strftime(start_ts, '%H:%M') || '-' || strftime(end_ts, '%H:%M') || '/' || duration_min || '/' || coalesce(CAST(decision = 'confirm' AS VARCHAR), '-'), ',' ORDER BY start_ts) AS page,
      string_agg(strftime(start_ts, '%Y-%m-%dT%H:%M:%S') || '-' || strftime(end_ts, '%Y-%m-%dT%H:%M:%S') || '/' || duration_min || '/' || CAST(coalesce(decision = 'confirm', true) AS VARCHAR), ',' ORDER BY start_ts) AS device
    FROM decided GROUP BY 1, 2""",
    PLAN,
)
def slots_by_date(spark, d):
    """Both shapes, each rendered as one text."""
    rows = decided_slots(spark, d)

    def text(names):
        return F.array_join(
            F.transform(
                "slots",
                lambda s: F.concat(
                    s[names[0]], F.lit("-"), s[names[1]], F.lit("/"), s[names[2]].cast("string"), F.lit("/"),
                    F.coalesce(s["decision"].cast("string"), F.lit("-")),
                ),
            ),
            ",",
        )

    page = schedule.slots_by_date(rows).select("device_id", "date", text(("start", "end", "durationMin")).alias("page"))
    device = schedule.slots_by_date(rows, device_shape=True).select(
        "device_id", "date", text(("start_ts", "end_ts", "duration_min")).alias("device")
    )
    return page.join(device, ["device_id", "date"])


# --- schedule views --------------------------------------------------------------------------------

NOW = "2024-03-05 06:45:00"


def at(text):
    return F.lit(text).cast("timestamp")


@query(
    "device_id:s start_ts:t forecast_trigger_ts:t minutes_to_trigger:d",
    f"""WITH t AS (SELECT device_id, start_ts, start_ts - INTERVAL 10 MINUTE AS forecast_trigger_ts,
      (epoch_us(start_ts - INTERVAL 10 MINUTE) - epoch_us(TIMESTAMP '{NOW}')) / 60e6 AS minutes_to_trigger FROM slots),
    a AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY minutes_to_trigger, start_ts) AS r FROM t WHERE minutes_to_trigger >= -5)
    SELECT * FROM a WHERE minutes_to_trigger <= 15 OR (r = 1 AND minutes_to_trigger > -5)""",
    PLAN,
)
def upcoming_slots(spark, d):
    return schedule.upcoming_slots(slots(spark, d), at(NOW))


@query(
    "device_id:s slot_id:t probability:d should_irrigate:b reason:s",
    """SELECT device_id, start_ts AS slot_id, 0.3e0 AS probability, coalesce(decision, 'confirm') = 'confirm' AS should_irrigate, decision_reason AS reason FROM decided
    WHERE abs(epoch_us(start_ts) - epoch_us(TIMESTAMP '2024-12-18 06:59:30')) <= 60000000""",
    PLAN,
)
def decisions_due(spark, d):
    return schedule.decisions_due(decided_slots(spark, d), at("2024-12-18 06:59:30"))


@query(
    "device_id:s start:s end:s duration_min:i decision:s",
    f"""WITH n AS (SELECT max(date) AS today FROM stored WHERE duration_min = 3),
    t AS (SELECT s.*, CAST(n.today AS DATE) + INTERVAL 12 HOUR AS now FROM stored s JOIN n ON s.date = n.today),
    r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY floor(abs(epoch_us(now) - epoch_us(start_ts)) / 60e6), start_ts) AS k FROM t)
    SELECT device_id, strftime(start_ts, '%H:%M') AS start, strftime(end_ts, '%H:%M') AS "end", duration_min,
      CASE WHEN start_ts <= now OR k = 1 THEN decision END AS decision FROM r""",
    PLAN,
)
def today_schedule(spark, d):
    """The last day with two slots, seen at noon."""
    rows = stored_rows(spark, d)
    today = rows.where("duration_min = 3").select(F.max("date")).scalar()
    now = today.cast("date").cast("timestamp") + F.make_dt_interval(hours=F.lit(12))
    return schedule.today_schedule(rows, now)


@query(
    "date:s reason:s decision:b",
    """SELECT strftime(ts, '%d/%m/%Y %H:%M') AS date, event_type AS reason, event_id % 2 = 0 AS decision FROM events ORDER BY ts DESC, event_id DESC LIMIT 10""",
)
def recent_decisions(spark, d):
    e = adapter.events(spark, d)
    rows = e.select(
        F.col("ts").alias("date"), F.col("event_type").alias("reason"), (F.col("event_id") % 2 == 0).alias("decision"),
        F.col("event_id").alias("decision_id"),
    )
    return schedule.recent_decisions(rows)


@query(
    "actor:s event:s details:s created_at:s",
    f"""SELECT 'user-' || CAST(user_id AS VARCHAR) AS actor, CASE event_type {' '.join(f"WHEN '{t}' THEN '{e}'" for t, e in zip(('click', 'view', 'signup', 'purchase'), K.AUDIT_EVENTS))} ELSE 'other' END AS event,
      props AS details, strftime(ts, '%d/%m/%Y %H:%M:%S') AS created_at FROM events""",
)
def audit_log(spark, d):
    return schedule.audit_log(audit(spark, d))


@query(
    "device_id:s ts:t temp_c:d recency:i",
    "SELECT * FROM (SELECT device_id, ts, temp_c, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC) AS recency FROM sensor) WHERE recency <= 12",
    "sensor",
)
def latest_n(spark, d):
    return clean.latest_rows(adapter.sensor_reading(spark, d), 12)


@query(
    "device_id:s ts:t temp_c:d soil_moist_pct:d",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC) AS r FROM sensor) WHERE r = 1",
    "sensor",
)
def latest_reading(spark, d):
    return clean.latest_reading(adapter.sensor_reading(spark, d))


@query(
    "device_id:s ts:t probability:d should_irrigate:b",
    """SELECT device_id, ts, round(p, 4) AS probability, soil_moist_pct < 30 OR (soil_moist_pct < 40 AND p < 0.4e0) AS should_irrigate FROM (
      SELECT s.device_id, s.ts, s.soil_moist_pct, c.p, row_number() OVER (PARTITION BY s.device_id ORDER BY s.ts DESC) AS r
      FROM sensor s JOIN scored c ON c.event_id = s.event_id) WHERE r = 1""",
    "sensor scored",
)
def latest_forecast(spark, d):
    """The newest forecast of each device."""
    scored = adapter.sensor_reading(spark, d).withColumn("probability", score())
    return clean.latest_reading(schedule.forecast_record(scored))


@query(
    "device_id:s ts:t should_irrigate:b reason:s",
    f"""SELECT s.device_id, s.ts, soil_moist_pct < 30 OR (soil_moist_pct < 40 AND p < 0.4e0) AS should_irrigate,
      CASE WHEN soil_moist_pct < 30 THEN '{K.REASON_VERY_DRY}' WHEN soil_moist_pct < 40 AND p < 0.4e0 THEN '{K.REASON_DRY_LOW_RAIN}'
        WHEN p > 0.6e0 THEN '{K.REASON_RAIN_LIKELY}' ELSE '{K.REASON_MOIST}' END AS reason
    FROM sensor s JOIN scored c ON c.event_id = s.event_id""",
    "sensor scored",
)
def irrigation_decision(spark, d):
    scored = adapter.sensor_reading(spark, d).withColumn("p", score())
    return scored.withColumns(scalars.decide_irrigation("soil_moist_pct", "p"))


@query(
    "device_id:s ts:t probability:d label:d rain_amount_mm:d temp_c:d soil_moist_pct:d should_irrigate:b reason:s threshold_used:d",
    f"""WITH r AS (SELECT s.*, CASE WHEN s.event_id % 20 <> 0 THEN c.p END AS probability FROM sensor s JOIN scored c ON c.event_id = s.event_id)
    SELECT device_id, ts, round(probability, 4) AS probability, CASE WHEN probability >= 0.675e0 THEN 1 WHEN probability < 0.675e0 THEN 0 END AS label,
      round((rh_pct - 60) / 30e0, 2) AS rain_amount_mm,
      round(temp_c, 2) AS temp_c, round(soil_moist_pct, 2) AS soil_moist_pct,
      CASE WHEN probability IS NULL THEN true ELSE soil_moist_pct < 30 OR (soil_moist_pct < 40 AND probability < 0.4e0) END AS should_irrigate,
      CASE WHEN probability IS NULL THEN 'Lỗi dự báo. Tưới theo lịch mặc định.' WHEN soil_moist_pct < 30 THEN '{K.REASON_VERY_DRY}'
        WHEN soil_moist_pct < 40 AND probability < 0.4e0 THEN '{K.REASON_DRY_LOW_RAIN}' WHEN probability > 0.6e0 THEN '{K.REASON_RAIN_LIKELY}' ELSE '{K.REASON_MOIST}' END AS reason,
      0.675e0 AS threshold_used FROM r""",
    "sensor scored",
)
def forecast_record(spark, d):
    scored = adapter.keyed_sensor(spark, d).withColumn("probability", F.when(F.col("event_id") % 20 != 0, score()))
    return schedule.forecast_record(scored.withColumn("rain_amount_mm", (F.col("rh_pct") - 60) / 30), 0.675)


@query(
    "device_id:s start_ts:t end_ts:t date:s",
    """WITH f AS (SELECT device_id, min(CAST(date AS DATE)) AS first FROM slots GROUP BY 1)
    SELECT s.device_id, s.start_ts + date_diff('day', f.first, DATE '2025-06-01') * INTERVAL 1 DAY AS start_ts,
      s.end_ts + date_diff('day', f.first, DATE '2025-06-01') * INTERVAL 1 DAY AS end_ts,
      strftime(CAST(s.date AS DATE) + date_diff('day', f.first, DATE '2025-06-01') * INTERVAL 1 DAY, '%Y-%m-%d') AS date
    FROM slots s JOIN f ON f.device_id = s.device_id""",
    PLAN,
)
def schedule_rebase(spark, d):
    return schedule.rebase_schedule(slots(spark, d), F.lit("2025-06-01").cast("date"))


RETIME = """rebased AS (SELECT s.device_id, s.duration_min, s.start_ts + k * INTERVAL 1 DAY AS start_ts, s.end_ts + k * INTERVAL 1 DAY AS end_ts,
    strftime(CAST(s.date AS DATE) + k * INTERVAL 1 DAY, '%Y-%m-%d') AS date
  FROM slots s JOIN (SELECT device_id, date_diff('day', min(CAST(date AS DATE)), DATE '2025-06-01') AS k FROM slots GROUP BY 1) f ON f.device_id = s.device_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY device_id, date ORDER BY start_ts) AS n FROM rebased),
retimed AS (SELECT device_id, date, n, duration_min, date = '2025-06-01' AND n = 1 AS retimed, start_ts AS old_start_ts,
  CASE WHEN date = '2025-06-01' AND n = 1 THEN TIMESTAMP '2025-06-01 09:20:00' ELSE start_ts END AS start_ts,
  CASE WHEN date = '2025-06-01' AND n = 1 THEN TIMESTAMP '2025-06-01 09:20:00' + duration_min * INTERVAL 1 MINUTE ELSE end_ts END AS end_ts FROM numbered)"""


def rebased(spark, d):
    return cut_lineage(schedule.rebase_schedule(slots(spark, d), F.lit("2025-06-01").cast("date")), "rebased")


@query(
    "device_id:s date:s start_ts:t end_ts:t forecast_trigger_ts:t retimed:b",
    f"WITH {RETIME} SELECT *, start_ts - INTERVAL 1 MINUTE AS forecast_trigger_ts FROM retimed",
    PLAN,
)
def slot_retime(spark, d):
    return schedule.retime_first_slot(rebased(spark, d), at("2025-06-01 09:20:30"))


@query(
    "device_id:s date:s place:i old_start_ts:t new_start_ts:t",
    f"""WITH {RETIME}, r AS (SELECT *, row_number() OVER (PARTITION BY device_id, date ORDER BY start_ts) AS place FROM retimed)
    SELECT r.device_id, r.date, r.place, o.start_ts AS old_start_ts, r.start_ts AS new_start_ts FROM r
    JOIN numbered o ON o.device_id = r.device_id AND o.date = r.date AND o.n = r.place WHERE strftime(o.start_ts, '%H:%M') <> strftime(r.start_ts, '%H:%M')""",
    PLAN,
)
def schedule_diff(spark, d):
    before = rebased(spark, d)
    return schedule.schedule_diff(before, schedule.retime_first_slot(before, at("2025-06-01 09:20:30")))


@query(
    "device_id:s start_ts:t status:s",
    """SELECT device_id, start_ts, CASE WHEN decision = 'confirm' THEN 'confirmed' WHEN decision = 'postpone' THEN 'postponed'
      WHEN soil_moist_ref < 30 THEN 'confirmed' WHEN soil_moist_ref < 35 THEN 'postponed' ELSE 'confirmed' END AS status FROM decided""",
    PLAN,
)
def slot_status(spark, d):
    soil = F.col("soil_moist_ref")
    rows = decided_slots(spark, d).withColumn("should_irrigate", F.when(soil < 30, True).when(soil < 35, False))
    return schedule.slot_status(rows)


# --- device state ----------------------------------------------------------------------------------

SESSIONS = """statuses AS (SELECT device_id, ts, CASE event_type WHEN 'click' THEN 'online' ELSE 'offline' END AS status FROM sensor WHERE event_type IN ('click', 'view')),
marked AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {gap}000000 THEN 0 ELSE 1 END AS starts FROM statuses WINDOW w AS (PARTITION BY device_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY device_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT device_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS messages, arg_max(status, ts) AS last_status FROM numbered GROUP BY device_id, s"""
SESSION_COLUMNS = "device_id:s session_start:t session_end:t messages:i last_status:s"


@query(SESSION_COLUMNS, "WITH " + SESSIONS.format(gap=600), "sensor")
def device_sessions(spark, d):
    """Messages here are minutes apart, so ten minutes of silence end a session."""
    return devices.device_sessions(status_messages(spark, d), silence_seconds=600)


@query(
    "online:i known:i",
    """SELECT sum(CASE WHEN event_type = 'click' AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) <= 7200000000 THEN 1 ELSE 0 END) AS online, count(*) AS known FROM (
      SELECT event_type, ts, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC) AS r FROM sensor WHERE event_type IN ('click', 'view')) WHERE r = 1""",
    "sensor",
)
def online_devices(spark, d):
    """Messages here are up to hours apart, so two hours of silence mean offline."""
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return devices.online_devices(status_messages(spark, d), now, silence_seconds=7200)


SILENCES = """WITH n AS (SELECT device_id, ts, coalesce(lead(ts) OVER (PARTITION BY device_id ORDER BY ts), TIMESTAMP '2024-01-31 00:00:00') AS nxt FROM sensor)
    SELECT device_id, ts AS silent_from, nxt AS silent_until, (epoch_us(nxt) - epoch_us(ts)) / 1e6 AS silent_seconds FROM n WHERE (epoch_us(nxt) - epoch_us(ts)) / 1e6 > 900"""


@query(
    "device_id:s silent_from:t silent_until:t silent_seconds:d",
    SILENCES,
    "sensor",
)
def silent_devices(spark, d):
    return devices.silent_devices(adapter.sensor_reading(spark, d), at("2024-01-31 00:00:00"))


@query(
    "device_id:s on_ts:t off_ts:t run_seconds:d ran_in_wet_soil:b past_planned_end:b past_limit:b",
    """WITH m AS (SELECT device_id, ts, CASE event_type WHEN 'signup' THEN 'ON' ELSE 'OFF' END AS pump, event_id % 3 + 1 AS planned FROM sensor WHERE event_type IN ('signup', 'purchase')),
    c AS (SELECT * FROM (SELECT *, lag(pump) OVER (PARTITION BY device_id ORDER BY ts) AS prev FROM m) WHERE prev IS NULL OR prev <> pump),
    r AS (SELECT * FROM (SELECT *, lead(ts) OVER (PARTITION BY device_id ORDER BY ts) AS off_ts FROM c) WHERE pump = 'ON')
    SELECT device_id, ts AS on_ts, off_ts, (epoch_us(off_ts) - epoch_us(ts)) / 1e6 AS run_seconds,
      EXISTS (SELECT 1 FROM sensor s WHERE s.device_id = r.device_id AND s.ts >= r.ts AND s.ts < r.off_ts AND s.soil_moist_pct >= 60) AS ran_in_wet_soil,
      coalesce((epoch_us(off_ts) - epoch_us(ts)) / 1e6 > planned * 60, false) AS past_planned_end,
      coalesce((epoch_us(off_ts) - epoch_us(ts)) / 1e6 > 1200, false) AS past_limit FROM r""",
    "sensor",
)
def pump_runs(spark, d):
    return devices.pump_runs(pump_messages(spark, d), adapter.sensor_reading(spark, d))


@query(
    "device_id:s ts:t series:s value:d",
    """WITH RECURSIVE kept AS (
      SELECT device_id, min(ts) AS ts FROM sensor GROUP BY device_id
      UNION ALL SELECT k.device_id, (SELECT min(s.ts) FROM sensor s WHERE s.device_id = k.device_id AND s.ts >= k.ts + INTERVAL 10 MINUTE) AS ts FROM kept k WHERE k.ts IS NOT NULL),
    t AS (SELECT s.* FROM sensor s JOIN kept k ON k.device_id = s.device_id AND k.ts = s.ts)
    SELECT device_id, ts, 'temp_c' AS series, temp_c AS value FROM t UNION ALL SELECT device_id, ts, 'pressure_hpa', pressure_hpa FROM t
    UNION ALL SELECT device_id, ts, 'soil_moist_pct', soil_moist_pct FROM t""",
    "sensor",
)
def thin_10min(spark, d):
    """Readings of which a third came twice."""
    once = adapter.keyed_sensor(spark, d)
    again = once.unionByName(once.where("event_id % 3 = 0"))
    return devices.to_series(devices.thin_readings(again.select(adapter.sensor_reading(spark, d).columns)))


# --- streams ---------------------------------------------------------------------------------------

def event_stream(spark, d):
    raw = ingest.file_stream(spark, d, adapter.EVENTS_SCHEMA, pathGlobFilter="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withColumns(adapter.sensor_columns())


def finish(*running):
    for q in running:
        q.awaitTermination()


@query(
    "kind:s rows:i first_ts:t last_ts:t",
    """WITH m AS (SELECT ts, event_id % 25 = 7 AS blank, CASE WHEN event_id % 25 = 7 THEN NULL WHEN event_id % 10 = 0 THEN 'missing temperature' WHEN event_id % 15 = 0 THEN 'missing humidity'
       WHEN event_id % 35 = 0 THEN 'missing pressure' WHEN event_id % 45 = 0 THEN 'missing soilMoisture' END AS reason FROM sensor)
    SELECT 'stored' AS kind, count(*) AS "rows", min(ts) AS first_ts, max(ts) AS last_ts FROM m WHERE reason IS NULL AND NOT blank
    UNION ALL SELECT coalesce(reason, 'empty reading'), 2 * count(*), NULL, NULL FROM m WHERE reason IS NOT NULL OR blank GROUP BY 1""",
    "sensor",
)
def stream_ingest(spark, d):
    """Messages with re-deliveries through the stream; what was stored and what was rejected."""
    base = scratch(spark, "ingest")
    messages = cut_lineage(telemetry_json(spark, d), "messages")
    twice = messages.unionByName(messages)
    source = scratch(spark, "message-files")
    twice.select("body").write.parquet(source)
    stream = ingest.file_stream(spark, source, "body string")
    finish(*ingest.ingest(stream, f"{base}/readings", f"{base}/rejects", f"{base}/state", site_tz=K.SITE_TZ, late="40 days"))
    readings = spark.read.parquet(f"{base}/readings")
    rejects = spark.read.parquet(f"{base}/rejects")
    return readings.agg(F.lit("stored").alias("kind"), F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).unionByName(
        rejects.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("rows")),
        allowMissingColumns=True,
    )


@query(
    "device_id:s target_ts:t last_ts:t pressure_slope_1h:d temp_drop_15m:d rh_rise_15m:d soil_moist_smooth:d",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts DESC) AS k FROM sensor),
    b AS (SELECT device_id, max(ts) AS last_ts, max(CASE WHEN k = 1 THEN pressure_hpa END) - max(CASE WHEN k = 12 THEN pressure_hpa END) AS pressure_slope_1h,
      max(CASE WHEN k = 3 THEN temp_c END) - max(CASE WHEN k = 1 THEN temp_c END) AS temp_drop_15m,
      max(CASE WHEN k = 1 THEN rh_pct END) - max(CASE WHEN k = 3 THEN rh_pct END) AS rh_rise_15m, max(CASE WHEN k = 1 THEN soil_moist_pct END) AS soil_moist_smooth
      FROM r WHERE k <= 24 GROUP BY device_id) SELECT *, last_ts AS target_ts FROM b""",
    "sensor",
)
def stream_buffer_features(spark, d):
    """The buffers after the last micro-batch, as serving features."""
    base = scratch(spark, "buffers")
    finish(ingest.append_stream(state.buffer_stream(event_stream(spark, d)), f"{base}/out", f"{base}/state"))
    frames = state.buffer_frames(spark.read.parquet(f"{base}/out"))
    targets = frames.select("device_id", "target_ts").distinct()
    observed = weather_or_defaults(targets, adapter.weather_hour(spark, d), ts="target_ts")
    return serving_features(frames.join(observed, ["device_id", "target_ts"]), ["device_id", "target_ts"])


@query(
    "kind:s rows:i status_devices:i",
    """SELECT CASE event_type WHEN 'click' THEN 'sensor' WHEN 'view' THEN 'status' WHEN 'signup' THEN 'forecast' WHEN 'purchase' THEN 'schedule' ELSE 'unhandled' END AS kind,
      count(*) AS "rows", count(DISTINCT CASE WHEN event_type = 'view' THEN device_id END) AS status_devices FROM sensor GROUP BY 1""",
    "sensor",
)
def stream_route(spark, d):
    base = scratch(spark, "route")
    topic = (
        F.when(F.col("event_type") == "click", F.lit(K.TOPIC_SENSOR))
        .when(F.col("event_type") == "view", F.concat(F.lit(K.TOPIC_STATUS_PREFIX), F.col("device_id")))
        .when(F.col("event_type") == "signup", F.lit(K.TOPIC_FORECAST))
        .when(F.col("event_type") == "purchase", F.lit(K.TOPIC_SCHEDULE))
        .otherwise("other/topic")
    )
    messages = event_stream(spark, d).select(topic.alias("topic"), F.col("props").alias("body"))
    finish(ingest.route(messages, f"{base}/out", f"{base}/state"))
    routed = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    return routed.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("status_device").alias("status_devices")
    )


@query(SESSION_COLUMNS, "WITH " + SESSIONS.format(gap=600), "sensor")
def stream_device_state(spark, d):
    """The same sessions from the stream. A later message of another device moves the watermark past the data."""
    base, source = scratch(spark, "sessions"), scratch(spark, "status-files")
    messages = status_messages(spark, d)
    messages.write.parquet(source)
    stream = state.session_stream(
        ingest.file_stream(spark, source, "device_id string, ts timestamp, status string"), "10 minutes", late="1 minute"
    )
    run = lambda: finish(ingest.append_stream(stream, f"{base}/out", f"{base}/state"))
    run()
    later = messages.agg((F.max("ts") + F.make_dt_interval(days=F.lit(1))).alias("ts"))
    later.select(F.lit("clock").alias("device_id"), "ts", F.lit("online").alias("status")).write.mode("append").parquet(source)
    run()
    return spark.read.parquet(f"{base}/out")


@query("device_id:s silent_from:t silent_until:t silent_seconds:d", SILENCES, "sensor")
def stream_silences(spark, d):
    """The silences from the stream of readings. A later reading of another device moves the watermark past the data."""
    base, source = scratch(spark, "silences"), scratch(spark, "reading-files")
    readings = adapter.sensor_reading(spark, d).select("device_id", "ts")
    readings.write.parquet(source)
    stream = state.silence_stream(ingest.file_stream(spark, source, "device_id string, ts timestamp"), late="1 minute")
    run = lambda: finish(ingest.append_stream(stream, f"{base}/out", f"{base}/state"))
    run()
    later = readings.agg((F.max("ts") + F.make_dt_interval(days=F.lit(1))).alias("ts"))
    later.select(F.lit("clock").alias("device_id"), "ts").write.mode("append").parquet(source)
    run()
    return state.silences(spark.read.parquet(f"{base}/out"), at("2024-01-31 00:00:00"))


@query(
    "date:s rows:i minutes:i",
    """WITH t AS (SELECT DISTINCT device_id, date FROM stored WHERE duration_min = 3),
    kept AS (SELECT date, duration_min FROM stored WHERE (device_id, date) NOT IN (SELECT (device_id, date) FROM t)
      UNION ALL SELECT date, 6 FROM stored WHERE duration_min = 3)
    SELECT date, count(*) AS "rows", sum(duration_min) AS minutes FROM kept GROUP BY 1""",
    PLAN,
)
def stream_schedule_replace(spark, d):
    """Two payloads in one delivery: the plan, then the days of devices with three-minute slots again, six minutes each."""
    base, source = scratch(spark, "schedules"), scratch(spark, "schedule-files")
    rows = stored_rows(spark, d).withColumn("payload_ts", F.lit(1))
    again = rows.where("duration_min = 3").withColumns({"duration_min": F.lit(6), "payload_ts": F.lit(2)})
    rows.unionByName(again).write.parquet(source)
    stream = ingest.file_stream(spark, source, rows.schema.simpleString()[7:-1].replace(":", " "))
    finish(ingest.replace_schedules(stream, f"{base}/table", f"{base}/state"))
    stored = spark.read.parquet(f"{base}/table").withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return stored.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("duration_min").alias("minutes")
    )
