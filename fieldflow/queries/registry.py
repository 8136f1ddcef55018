"""Registry of queries and their SQL counterparts.

A query names its output columns with a type letter (``i`` whole number, ``d`` double rounded to six
digits, ``s`` text, ``b`` boolean, ``t`` timestamp). Both the Spark result and the SQL are brought to
those names and types, so the two can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldflow.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SENSOR = """sensor AS (
  SELECT event_id, user_id, event_type, value, 'esp32-0' || CAST(user_id % 4 AS VARCHAR) AS device_id, ts,
    18e0 + ((event_id * 37) % 170) / 10e0 AS temp_c,
    40e0 + ((event_id * 53) % 550) / 10e0 AS rh_pct,
    1000e0 + ((event_id * 29) % 200) / 10e0 AS pressure_hpa,
    15e0 + ((day(ts) * 7) % 40) + ((event_id * 41) % 100) / 10e0 AS soil_moist_pct,
    CASE WHEN event_type = 'error' THEN value / 100e0 ELSE 0e0 END AS rain_mm_5min
  FROM events)"""

WEATHER = """weather AS (
  SELECT ts, m,
    CASE WHEN (m * 31) % 10 < 1 THEN ((m * 17) % 60) / 10e0 ELSE 0e0 END AS api_rain_1h,
    ((m * 13) % 100) / 100e0 AS api_pop,
    18e0 + (m % 150) / 10e0 AS api_temp_c,
    40e0 + (m % 500) / 10e0 AS api_rh_pct,
    CAST(m % 11 AS DOUBLE) AS api_uvi,
    CAST(500 + 100 * ((day(ts) + m % 2) % 4) AS INTEGER) AS api_weather_code
  FROM (SELECT date_trunc('hour', ts) AS ts, min(event_id) AS m FROM events GROUP BY 1))"""

LABELS = """near AS (
  SELECT s.event_id, sum(w.api_rain_1h) AS r60,
    sum(CASE WHEN w.ts <= s.ts + INTERVAL 30 MINUTE THEN w.api_rain_1h ELSE 0 END) AS r30
  FROM sensor s JOIN weather w ON w.ts > s.ts AND w.ts <= s.ts + INTERVAL 60 MINUTE GROUP BY s.event_id),
following AS (
  SELECT s.event_id, w.api_rain_1h AS r FROM sensor s ASOF JOIN weather w ON w.ts > s.ts),
labels AS (
  SELECT s.event_id, s.ts, s.device_id,
    CASE WHEN round(coalesce(n.r30, f.r, 0e0), 6) > 0.1e0 THEN 1 ELSE 0 END AS rain_next_30,
    CASE WHEN round(coalesce(n.r60, f.r, 0e0), 6) > 0.1e0 THEN 1 ELSE 0 END AS rain_next_60,
    round(coalesce(n.r60, f.r, 0e0), 6) AS rain_amount_next_60_mm
  FROM sensor s LEFT JOIN near n ON n.event_id = s.event_id LEFT JOIN following f ON f.event_id = s.event_id)"""

NEAREST_WEATHER = """nearest AS (
  SELECT event_id, w_ts, api_pop, api_rain_1h, api_temp_c, api_rh_pct, api_uvi, api_weather_code FROM (
    SELECT s.event_id, w.ts AS w_ts, w.api_pop, w.api_rain_1h, w.api_temp_c, w.api_rh_pct, w.api_uvi, w.api_weather_code,
      row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(w.ts) - epoch_us(s.ts)), w.ts) AS r
    FROM sensor s JOIN weather w ON w.ts BETWEEN s.ts - INTERVAL 1 HOUR AND s.ts + INTERVAL 1 HOUR) WHERE r = 1),
joined AS (
  SELECT s.*, coalesce(n.api_pop, 0.2e0) AS api_pop, coalesce(n.api_rain_1h, 0e0) AS api_rain_1h,
    coalesce(n.api_temp_c, s.temp_c) AS api_temp_c, coalesce(n.api_rh_pct, s.rh_pct) AS api_rh_pct,
    coalesce(n.api_uvi, 5e0) AS api_uvi, n.api_weather_code, n.w_ts
  FROM sensor s LEFT JOIN nearest n ON n.event_id = s.event_id)"""


def dew_sql(t: str, rh: str) -> str:
    gamma = f"(17.27e0 * {t} / (237.7e0 + {t}) + ln(greatest({rh}, 1e-3) / 100e0))"
    return f"(237.7e0 * {gamma} / (17.27e0 - {gamma}))"


FEATURES = f"""features AS (
  SELECT event_id, device_id, ts, temp_c, rh_pct, pressure_hpa, soil_moist_pct, rain_mm_5min, api_pop, api_rain_1h,
    coalesce(pressure_hpa - lag(pressure_hpa, 12) OVER w, 0e0) AS pressure_slope_1h,
    coalesce(lag(temp_c, 3) OVER w - temp_c, 0e0) AS temp_drop_15m,
    coalesce(rh_pct - lag(rh_pct, 3) OVER w, 0e0) AS rh_rise_15m,
    {dew_sql('temp_c', 'rh_pct')} - {dew_sql('api_temp_c', 'api_rh_pct')} AS dew_point_diff,
    api_temp_c - temp_c AS temp_bias, soil_moist_pct AS soil_moist_smooth,
    sin(2 * pi() * (month(ts) % 12) / 12e0) AS month_sin, cos(2 * pi() * (month(ts) % 12) / 12e0) AS month_cos,
    sin(2 * pi() * (hour(ts) % 24) / 24e0) AS hour_sin, cos(2 * pi() * (hour(ts) % 24) / 24e0) AS hour_cos,
    api_uvi AS uvi_index
  FROM joined WINDOW w AS (PARTITION BY device_id ORDER BY ts))"""

SCORED = """scored AS (
  SELECT event_id, device_id, ts, CASE WHEN rain_mm_5min > 0 THEN 1 ELSE 0 END AS y,
    round(1 / (1 + exp(-(rh_pct - 67) / 10e0)), 2) AS p FROM sensor)"""

EVENTS_H10 = """candidates AS (
  SELECT s.device_id, s.ts, s.soil_moist_pct, date_trunc('hour', s.ts) AS start_ts
  FROM sensor s JOIN labels l ON l.event_id = s.event_id
  WHERE s.soil_moist_pct < 35 AND l.rain_next_60 = 0 AND hour(s.ts) IN (7, 17)),
irrigation AS (
  SELECT device_id, start_ts, start_ts + d * INTERVAL 1 MINUTE AS end_ts, d AS duration_min FROM (
    SELECT device_id, start_ts, CASE WHEN soil < 25 THEN 3 WHEN soil < 30 THEN 2 ELSE 1 END AS d
    FROM (SELECT device_id, start_ts, arg_min(soil_moist_pct, ts) AS soil FROM candidates GROUP BY 1, 2)))"""

PLAN = """days AS (
  SELECT CAST(ts AS DATE) AS day, sum(api_rain_1h) AS rain_mm, max(api_pop) AS pop_max FROM weather GROUP BY 1),
codes AS (
  SELECT day, code FROM (
    SELECT CAST(ts AS DATE) AS day, api_weather_code AS code,
      row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY count(*) DESC, api_weather_code) AS r
    FROM weather GROUP BY 1, 2) WHERE r = 1),
fc AS (
  SELECT CAST(d.day + 30 * (day(d.day) % 12) * INTERVAL 1 DAY AS DATE) AS date, d.rain_mm, d.pop_max, c.code
  FROM days d JOIN codes c ON c.day = d.day),
soil AS (
  SELECT device_id, CAST(CAST(ts AS DATE) + 30 * (day(ts) % 12) * INTERVAL 1 DAY AS DATE) AS date,
    avg(soil_moist_pct) AS soil FROM sensor GROUP BY 1, 2),
base AS (
  SELECT v.device_id, f.date, f.rain_mm, f.pop_max, f.code, coalesce(s.soil, 35e0) AS soil_moist_ref,
    row_number() OVER (PARTITION BY v.device_id ORDER BY f.date) - 1 AS ix,
    CASE WHEN month(f.date) IN (2, 3, 4) THEN 'spring_anti_nom' WHEN month(f.date) IN (5, 6, 7) THEN 'summer_fast_reaction' ELSE 'fall_winter_saving' END AS season,
    CASE WHEN month(f.date) IN (2, 3, 4) THEN 28e0 WHEN month(f.date) IN (5, 6, 7) THEN 30e0 ELSE 25e0 END AS critical,
    CASE WHEN month(f.date) IN (2, 3, 4) THEN 40e0 WHEN month(f.date) IN (5, 6, 7) THEN 45e0 ELSE 38e0 END AS ok,
    CASE WHEN month(f.date) IN (2, 3, 4) THEN 45e0 WHEN month(f.date) IN (5, 6, 7) THEN 70e0 ELSE 35e0 END AS target_mm_7d,
    CASE WHEN month(f.date) IN (2, 3, 4) THEN 20e0 WHEN month(f.date) IN (5, 6, 7) THEN 15e0 ELSE 12e0 END AS heavy,
    CASE WHEN month(f.date) IN (2, 3, 4) THEN 5e0 ELSE 3e0 END AS medium
  FROM (SELECT DISTINCT device_id FROM soil) v CROSS JOIN fc f
  LEFT JOIN soil s ON s.device_id = v.device_id AND s.date = f.date),
branched AS (
  SELECT *, CASE WHEN ix <= 1 THEN 'd1_2' WHEN ix <= 4 THEN 'd3_5' ELSE 'd6_7' END AS horizon_group,
    CASE WHEN rain_mm >= heavy AND pop_max >= 0.6e0 AND code NOT BETWEEN 700 AND 799 THEN 'heavy_rain'
      WHEN rain_mm >= medium AND code NOT BETWEEN 700 AND 799 AND soil_moist_ref < critical THEN 'medium_rain_dry'
      WHEN rain_mm >= medium AND code NOT BETWEEN 700 AND 799 THEN 'medium_rain'
      WHEN soil_moist_ref < critical THEN 'dry' WHEN soil_moist_ref < ok THEN 'fairly_dry' ELSE 'moist' END AS branch
  FROM base),
plan AS (
  SELECT *, printf('%.1f', round(rain_mm, 1)) || 'mm' AS mm, printf('%.1f', round(soil_moist_ref, 1)) || '%' AS pct,
    CASE branch WHEN 'medium_rain_dry' THEN 1 WHEN 'dry' THEN 6 WHEN 'fairly_dry' THEN 2 ELSE 0 END AS total_min
  FROM branched),
noted AS (
  SELECT *, CASE branch
      WHEN 'heavy_rain' THEN 'Mưa lớn dự kiến ~' || mm || ' (pop_max=' || printf('%.0f', round(pop_max * 100, 0)) || '%), hoãn toàn bộ tưới để tận dụng nước trời.'
      WHEN 'medium_rain_dry' THEN 'Mưa vừa ~' || mm || ', đất rất khô (' || pct || '), tưới nhẹ 1 phút buổi sáng (tưới bù).'
      WHEN 'medium_rain' THEN 'Mưa vừa ~' || mm || ', đất đủ ẩm (' || pct || '), không tưới.'
      WHEN 'dry' THEN 'Ít mưa trong ngày và đất rất khô (' || pct || '), tưới 2 lần 3 phút.'
      WHEN 'fairly_dry' THEN 'Ít mưa trong ngày và đất khá khô (' || pct || '), tưới 1 lần 2 phút.'
      ELSE 'Đất đủ ẩm (' || pct || '), mưa ít, chưa cần tưới.' END AS note
  FROM plan),
slots AS (
  SELECT device_id, CAST(date AS TIMESTAMP) + h * INTERVAL 1 HOUR AS start_ts,
    CAST(date AS TIMESTAMP) + h * INTERVAL 1 HOUR + d * INTERVAL 1 MINUTE AS end_ts, d AS duration_min,
    round(rain_mm, 2) AS rain_mm_day, round(soil_moist_ref, 2) AS soil_moist_ref, strftime(date, '%Y-%m-%d') AS date,
    horizon_group, season
  FROM plan JOIN (VALUES ('medium_rain_dry', 7, 1), ('dry', 7, 3), ('dry', 17, 3), ('fairly_dry', 7, 2)) AS b(branch_name, h, d)
    ON b.branch_name = plan.branch),
decided AS (
  SELECT *, CASE day(start_ts) % 3 WHEN 0 THEN 'confirm' WHEN 1 THEN 'postpone' END AS decision,
    'r' || CAST(day(start_ts) % 3 AS VARCHAR) AS decision_reason FROM slots),
stored AS (
  SELECT device_id, start_ts, end_ts, duration_min, strftime(start_ts, '%Y-%m-%d') AS date,
    coalesce(decision = 'confirm', true) AS decision,
    'Tưới ' || CAST(duration_min AS VARCHAR) || ' phút [' || strftime(start_ts, '%H:%M') || ' - ' || strftime(end_ts, '%H:%M') || ']' AS note
  FROM decided)"""

CTES = {
    "sensor": SENSOR,
    "weather": WEATHER,
    "labels": LABELS,
    "nearest": NEAREST_WEATHER,
    "features": FEATURES,
    "scored": SCORED,
    "irrigation": EVENTS_H10,
    "plan": PLAN,
}

SPARK_CAST = {
    "i": lambda c: F.col(c).cast("bigint"),
    "d": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0),
    "s": lambda c: F.col(c).cast("string"),
    "b": lambda c: F.col(c).cast("boolean"),
    "t": lambda c: F.col(c).cast("timestamp_ntz"),
}
SQL_CAST = {
    "i": "CAST({c} AS BIGINT)",
    "d": "round(CAST({c} AS DOUBLE), 6) + 0e0",
    "s": "CAST({c} AS VARCHAR)",
    "b": "CAST({c} AS BOOLEAN)",
    "t": "CAST({c} AS TIMESTAMP)",
}


def parse_columns(text: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in text.split()]


def query(columns: str, sql: str | None = None, using: str = "", name: str | None = None):
    """Register a query under the function's name. ``using`` lists the shared SQL tables the SQL reads."""
    spec = parse_columns(columns)

    def register(build):
        key = name or build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(use_utc(spark), sf_dir)
            return df.select(*[SPARK_CAST[t](c).alias(c) for c, t in spec])

        run.__name__, run.__doc__ = key, build.__doc__
        QUERIES[key] = run
        if sql is not None:
            wanted = using.split()
            shared = [CTES[c] for c in CTES if c in wanted]
            fields = ", ".join(f'{SQL_CAST[t].format(c=f'"{c}"')} AS "{c}"' for c, t in spec)
            ORACLES[key] = "WITH " + ",\n".join([*shared, f"result AS (\n{sql.strip()}\n)"]) + f"\nSELECT {fields} FROM result"
        return build

    return register
