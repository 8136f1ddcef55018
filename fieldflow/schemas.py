"""Explicit schemas of every input; nothing is inferred."""

SENSOR_READING = "ts timestamp, device_id string, temp_c double, rh_pct double, pressure_hpa double, soil_moist_pct double, rain_mm_5min double"
WEATHER_HOUR = (
    "ts timestamp, api_temp_c double, api_rh_pct double, api_pressure_hpa double, api_uvi double, "
    "api_wind_speed double, api_cloud_pct double, api_dew_point double, api_rain_1h double, api_pop double, "
    "api_weather_code int, api_weather_main string, api_weather_desc string"
)
RAIN_LABEL = "ts timestamp, device_id string, rain_next_30 int, rain_next_60 int, rain_amount_next_60_mm double"
IRRIGATION_EVENT = "start_ts timestamp, end_ts timestamp, device_id string, duration_min int"

TELEMETRY_JSON = (
    "deviceId string, device_id string, temperature double, humidity double, pressure double, "
    "pressure_hpa double, soilMoisture double, timestamp string"
)
SLOT_JSON = (
    "start_ts string, end_ts string, device_id string, duration_min int, rain_mm_day double, soil_moist_ref double, "
    "date string, horizon_group string, season string, forecast_trigger_ts string, decision string, "
    "decision_reason string, forecast_checked_at string, status string"
)
DAY_JSON = (
    "date string, season string, horizon_group string, rain_mm double, soil_moist_ref double, "
    "total_irrigation_min double, note string"
)
SCHEDULE_JSON = (
    "timestamp string, mode string, "
    "summary struct<horizon_1_2_days: string, horizon_3_5_days: string, horizon_7_days: string>, "
    "water_balance struct<rain_mm_7d: double, irrigation_min_7d: double, irrigation_mm_7d: double, "
    "target_mm_7d: double, total_mm_7d: double, status: string, comment: string, mm_per_min_irrigation: double>, "
    f"days_detail array<struct<{DAY_JSON.replace(' ', ': ').replace(',: ', ', ')}>>, "
    f"slots array<struct<{SLOT_JSON.replace(' ', ': ').replace(',: ', ', ')}>>"
)
FORECAST_JSON = (
    "timestamp string, slot_id string, "
    "predictions struct<rain_60min: struct<probability: double, label: int>, rain_amount_60min_mm: double>, "
    "recommendation struct<should_irrigate: boolean, reason: string, threshold_used: double>"
)
WEATHER_CODE_JSON = "array<struct<id: int, main: string, description: string>>"
CURRENT_WEATHER_JSON = (
    "dt bigint, main struct<temp: double, humidity: double, pressure: double>, uvi double, "
    f"wind struct<speed: double>, clouds struct<all: double>, weather {WEATHER_CODE_JSON}, rain struct<`1h`: double>"
)
HOURLY_WEATHER_JSON = (
    "dt: bigint, temp: double, humidity: double, pressure: double, uvi: double, wind_speed: double, "
    f"clouds: double, weather: {WEATHER_CODE_JSON}, rain: struct<`1h`: double>, pop: double"
)
ONECALL_JSON = (
    f"current struct<{HOURLY_WEATHER_JSON}>, hourly array<struct<{HOURLY_WEATHER_JSON}>>"
)
