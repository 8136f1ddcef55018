"""Thresholds, defaults, texts and formats that results must agree on."""

# Default device and sensor values
DEFAULT_DEVICE_ID = "esp32-01"
DEFAULT_PRESSURE_HPA = 1013.25
SITE_TZ = "Asia/Ho_Chi_Minh"

# Magnus dew point
MAGNUS_A = 17.27
MAGNUS_B = 237.7
MIN_RH_PCT = 1e-3

# Weather values used when no observation is near
WEATHER_DEFAULTS = {
    "api_pop": 0.2,
    "api_rain_1h": 0.0,
    "api_temp_c": 25.0,
    "api_rh_pct": 70.0,
    "api_uvi": 5.0,
}
CLEAR_SKY_CODE = 800
LEGACY_WEATHER_NAMES = {"api_rain_prob_60": "api_pop", "api_rain_mm_60": "api_rain_1h"}

# Rain labels
RAIN_THRESHOLD_MM = 0.1

# Model features, in this order
FEATURE_NAMES = [
    "api_pop",
    "api_rain_1h",
    "pressure_slope_1h",
    "temp_drop_15m",
    "rh_rise_15m",
    "dew_point_diff",
    "temp_bias",
    "soil_moist_smooth",
    "month_sin",
    "month_cos",
    "hour_sin",
    "hour_cos",
    "uvi_index",
]
BASE_COLUMNS = ["temp_c", "rh_pct", "pressure_hpa", "soil_moist_pct"]
EXTERNAL_COLUMNS = ["api_rain_prob_60", "api_rain_mm_60", "cloud_pct", "wind_mps"]
LABEL_COLUMNS = ["rain_next_30", "rain_next_60", "rain_amount_next_60_mm"]

# Rows per hour, per quarter hour and for soil smoothing, by reading cadence in seconds
CADENCE_ROWS = {300: (12, 3, 1), 15: (240, 60, 20)}

# Seasons: months, name, soil_critical, soil_ok, target_mm_7d, heavy_rain_mm, medium_rain_mm
SEASONS = [
    ((2, 3, 4), "spring_anti_nom", 28.0, 40.0, 45.0, 20.0, 5.0),
    ((5, 6, 7), "summer_fast_reaction", 30.0, 45.0, 70.0, 15.0, 3.0),
    ((8, 9, 10, 11, 12, 1), "fall_winter_saving", 25.0, 38.0, 35.0, 12.0, 3.0),
]
SEASON_FIELDS = ["soil_critical", "soil_ok", "target_mm_7d", "heavy_rain_mm", "medium_rain_mm"]
MM_PER_MIN_IRRIGATION = 0.4
SOIL_REF_DEFAULT = 35.0
HEAVY_RAIN_POP = 0.6
FOG_CODES = (700, 799)

# Status bands: (upper bound, inclusive, name); the last name has no bound
STATUS_BANDS = {
    "soil_moist_pct": [(30, False, "Rất khô"), (50, False, "Khá khô"), (60, False, "Hơi khô"), (80, True, "Đủ ẩm"), (None, False, "Quá ẩm")],
    "rh_pct": [(40, False, "Quá khô"), (60, False, "Lý tưởng"), (70, False, "Hơi ẩm"), (None, False, "Quá cao")],
    "temp_c": [(20, False, "Hơi lạnh"), (25, False, "Mát mẻ"), (30, False, "Dễ chịu"), (None, False, "Nóng")],
    "pressure_hpa": [(1000, False, "Thấp"), (1013.25, False, "Hơi thấp"), (None, False, "Cao")],
}

# Irrigation decision reasons
REASON_VERY_DRY = "Đất rất khô (<30%)"
REASON_DRY_LOW_RAIN = "Đất khô (<40%) và khả năng mưa thấp"
REASON_RAIN_LIKELY = "Khả năng mưa cao (>60%)"
REASON_MOIST = "Đất đủ ẩm hoặc mưa trung bình"

# Audit events
AUDIT_EVENTS = [
    "Người dùng đã đăng nhập vào hệ thống",
    "Lấy danh sách người dùng",
    "Đếm số lượng thiết bị kết nối",
    "Xuất báo cáo dữ liệu từ ESP32",
    "Điều khiển bơm thủ công",
    "Cập nhật firmware cho cảm biến",
    "Xuất báo cáo của AI",
]
ACCOUNT_ROLES = ["USER", "ADMIN"]
EMAIL_SUFFIX = "@gmail.com"

# Soil probe calibration (raw ADC)
SOIL_RAW_DRY = 3000
SOIL_RAW_WET = 1000

# Pump and slot rules on the device
SLOT_SOIL_REF = 60.0
MAX_SLOTS = 32
PUMP_LIMIT_SECONDS = 20 * 60

# Water balance comments by status
BALANCE_COMMENTS = {
    "deficit": "Thiếu nước so với mục tiêu, có thể tăng thời lượng tưới.",
    "excess": "Dư nước so với mục tiêu, có thể giảm tưới.",
    "ok": "Tổng mưa + tưới tuần tới gần với mục tiêu.",
}

# Forecast sent for a slot that has none
DEFAULT_FORECAST = {"probability": 0.3, "label": 0, "rain_amount_60min_mm": 0.5}
DEFAULT_DECISION = "confirm"
DEFAULT_DECISION_REASON = "Demo decision"

# Message topics
TOPIC_SENSOR = "sensor/data/push"
TOPIC_STATUS_PREFIX = "device/status/"
TOPIC_FORECAST = "ai/forecast/rain"
TOPIC_SCHEDULE = "ai/schedule/irrigation"
