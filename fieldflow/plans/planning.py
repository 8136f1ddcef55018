"""Daily forecast, soil reference, the season-aware day plan, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.functions.scalars import horizon_group, iso, round_two, season_columns, season_field

SLOT_TYPE = "array<struct<start_ts: timestamp, end_ts: timestamp, device_id: string, duration_min: int>>"


def daily_forecast(hourly: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rain sum, highest rain chance and most frequent weather code per day (smallest code on a tie)."""
    return hourly.groupBy(*by, F.to_date("ts").alias("date")).agg(
        F.sum("api_rain_1h").alias("rain_mm"),
        F.max("api_pop").alias("pop_max"),
        F.coalesce(F.mode("api_weather_code", True), F.lit(0)).alias("weather_code_main"),
    )


def pseudo_forecast(history: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """The last days' rain sums as the coming days' forecast, oldest first; no rain chance, no code."""
    daily = history.groupBy(F.to_date("ts").alias("date")).agg(F.sum("api_rain_1h").alias("rain_mm"))
    recent = daily.orderBy(F.desc("date")).limit(days)
    position = F.row_number().over(Window.orderBy("date"))
    return recent.select(
        F.date_add(today, position).alias("date"),
        "rain_mm",
        F.lit(0.0).alias("pop_max"),
        F.lit(0).alias("weather_code_main"),
    )


def soil_reference(readings: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Mean soil moisture of each device's last days, given to its coming days in order."""
    daily = readings.groupBy("device_id", F.to_date("ts").alias("day")).agg(
        F.avg("soil_moist_pct").alias("soil_moist_mean")
    )
    newest = Window.partitionBy("device_id").orderBy(F.desc("day"))
    recent = daily.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= days)
    position = F.row_number().over(Window.partitionBy("device_id").orderBy("day"))
    return recent.select("device_id", F.date_add(today, position).alias("date"), "soil_moist_mean")


def _slot(date: Column, hour: int, minutes: int, device: Column) -> Column:
    start = F.make_timestamp(F.year(date), F.month(date), F.day(date), F.lit(hour), F.lit(0), F.lit(0))
    return F.struct(
        start.alias("start_ts"),
        (start + F.make_dt_interval(mins=F.lit(minutes))).alias("end_ts"),
        device.alias("device_id"),
        F.lit(minutes).alias("duration_min"),
    )


def upcoming_days(forecast: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """The forecast days from ``today`` on, at most ``days`` of them: what a plan is made for, whatever history there is."""
    return forecast.where((F.col("date") >= today) & (F.col("date") < F.date_add(today, days)))


def build_day_plans(forecast: DataFrame, soil: DataFrame) -> DataFrame:
    """One plan row per device and forecast day.

    Every device of ``soil`` gets every forecast day (the day list is one short array, one entry per
    forecast day: narrow a long forecast by ``upcoming_days``); a day without soil reference takes 35 %. Rules, in order: heavy rain that is likely
    and not fog -> nothing; medium rain and not fog -> one minute at 07 h if critically dry; otherwise
    critically dry -> three minutes at 07 and 17 h, below ok -> two minutes at 07 h, else nothing.
    """
    days = forecast.select(F.collect_list("date")).scalar()
    wanted = soil.select("device_id").distinct().select("device_id", F.explode(days).alias("date"))
    base = wanted.join(forecast, "date").join(soil, ["device_id", "date"], "left")
    rows = base.withColumns(
        {
            "soil_moist_ref": F.coalesce("soil_moist_mean", F.lit(K.SOIL_REF_DEFAULT)),
            **season_columns("date"),
            "horizon_group": horizon_group(
                F.row_number().over(Window.partitionBy("device_id").orderBy("date")) - 1
            ),
        }
    )
    soil_ref, rain = F.col("soil_moist_ref"), F.col("rain_mm")
    fog = F.col("weather_code_main").between(*K.FOG_CODES)
    heavy = (rain >= F.col("heavy_rain_mm")) & (F.col("pop_max") >= K.HEAVY_RAIN_POP) & ~fog
    medium = (rain >= F.col("medium_rain_mm")) & ~fog
    critical, thirsty = soil_ref < F.col("soil_critical"), soil_ref < F.col("soil_ok")
    slot = lambda hour, m: _slot(F.col("date"), hour, m, F.col("device_id"))
    nothing = F.array().cast(SLOT_TYPE)
    mm = F.format_string("%.1fmm", F.round(rain, 1))
    pct = F.format_string("%.1f%%", F.round(soil_ref, 1))
    branch = (
        F.when(heavy, "heavy_rain")
        .when(medium & critical, "medium_rain_dry")
        .when(medium, "medium_rain")
        .when(critical, "dry")
        .when(thirsty, "fairly_dry")
        .otherwise("moist")
    )
    text = {
        "heavy_rain": F.concat(
            F.lit("Mưa lớn dự kiến ~"), mm, F.format_string(" (pop_max=%.0f%%), ", F.round(F.col("pop_max") * 100, 0)),
            F.lit("hoãn toàn bộ tưới để tận dụng nước trời."),
        ),
        "medium_rain_dry": F.concat(
            F.lit("Mưa vừa ~"), mm, F.lit(", đất rất khô ("), pct, F.lit("), tưới nhẹ 1 phút buổi sáng (tưới bù).")
        ),
        "medium_rain": F.concat(F.lit("Mưa vừa ~"), mm, F.lit(", đất đủ ẩm ("), pct, F.lit("), không tưới.")),
        "dry": F.concat(F.lit("Ít mưa trong ngày và đất rất khô ("), pct, F.lit("), tưới 2 lần 3 phút.")),
        "fairly_dry": F.concat(F.lit("Ít mưa trong ngày và đất khá khô ("), pct, F.lit("), tưới 1 lần 2 phút.")),
        "moist": F.concat(F.lit("Đất đủ ẩm ("), pct, F.lit("), mưa ít, chưa cần tưới.")),
    }
    note, slots = None, None
    watering = {"medium_rain_dry": [(7, 1)], "dry": [(7, 3), (17, 3)], "fairly_dry": [(7, 2)]}
    for name, value in text.items():
        is_it = F.col("branch") == name
        array = F.array(*[slot(h, m) for h, m in watering[name]]).cast(SLOT_TYPE) if name in watering else nothing
        note = F.when(is_it, value) if note is None else note.when(is_it, value)
        slots = F.when(is_it, array) if slots is None else slots.when(is_it, array)
    return (
        rows.withColumn("branch", branch)
        .withColumns({"note": note, "slots": slots})
        .select(
            "device_id", "date", "rain_mm", "pop_max", "weather_code_main", "soil_moist_ref", "season",
            "target_mm_7d", "horizon_group", "branch", "note", "slots",
        )
    )


def plan_slots(plans: DataFrame) -> DataFrame:
    """Slots with the context of their day."""
    return plans.select(
        round_two("rain_mm").alias("rain_mm_day"),
        round_two("soil_moist_ref").alias("soil_moist_ref"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "horizon_group",
        "season",
        F.explode("slots").alias("s"),
    ).select("s.*", "rain_mm_day", "soil_moist_ref", "date", "horizon_group", "season")


def _minutes() -> Column:
    return F.aggregate("slots", F.lit(0), lambda a, s: a + s["duration_min"])


def daily_minutes(plans: DataFrame) -> DataFrame:
    """Irrigation minutes per device and day; a day without a slot has 0."""
    return plans.select(
        "device_id", F.date_format("date", "yyyy-MM-dd").alias("date"), _minutes().alias("total_irrigation_min")
    )


def water_balance(plans: DataFrame, days: int | None = None) -> DataFrame:
    """Rain plus irrigation of a plan, or of its first ``days`` days, against the target of its first day's season."""
    if days:
        place = F.row_number().over(Window.partitionBy("device_id").orderBy("date"))
        plans = plans.withColumn("_place", place).where(F.col("_place") <= days).drop("_place")
    sums = plans.groupBy("device_id").agg(
        F.sum("rain_mm").alias("rain"),
        F.sum(_minutes()).alias("min"),
        F.min_by(season_field(F.month("date"), "target_mm_7d"), "date").alias("target_mm_7d"),
    )
    mm = F.col("min") * K.MM_PER_MIN_IRRIGATION
    total, target = F.col("rain") + mm, F.col("target_mm_7d")
    status = F.when(total < 0.8 * target, "deficit").when(total > 1.2 * target, "excess").otherwise("ok")
    comment = F.when(status == "deficit", K.BALANCE_COMMENTS["deficit"]).when(
        status == "excess", K.BALANCE_COMMENTS["excess"]
    ).otherwise(K.BALANCE_COMMENTS["ok"])
    return sums.select(
        "device_id",
        round_two("rain").alias("rain_mm_7d"),
        F.col("min").cast("double").alias("irrigation_min_7d"),
        round_two(mm).alias("irrigation_mm_7d"),
        "target_mm_7d",
        round_two(total).alias("total_mm_7d"),
        status.alias("status"),
        comment.alias("comment"),
        F.lit(K.MM_PER_MIN_IRRIGATION).alias("mm_per_min_irrigation"),
    )


def horizon_summary(plans: DataFrame) -> DataFrame:
    """Notes of each horizon joined in date order. A plan holds a handful of days per device."""
    notes = F.sort_array(F.collect_list(F.struct("date", "note")))
    return plans.groupBy("device_id", "horizon_group").agg(
        F.array_join(F.transform(notes, lambda x: x["note"]), " | ").alias("summary")
    )


def schedule_documents(
    plans: DataFrame,
    now: Column,
    mode: str = "scheduler_rule_based_v1",
    lead_minutes: int = 10,
    location: dict[str, float | str] | None = None,
    sources: dict[str, str] | None = None,
) -> DataFrame:
    """One JSON document per device: place, summary, water balance, day details and slots.

    ``sources`` names the inputs; they stand in ``meta`` as ``source_<name>``.
    """
    place = [F.struct(*[F.lit(v).alias(k) for k, v in location.items()]).alias("location")] if location else []
    named = [F.lit(v).alias(f"source_{k}") for k, v in (sources or {}).items()]
    day = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "season",
        "horizon_group",
        round_two("rain_mm").alias("rain_mm"),
        round_two("soil_moist_ref").alias("soil_moist_ref"),
        _minutes().alias("total_irrigation_min"),
        "note",
    )
    slots = F.transform(
        "slots",
        lambda s: F.struct(
            iso(s["start_ts"]).alias("start_ts"),
            iso(s["end_ts"]).alias("end_ts"),
            s["device_id"].alias("device_id"),
            s["duration_min"].alias("duration_min"),
            round_two("rain_mm").alias("rain_mm_day"),
            round_two("soil_moist_ref").alias("soil_moist_ref"),
            F.date_format("date", "yyyy-MM-dd").alias("date"),
            F.col("horizon_group").alias("horizon_group"),
            F.col("season").alias("season"),
            F.concat(iso(s["start_ts"] - F.make_dt_interval(mins=F.lit(lead_minutes))), F.lit("Z")).alias(
                "forecast_trigger_ts"
            ),
        ),
    )
    note_of = lambda g: F.array_join(
        F.transform(F.filter("d", lambda x: x["day"]["horizon_group"] == g), lambda x: x["day"]["note"]), " | "
    )
    grouped = plans.groupBy("device_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("date").alias("k"), day.alias("day"), slots.alias("slots")))).alias("d")
    )
    balance = water_balance(plans)
    body = grouped.join(
        balance.select("device_id", F.struct(*[c for c in balance.columns if c != "device_id"]).alias("water_balance")),
        "device_id",
    )
    document = F.struct(
        F.concat(iso(now), F.lit("Z")).alias("timestamp"),
        F.lit(mode).alias("mode"),
        *place,
        F.struct(
            note_of("d1_2").alias("horizon_1_2_days"),
            note_of("d3_5").alias("horizon_3_5_days"),
            note_of("d6_7").alias("horizon_7_days"),
        ).alias("summary"),
        F.struct(F.size("d").alias("days"), *named).alias("meta"),
        F.col("water_balance"),
        F.transform("d", lambda x: x["day"]).alias("days_detail"),
        F.flatten(F.transform("d", lambda x: x["slots"])).alias("slots"),
    )
    return body.select("device_id", F.to_json(document).alias("document"))
