"""Work on schedules: what is due, what is shown, and how a schedule changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.functions.scalars import clock, decide_irrigation, round_to
from fieldflow.operators.ordered import micros


def trigger_time(start: str = "start_ts", lead_minutes: int = 10) -> Column:
    return F.col(start) - F.make_dt_interval(mins=F.lit(lead_minutes))


def upcoming_slots(
    slots: DataFrame,
    now: Column,
    lookahead_minutes: float = 15,
    lookback_minutes: float = 5,
    find_next: bool = True,
    lead_minutes: int = 10,
    by: Sequence[str] = ("device_id",),
) -> DataFrame:
    """Slots whose trigger lies in [now - lookback, now + lookahead]; with none, the next one after that start.

    ``by=[]`` gives one answer over all devices.
    """
    known = F.col("forecast_trigger_ts") if "forecast_trigger_ts" in slots.columns else F.lit(None).cast("timestamp")
    timed = slots.withColumn("forecast_trigger_ts", F.coalesce(known, trigger_time("start_ts", lead_minutes)))
    timed = timed.withColumn("minutes_to_trigger", (micros("forecast_trigger_ts") - micros(now)) / 60_000_000)
    ahead = timed.where(F.col("minutes_to_trigger") >= -lookback_minutes)
    near = F.col("minutes_to_trigger") <= lookahead_minutes
    if not find_next:
        return ahead.where(near)
    # the first slot ahead is either inside the window, or the only one to return
    first = F.row_number().over(Window.partitionBy(*by).orderBy("minutes_to_trigger", "start_ts")) == 1
    return (
        ahead.withColumn("_first", first)
        .where(near | (F.col("_first") & (F.col("minutes_to_trigger") > -lookback_minutes)))
        .drop("_first")
    )


def decisions_due(slots: DataFrame, now: Column, window_minutes: float = 1) -> DataFrame:
    """Unpublished slots that start within the window of ``now``, as forecast messages with default contents.

    ``slots`` may carry ``decision``, ``decision_reason``, ``probability`` and ``decision_published``.
    """
    have = lambda c, kind: F.col(c) if c in slots.columns else F.lit(None).cast(kind)
    away = F.abs(micros("start_ts") - micros(now))
    decision = F.coalesce(have("decision", "string"), F.lit(K.DEFAULT_DECISION))
    return slots.where(
        (away <= int(window_minutes * 60_000_000)) & ~F.coalesce(have("decision_published", "boolean"), F.lit(False))
    ).select(
        "device_id",
        F.col("start_ts").alias("slot_id"),
        F.coalesce(have("probability", "double"), F.lit(K.DEFAULT_FORECAST["probability"])).alias("probability"),
        (decision == "confirm").alias("should_irrigate"),
        F.coalesce(have("decision_reason", "string"), F.lit(K.DEFAULT_DECISION_REASON)).alias("reason"),
        now.alias("published_at"),
    )


def slots_by_date(rows: DataFrame, device_shape: bool = False) -> DataFrame:
    """Slots of each device and date, sorted, as JSON.

    The page's shape has clock times and a null decision where none was made; the device's shape has
    full times and takes a missing decision as yes.
    """
    decided = F.col("decision") == "confirm"
    time = (lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) if device_shape else clock
    names = ("start_ts", "end_ts", "duration_min") if device_shape else ("start", "end", "durationMin")
    item = F.struct(
        time("start_ts").alias(names[0]),
        time("end_ts").alias(names[1]),
        F.col("duration_min").alias(names[2]),
        (F.coalesce(decided, F.lit(True)) if device_shape else decided).alias("decision"),
    )
    return rows.groupBy("device_id", F.date_format("start_ts", "yyyy-MM-dd").alias("date")).agg(
        F.sort_array(F.collect_list(item)).alias("slots")
    )


def executable_slots(rows: DataFrame, limit: int = K.MAX_SLOTS) -> DataFrame:
    """What a device stores: confirmed slots with valid times, the first 32 in order. A missing decision is no."""
    order = Window.partitionBy("device_id").orderBy("start_ts", "end_ts")
    return (
        rows.where(F.coalesce(F.col("decision"), F.lit(False)) & F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
        .withColumn("slot_no", F.row_number().over(order))
        .where(F.col("slot_no") <= limit)
        .withColumn("soil_ref", F.lit(K.SLOT_SOIL_REF))
    )


def today_schedule(rows: DataFrame, now: Column, site_tz: str = "UTC") -> DataFrame:
    """Today's slots in order. The decision shows once a slot has begun, and for the slot nearest to now."""
    today = F.date_format(F.from_utc_timestamp(now, site_tz), "yyyy-MM-dd")
    distance = F.floor(F.abs(micros(now) - micros("start_ts")) / 60_000_000)
    nearest = Window.partitionBy("device_id").orderBy("_distance", "start_ts")
    return (
        rows.where(F.col("date") == today)
        .withColumn("_distance", distance)
        .withColumn("_near", F.row_number().over(nearest) == 1)
        .select(
            "device_id",
            clock("start_ts").alias("start"),
            clock("end_ts").alias("end"),
            "duration_min",
            F.when((F.col("start_ts") <= now) | F.col("_near"), F.coalesce("decision", F.lit(True))).alias("decision"),
        )
    )


def recent_decisions(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("date"), F.desc("decision_id")).limit(n).select(
        F.date_format("date", "dd/MM/yyyy HH:mm").alias("date"), "reason", "decision"
    )


def audit_log(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("created_at")).select(
        "actor", "event", "details", F.date_format("created_at", "dd/MM/yyyy HH:mm:ss").alias("created_at")
    )


def slot_status(slots: DataFrame, missing: bool = True) -> DataFrame:
    """Status from the operator's decision, else from the forecast (``missing`` where it gave none)."""
    decision = F.col("decision")
    from_forecast = F.when(F.coalesce("should_irrigate", F.lit(missing)), "confirmed").otherwise("postponed")
    return slots.withColumn(
        "status",
        F.when(decision == "confirm", "confirmed")
        .when(decision == "postpone", "postponed")
        .when(decision == "skip", "skipped")
        .otherwise(from_forecast),
    )


def rebase_schedule(slots: DataFrame, first_date: Column, by: Sequence[str] = ("device_id",)) -> DataFrame:
    """Move every slot by the days between the schedule's first date and ``first_date``."""
    begin = slots.groupBy(*by).agg(F.min(F.to_date("date")).alias("_first"))
    shift = F.make_dt_interval(days=F.datediff(first_date, F.col("_first")))
    moved = slots.join(begin, list(by))
    return moved.withColumns(
        {
            "date": F.date_format(F.date_add(F.to_date("date"), F.datediff(first_date, F.col("_first"))), "yyyy-MM-dd"),
            "start_ts": F.col("start_ts") + shift,
            "end_ts": F.col("end_ts") + shift,
        }
    ).drop("_first")


def retime_first_slot(slots: DataFrame, at: Column, lead_minutes: int = 1) -> DataFrame:
    """Move each device's first slot on the day of ``at`` to ``at`` (whole minute) if that hour is in 8..17."""
    day = F.date_format(at, "yyyy-MM-dd")
    first = Window.partitionBy("device_id", "date").orderBy("start_ts")
    numbered = slots.withColumn("_n", F.row_number().over(first))
    moves = (F.col("date") == day) & (F.col("_n") == 1) & F.hour(at).between(8, 17)
    start = F.when(moves, F.date_trunc("minute", at)).otherwise(F.col("start_ts"))
    end = F.when(moves, F.date_trunc("minute", at) + F.make_dt_interval(mins=F.col("duration_min"))).otherwise(F.col("end_ts"))
    moved = numbered.withColumns({"_s": start, "_e": end, "retimed": moves})
    return moved.withColumns({"start_ts": F.col("_s"), "end_ts": F.col("_e")}).withColumn(
        "forecast_trigger_ts", trigger_time("start_ts", lead_minutes)
    ).drop("_n", "_s", "_e")


def schedule_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Slots whose time of day differs from the slot at the same place of the same day in ``before``."""
    place = F.row_number().over(Window.partitionBy("device_id", "date").orderBy("start_ts"))
    old = before.select("device_id", "date", F.col("start_ts").alias("old_start_ts"), place.alias("place"))
    new = after.select("device_id", "date", F.col("start_ts").alias("new_start_ts"), place.alias("place"))
    return new.join(old, ["device_id", "date", "place"]).where(clock("old_start_ts") != clock("new_start_ts"))


def forecast_record(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rounded forecast with label, rain amount (null without one), sensor reference and advice.

    Without a score the slot is irrigated by default.
    """
    p = F.col("probability")
    amount = F.col("rain_amount_mm") if "rain_amount_mm" in scored.columns else F.lit(None).cast("double")
    advice = decide_irrigation("soil_moist_pct", "probability")
    failed = p.isNull()
    return scored.select(
        "device_id",
        "ts",
        round_to(p, 4).alias("probability"),
        (p >= threshold).cast("int").alias("label"),
        round_to(amount, 2).alias("rain_amount_mm"),
        *[round_to(c, 2).alias(c) for c in K.BASE_COLUMNS],
        F.when(failed, F.lit(True)).otherwise(advice["should_irrigate"]).alias("should_irrigate"),
        F.when(failed, F.lit("Lỗi dự báo. Tưới theo lịch mặc định.")).otherwise(advice["reason"]).alias("reason"),
        F.lit(threshold).alias("threshold_used"),
    )
