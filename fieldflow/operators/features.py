"""Lag, rolling, delta, calendar and weather-fusion features, and the three training matrices.

All row-frame features of one call share one chunked window, hence one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from fieldflow.functions import constants as K
from fieldflow.functions.scalars import calendar, dew_point, hour_cycle, month_cycle
from fieldflow.operators.ordered import over_rows

PRO_LAGS = (3, 6, 12, 24)
PRO_FRAMES = (6, 12, 24)


def frame(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def full(value: Column, c: str, w: WindowSpec, rows: int) -> Column:
    """Null until the frame holds ``rows`` values."""
    return F.when(F.count(c).over(frame(w, rows)) == rows, value.over(frame(w, rows)))


def lag_columns(w: WindowSpec, names: Sequence[str], lags: Sequence[int]) -> dict[str, Column]:
    return {f"{c}_lag{k}": F.lag(c, k).over(w) for c in names for k in lags}


def rolling_columns(w: WindowSpec, names: Sequence[str], frames: Sequence[int]) -> dict[str, Column]:
    out = {}
    for c in names:
        for k in frames:
            out[f"{c}_mean{k}"] = full(F.avg(c), c, w, k)
            out[f"{c}_std{k}"] = full(F.stddev_samp(c), c, w, k)
    return out


def delta_columns(w: WindowSpec, names: Sequence[str]) -> dict[str, Column]:
    return {f"{c}_{tag}": F.col(c) - F.lag(c, k).over(w) for c in names for tag, k in (("d30", 6), ("d60", 12))}


def rain_columns(w: WindowSpec) -> dict[str, Column]:
    rain = "rain_mm_5min"
    recent = full(F.sum(rain), rain, w, 3)
    return {
        "rain_in_last_15m": F.coalesce((recent > 0).cast("int"), F.lit(0)),
        "rain_last_30m": full(F.sum(rain), rain, w, 6),
        "rain_last_60m": full(F.sum(rain), rain, w, 12),
    }


def short_delta_columns(w: WindowSpec) -> dict[str, Column]:
    pairs = {"pressure_delta15": "pressure_hpa", "rh_delta15": "rh_pct", "temp_delta15": "temp_c"}
    return {n: F.col(c) - F.lag(c, 3).over(w) for n, c in pairs.items()}


def interaction_columns() -> dict[str, Column]:
    return {
        f"rh_over_pressure_{t}": F.col(f"rh_pct_{t}") / (F.abs(F.col(f"pressure_hpa_{t}")) + 1e-6) for t in ("d30", "d60")
    }


def irrigation_minutes(flagged: DataFrame, **cells) -> DataFrame:
    """Irrigated minutes over the last 36 and 72 rows of the flag (five minutes each), partial frames allowed."""
    minutes = F.col("is_irrigating_now") * F.lit(5.0)
    return over_rows(
        flagged,
        lambda w: {
            "irrig_total_min_last_3h": F.sum(minutes).over(frame(w, 36)),
            "irrig_total_min_last_6h": F.sum(minutes).over(frame(w, 72)),
        },
        before=71,
        **cells,
    )


def nowcast_features(joined: DataFrame, cadence_seconds: int = 300, **cells) -> DataFrame:
    """The 13 training features. ``joined`` holds readings with filled weather columns."""
    hour_rows, quarter_rows, soil_rows = K.CADENCE_ROWS[cadence_seconds]

    def trends(w: WindowSpec) -> dict[str, Column]:
        zero = F.lit(0.0)
        return {
            "pressure_slope_1h": F.coalesce(F.col("pressure_hpa") - F.lag("pressure_hpa", hour_rows).over(w), zero),
            "temp_drop_15m": F.coalesce(F.lag("temp_c", quarter_rows).over(w) - F.col("temp_c"), zero),
            "rh_rise_15m": F.coalesce(F.col("rh_pct") - F.lag("rh_pct", quarter_rows).over(w), zero),
            "soil_moist_smooth": F.avg("soil_moist_pct").over(frame(w, soil_rows)),
        }

    timed = over_rows(joined, trends, before=max(hour_rows, quarter_rows, soil_rows), **cells)
    return timed.withColumns(
        {
            "dew_point_diff": dew_point("temp_c", "rh_pct") - dew_point("api_temp_c", "api_rh_pct"),
            "temp_bias": F.col("api_temp_c") - F.col("temp_c"),
            **month_cycle("ts"),
            **hour_cycle("ts"),
            "uvi_index": F.coalesce(F.col("api_uvi"), F.lit(K.WEATHER_DEFAULTS["api_uvi"])),
        }
    )


def compact_features(labelled: DataFrame, **cells) -> DataFrame:
    """The 19-column set: 15-minute lags and deltas, 30-minute means, recent rain, hour and weekday."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in K.BASE_COLUMNS:
            out[f"{c}_lag15"] = F.lag(c, 3).over(w)
            out[f"{c}_mean30"] = full(F.avg(c), c, w, 6)
        return {**out, **short_delta_columns(w), "rain_in_last_15m": rain_columns(w)["rain_in_last_15m"]}

    timed = over_rows(labelled, build, before=5, **cells)
    days = calendar("ts")
    return timed.withColumns({k: days[k] for k in ("hour_of_day", "day_of_week")})


def wide_features(labelled: DataFrame, **cells) -> DataFrame:
    """The long set: lags, rolling mean and deviation, deltas, rain history, calendar and interactions."""
    names = K.BASE_COLUMNS + [c for c in K.EXTERNAL_COLUMNS if c in labelled.columns]

    def build(w: WindowSpec) -> dict[str, Column]:
        rain = rain_columns(w) if "rain_mm_5min" in labelled.columns else {}
        return {
            **lag_columns(w, names, PRO_LAGS),
            **rolling_columns(w, names, PRO_FRAMES),
            **delta_columns(w, names),
            **rain,
        }

    timed = over_rows(labelled, build, before=max(PRO_LAGS), **cells)
    return timed.withColumns(calendar("ts")).withColumns(interaction_columns())


def feature_names(feature_set: str, columns: Sequence[str] = ()) -> list[str]:
    """Feature columns of a set, in order; for ``wide`` those that exist in ``columns``."""
    if feature_set == "nowcast":
        return list(K.FEATURE_NAMES)
    if feature_set == "compact":
        return (
            K.BASE_COLUMNS
            + ["rain_mm_5min", "pressure_delta15", "rh_delta15", "temp_delta15"]
            + [f"{c}_lag15" for c in K.BASE_COLUMNS]
            + [f"{c}_mean30" for c in K.BASE_COLUMNS]
            + ["rain_in_last_15m", "hour_of_day", "day_of_week"]
        )
    external = [c for c in K.EXTERNAL_COLUMNS if c in columns]
    expanded = [
        f"{c}_{s}"
        for c in K.BASE_COLUMNS + external
        for s in [
            *[f"lag{k}" for k in PRO_LAGS],
            *[f"mean{k}" for k in PRO_FRAMES],
            *[f"std{k}" for k in PRO_FRAMES],
            "d30",
            "d60",
        ]
    ]
    wanted = [
        *K.BASE_COLUMNS,
        "rain_mm_5min",
        "rain_in_last_15m",
        "rain_last_30m",
        "rain_last_60m",
        *["hour_of_day", "day_of_week", "month", "hod_sin", "hod_cos", "dow_sin", "dow_cos"],
        *["is_irrigating_now", "irrig_total_min_last_3h", "irrig_total_min_last_6h"],
        *external,
        *expanded,
        "rh_over_pressure_d30",
        "rh_over_pressure_d60",
    ]
    return [c for c in wanted if c in columns]


def training_matrix(features: DataFrame, names: Sequence[str], target: str, keys: Sequence[str] = ("device_id", "ts")) -> DataFrame:
    """Rows with every feature and the target present; features as float32. Label-like features are refused."""
    leaks = sorted(set(names) & set(K.LABEL_COLUMNS))
    if leaks:
        raise ValueError(f"label columns among the features: {', '.join(leaks)}")
    return features.select(*keys, *[F.col(c).cast("float").alias(c) for c in names], target).dropna(
        subset=[*names, target]
    )


def serving_features(frames: DataFrame, targets: Sequence[str], cadence_seconds: int = 300) -> DataFrame:
    """Features of one buffer per target, as the online side computes them.

    ``frames`` holds the readings of each buffer plus the target's weather columns. The trend points are
    11 and 2 rows back (cadence 300), else the buffer's first row: that differs from training by design.
    A buffer is bounded, so collecting it per target is safe.
    """
    hour_rows, quarter_rows, soil_rows = K.CADENCE_ROWS[cadence_seconds]
    weather = list(K.WEATHER_DEFAULTS)
    rows = F.sort_array(F.collect_list(F.struct("ts", *K.BASE_COLUMNS)))
    buffers = frames.groupBy(*targets).agg(rows.alias("b"), *[F.first(c).alias(c) for c in weather])
    size = F.size("b")
    back = lambda k: F.when(size >= k, F.try_element_at("b", F.lit(-k))).otherwise(F.try_element_at("b", F.lit(1)))
    last = F.try_element_at(F.col("b"), F.lit(-1))
    hour_ago, quarter_ago = back(hour_rows), back(quarter_rows)
    tail = F.slice("b", F.greatest(size - soil_rows + 1, F.lit(1)), F.lit(soil_rows))
    soil_sum = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x["soil_moist_pct"])
    smooth = F.when(size >= soil_rows, soil_sum / soil_rows).otherwise(last["soil_moist_pct"])
    ready = size >= 2
    zero = F.lit(0.0)
    values = {
        "api_pop": F.col("api_pop"),
        "api_rain_1h": F.col("api_rain_1h"),
        "pressure_slope_1h": last["pressure_hpa"] - hour_ago["pressure_hpa"],
        "temp_drop_15m": quarter_ago["temp_c"] - last["temp_c"],
        "rh_rise_15m": last["rh_pct"] - quarter_ago["rh_pct"],
        "dew_point_diff": dew_point(last["temp_c"], last["rh_pct"])
        - dew_point(F.coalesce("api_temp_c", last["temp_c"]), F.coalesce("api_rh_pct", last["rh_pct"])),
        "temp_bias": F.coalesce("api_temp_c", last["temp_c"]) - last["temp_c"],
        "uvi_index": F.col("api_uvi"),
    }
    return buffers.select(
        *targets,
        last["ts"].alias("last_ts"),
        *[last[c].alias(f"last_{c}") for c in K.BASE_COLUMNS],
        *[F.when(ready, v).otherwise(zero).alias(n) for n, v in values.items()],
        F.when(ready, smooth).otherwise(last["soil_moist_pct"]).alias("soil_moist_smooth"),
        *[v.alias(n) for n, v in {**month_cycle(last["ts"]), **hour_cycle(last["ts"])}.items()],
    )
