"""Column expressions. Everything here is a plain Spark expression, usable in any select."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldflow.functions import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dew_point(temp: str | Column, rh: str | Column) -> Column:
    t, r = col(temp), col(rh)
    gamma = K.MAGNUS_A * t / (K.MAGNUS_B + t) + F.log(F.greatest(r, F.lit(K.MIN_RH_PCT)) / 100.0)
    return K.MAGNUS_B * gamma / (K.MAGNUS_A - gamma)


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * math.pi * value / float(period)
    return F.sin(angle), F.cos(angle)


def month_cycle(ts: str | Column) -> dict[str, Column]:
    s, c = cycle(F.month(col(ts)) % 12, 12)
    return {"month_sin": s, "month_cos": c}


def hour_cycle(ts: str | Column) -> dict[str, Column]:
    s, c = cycle(F.hour(col(ts)) % 24, 24)
    return {"hour_sin": s, "hour_cos": c}


def calendar(ts: str | Column) -> dict[str, Column]:
    """Hour, Monday-0 weekday and month, with the day and week cycles."""
    hod, dow = F.hour(col(ts)), F.weekday(col(ts))
    hs, hc = cycle(hod, 24)
    ds, dc = cycle(dow + 1, 7)
    return {
        "hour_of_day": hod,
        "day_of_week": dow,
        "month": F.month(col(ts)),
        "hod_sin": hs,
        "hod_cos": hc,
        "dow_sin": ds,
        "dow_cos": dc,
    }


def band(value: str | Column, steps: list[tuple[float | None, bool, str]]) -> Column:
    """The first step that holds the value; null for a value that is null or NaN."""
    v, out = col(value), None
    for bound, inclusive, name in steps:
        if bound is None:
            return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), out.otherwise(F.lit(name)))
        test = v <= bound if inclusive else v < bound
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def soil_percent(raw: str | Column, dry: int = K.SOIL_RAW_DRY, wet: int = K.SOIL_RAW_WET) -> Column:
    clamped = F.least(F.greatest(col(raw), F.lit(wet)), F.lit(dry))
    return (F.lit(dry) - clamped) / float(dry - wet) * 100.0


def parse_timestamp(text: str | Column, site_tz: str = "UTC") -> Column:
    """``T`` or space between date and time; ``Z``, an offset, or site-local without either; null when unreadable."""
    t = F.replace(F.trim(col(text)), F.lit("T"), F.lit(" "))
    seconds = F.substring(t, 1, 19)
    rest = F.regexp_replace(F.substring(t, 20, 20), r"^\.\d+", "")
    wall = F.try_to_timestamp(seconds, F.lit("yyyy-MM-dd HH:mm:ss"))
    fraction = F.coalesce(F.regexp_extract(t, r"^.{19}\.(\d{1,6})", 1), F.lit(""))
    extra = F.rpad(fraction, 6, "0").cast("bigint")
    with_fraction = F.timestamp_micros(F.unix_micros(wall) + F.coalesce(extra, F.lit(0)))
    sign = F.when(F.startswith(rest, F.lit("-")), -1).otherwise(1)
    offset = sign * (F.substring(rest, 2, 2).cast("int") * 60 + F.substring(rest, 5, 2).cast("int"))
    shifted = F.timestamp_micros(F.unix_micros(with_fraction) - offset.cast("bigint") * 60_000_000)
    return (
        F.when(rest == "Z", with_fraction)
        .when(F.regexp_like(rest, F.lit(r"^[+-]\d{2}:\d{2}$")), shifted)
        .when(rest == "", F.to_utc_timestamp(with_fraction, site_tz))
    )


def season_field(month: Column, field: str) -> Column:
    position = {"season": 1, **{f: i + 2 for i, f in enumerate(K.SEASON_FIELDS)}}[field]
    out = None
    for season in K.SEASONS:
        value = F.lit(season[position])
        out = F.when(month.isin(*season[0]), value) if out is None else out.when(month.isin(*season[0]), value)
    return out


def season_columns(date: str | Column) -> dict[str, Column]:
    month = F.month(col(date))
    return {f: season_field(month, f) for f in ["season", *K.SEASON_FIELDS]}


def decide_irrigation(soil: str | Column, rain_prob: str | Column) -> dict[str, Column]:
    s, p = col(soil), col(rain_prob)
    very_dry, dry, rainy = s < 30, (s < 40) & (p < 0.4), p > 0.6
    return {
        "should_irrigate": F.coalesce(very_dry, F.lit(False)) | F.coalesce(dry, F.lit(False)),
        "reason": F.when(very_dry, K.REASON_VERY_DRY)
        .when(dry, K.REASON_DRY_LOW_RAIN)
        .when(rainy, K.REASON_RAIN_LIKELY)
        .otherwise(K.REASON_MOIST),
    }


def round_to(value: str | Column, digits: int) -> Column:
    """Rounds the binary value, as the sources of these numbers do: 20.275, stored just below, gives 20.27."""
    scale = float(10**digits)
    return F.floor(col(value) * scale + 0.5) / scale


def round_two(value: str | Column) -> Column:
    return round_to(value, 2)


def day_minute(ts: str | Column, site_tz: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), site_tz), "dd/MM/yyyy HH:mm")


def clock(ts: str | Column) -> Column:
    return F.date_format(col(ts), "HH:mm")


def iso(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def minutes(n: int | Column) -> Column:
    return F.make_dt_interval(mins=n if isinstance(n, Column) else F.lit(n))


def horizon_group(index: Column) -> Column:
    """0-based day index to its horizon."""
    return F.when(index <= 1, "d1_2").when(index <= 4, "d3_5").otherwise("d6_7")
