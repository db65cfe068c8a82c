"""Date/time column functions (D01–D12). All are native Column expressions (whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import HOUR_INTENSITY, WEEKDAY_WEIGHT, literal_map


def temporal_parts(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Mon=0), month, day of month."""
    return {"hour": F.hour(ts).cast("int"), "weekday": F.weekday(ts).cast("int"),
            "month": F.month(ts).cast("int"), "day_of_month": F.dayofmonth(ts).cast("int")}


def is_weekend(weekday: Column) -> Column:
    """D02."""
    return F.when(weekday >= 5, 1).otherwise(0)


def is_night(hour: Column, variant: str = "serving") -> Column:
    """D03 / T6. ``code``: hour < 6 or hour > 22 (excludes 22); ``serving`` and ``set``: 22..5."""
    if variant == "code":
        cond = (hour < 6) | (hour > 22)
    elif variant in ("serving", "set"):
        cond = (hour >= 22) | (hour <= 5)
    else:
        raise ValueError(variant)
    return F.when(cond, 1).otherwise(0)


def is_peak(hour: Column, variant: str = "code") -> Column:
    """D04 / T7. ``code`` 7-9 & 17-19; ``rush`` 7-10 & 16-20; ``sim`` {8,9,17,18,19}; ``client`` 8-10 & 17-19."""
    if variant == "code":
        cond = hour.between(7, 9) | hour.between(17, 19)
    elif variant == "rush":
        cond = hour.between(7, 10) | hour.between(16, 20)
    elif variant == "sim":
        cond = hour.isin(8, 9, 17, 18, 19)
    elif variant == "client":
        cond = hour.between(8, 10) | hour.between(17, 19)
    else:
        raise ValueError(variant)
    return F.when(cond, 1).otherwise(0)


def morning_peak(hour: Column) -> Column:
    return F.when(hour.between(7, 9), 1).otherwise(0)


def evening_peak(hour: Column) -> Column:
    return F.when(hour.between(17, 19), 1).otherwise(0)


def cyclical(x: Column, period: int) -> tuple[Column, Column]:
    """(sin, cos) of 2πx/period."""
    a = F.lit(2 * math.pi) * x / F.lit(period)
    return F.sin(a), F.cos(a)


def duration_minutes(start: Column, end: Column) -> Column:
    """Difference in minutes, fractional seconds kept (may be negative on dirty rows)."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60e6)


def hour_deviation(hour: Column) -> Column:
    """D07."""
    return F.abs(hour - 12)


def is_extreme_hour(hour: Column) -> Column:
    return F.when((hour <= 3) | (hour >= 22), 1).otherwise(0)


def traffic_intensity(hour: Column) -> Column:
    """Hour → intensity (literal map, folded into codegen)."""
    return literal_map(HOUR_INTENSITY)[hour]


def weekday_weight(weekday: Column) -> Column:
    return literal_map(WEEKDAY_WEIGHT)[weekday]


def temporal_score(hour: Column, weekday: Column) -> Column:
    return traffic_intensity(hour) * weekday_weight(weekday)


def shift_name(hour: Column) -> Column:
    """Morning 6–14, Evening 14–22, Night otherwise."""
    return (F.when((hour >= 6) & (hour < 14), "Morning")
            .when((hour >= 14) & (hour < 22), "Evening").otherwise("Night"))


SHIFT_HOURS = {"Morning": (6, 14), "Evening": (14, 22), "Night": (22, 6)}


def shift_label(shift: Column) -> Column:
    return (F.when(shift == "Morning", "06:00 - 14:00").when(shift == "Evening", "14:00 - 22:00")
            .otherwise("22:00 - 06:00"))


def shift_hours(shift: Column) -> Column:
    """Hours belonging to a shift as an array (Night wraps midnight)."""
    return (F.when(shift == "Morning", F.sequence(F.lit(6), F.lit(13)))
            .when(shift == "Evening", F.sequence(F.lit(14), F.lit(21)))
            .otherwise(F.array(*[F.lit(h) for h in (22, 23, 0, 1, 2, 3, 4, 5)])))


def in_window(ts: Column, now: Column, days: int) -> Column:
    """Now <= ts <= now + days (inclusive both ends)."""
    return (ts >= now) & (ts <= now + F.make_interval(days=F.lit(days)))


SYNODIC_MONTH = 29.530588853
REFERENCE_NEW_MOON = "2000-01-06"


def moon_phase(ts: Column) -> Column:
    """D12 (definition ours): fraction of the synodic month since a reference new moon, in [0, 1)."""
    d = F.datediff(ts.cast("date"), F.lit(REFERENCE_NEW_MOON).cast("date"))
    return F.pmod(d.cast("double"), F.lit(SYNODIC_MONTH)) / F.lit(SYNODIC_MONTH)
