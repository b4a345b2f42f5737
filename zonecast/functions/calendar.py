"""Calendar columns (C1-C7, C13, C15): all built-ins, time-zone free on TIMESTAMP_NTZ."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonecast.config import (
    HIGH_TRAVEL_MONTHS,
    MONTH_END_FIRST_DAY,
    MONTH_START_LAST_DAY,
    PEAK_HOURS,
)

TWO_PI = 2 * math.pi


def day_of(ts: Column) -> Column:
    """Floor a timestamp to its day (C1); kept as DATE."""
    return F.to_date(ts)


def day_of_week(c: Column) -> Column:
    """Monday=0 .. Sunday=6."""
    return F.weekday(c)


def iso_week(c: Column) -> Column:
    """ISO-8601 week number (C4)."""
    return F.weekofyear(c)


def is_weekend(dow: Column) -> Column:
    return (dow >= 5).cast("int")


def is_peak_hour(hour: Column) -> Column:
    return hour.isin(PEAK_HOURS).cast("int")


def cyclic_sin(x: Column, period: int) -> Column:
    """sin(2*pi*x/period)."""
    return F.sin(F.lit(TWO_PI) * x / F.lit(period))


def cyclic_cos(x: Column, period: int) -> Column:
    return F.cos(F.lit(TWO_PI) * x / F.lit(period))


def is_month_start(day: Column) -> Column:
    return (day <= MONTH_START_LAST_DAY).cast("int")


def is_month_end(day: Column) -> Column:
    return (day >= MONTH_END_FIRST_DAY).cast("int")


def is_high_travel_period(month: Column) -> Column:
    return month.isin(HIGH_TRAVEL_MONTHS).cast("int")


def date_ordinal(d: Column) -> Column:
    """Proleptic Gregorian ordinal, 0001-01-01 = 1."""
    return F.datediff(d, F.lit("0001-01-01").cast("date")) + F.lit(1)


def calendar_columns(date_col: str = "pickup_date", hour_col: str = "hour") -> dict[str, Column]:
    """All calendar features that depend only on (date, hour), in panel order.

    Used after the panel aggregation, so they are computed once per panel row
    instead of once per trip.
    """
    d = F.col(date_col)
    h = F.col(hour_col)
    dow = day_of_week(d)
    month = F.month(d)
    day = F.dayofmonth(d)
    return {
        "day_of_week": dow,
        "month": month,
        "week_of_year": iso_week(d),
        "is_weekend": is_weekend(dow),
        "is_peak_hour": is_peak_hour(h),
        "is_month_start": is_month_start(day),
        "is_month_end": is_month_end(day),
        "is_high_travel_period": is_high_travel_period(month),
        "hour_sin": cyclic_sin(h, 24),
        "hour_cos": cyclic_cos(h, 24),
        "dow_sin": cyclic_sin(dow, 7),
        "dow_cos": cyclic_cos(dow, 7),
    }


def iso_text(ts: Column) -> Column:
    """ISO text of a date or timestamp, like ``Timestamp.isoformat()``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
