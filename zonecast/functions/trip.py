"""Trip-level derived measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_minutes(pickup: Column, dropoff: Column) -> Column:
    """Fractional minutes between two timestamps."""
    return F.timestamp_diff("MICROSECOND", pickup, dropoff) / F.lit(60_000_000.0)


def speed_per_hour(distance: Column, minutes: Column) -> Column:
    """distance / (minutes / 60); a zero duration gives NULL, never inf.

    The distance is in the source's unit (miles), so the value is miles per
    hour although the column keeps the source name ``speed_kph``.
    """
    return F.try_divide(distance, minutes / F.lit(60.0))


def per_mile(amount: Column, distance: Column) -> Column:
    """amount / distance; zero distance gives NULL."""
    return F.try_divide(amount, distance)
