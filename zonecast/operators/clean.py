"""Trip cleaning and trip-level features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.config import (
    CRITICAL_COLUMNS, DISTANCE_RANGE, DURATION_MIN_RANGE, FARE_RANGE, LAT_MAX, LAT_MIN,
    LON_MAX, LON_MIN, NUMERIC_COLUMNS, PASSENGER_RANGE, SPEED_RANGE, TOTAL_RANGE,
)
from zonecast.functions import calendar as cal
from zonecast.functions.spatial import round_half_even, zone_key
from zonecast.functions.text import normalise_flag
from zonecast.functions.trip import duration_minutes, per_mile, speed_per_hour


def _all_not_null(raw: DataFrame, cols) -> Column:
    """No NULL, and no NaN, in any of the columns."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
        if isinstance(raw.schema[c].dataType, T.DoubleType):
            cond = cond & ~F.isnan(c)
    return cond


def _in_box(lat: str, lon: str) -> Column:
    return F.col(lat).between(LAT_MIN, LAT_MAX) & F.col(lon).between(LON_MIN, LON_MAX)


def cleaning_stages(raw: DataFrame) -> dict[str, Column]:
    """Cumulative stage predicates over the raw trip frame, in pipeline order."""
    present = F.col("_critical_present") if "_critical_present" in raw.columns else _all_not_null(raw, CRITICAL_COLUMNS)
    numeric_ok = _all_not_null(raw, NUMERIC_COLUMNS) & _all_not_null(raw, CRITICAL_COLUMNS)
    minutes = duration_minutes(F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime"))
    speed = speed_per_hour(F.col("trip_distance"), minutes)
    valid = (
        (F.col("tpep_dropoff_datetime") > F.col("tpep_pickup_datetime"))
        & minutes.between(*DURATION_MIN_RANGE)
        & F.col("trip_distance").between(*DISTANCE_RANGE)
        & F.col("fare_amount").between(*FARE_RANGE)
        & F.col("total_amount").between(*TOTAL_RANGE)
        & F.col("passenger_count").between(*PASSENGER_RANGE)
        & _in_box("pickup_latitude", "pickup_longitude")
        & _in_box("dropoff_latitude", "dropoff_longitude")
        & speed.between(*SPEED_RANGE)
    )
    s1 = present
    s2 = s1 & numeric_ok
    s3 = s2 & valid
    return {"after_dropna": s1, "after_numeric_coercion": s2, "clean_rows": s3}


def cleaning_summary(raw: DataFrame) -> DataFrame:
    """One-pass counters of the cleaning stages (A8): a single partial aggregate, no shuffle of rows.

    ``count_if`` counts a NULL predicate as false, as the filter does.
    """
    st = cleaning_stages(raw)
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(st["after_dropna"]).alias("after_dropna"),
        F.count_if(st["after_numeric_coercion"]).alias("after_numeric_coercion"),
        F.count_if(st["clean_rows"]).alias("clean_rows"),
    ).withColumn("removed_rows", F.col("raw_rows") - F.col("clean_rows"))


def clean_trips(raw: DataFrame) -> DataFrame:
    """Valid trips with trip, time, spatial and calendar features.

    The filters are plain column predicates, so Catalyst pushes the range and
    null checks into the scan of a typed Parquet source.
    """
    st = cleaning_stages(raw)
    kept = raw.where(st["clean_rows"]).drop("_critical_present")
    minutes = duration_minutes(F.col("tpep_pickup_datetime"), F.col("tpep_dropoff_datetime"))
    pickup = F.col("tpep_pickup_datetime")
    out = kept.withColumns({
        "store_and_fwd_flag": normalise_flag(F.col("store_and_fwd_flag")),
        "trip_duration_min": minutes,
    }).withColumns({
        "speed_kph": speed_per_hour(F.col("trip_distance"), F.col("trip_duration_min")),
        "fare_per_mile": per_mile(F.col("fare_amount"), F.col("trip_distance")),
        "total_per_mile": per_mile(F.col("total_amount"), F.col("trip_distance")),
        "pickup_date": cal.day_of(pickup),
        "hour": F.hour(pickup),
        "day": F.dayofmonth(pickup),
    })
    out = out.withColumns(cal.calendar_columns("pickup_date", "hour"))
    out = out.withColumns({
        "pickup_lat_bin": round_half_even(F.col("pickup_latitude")),
        "pickup_lon_bin": round_half_even(F.col("pickup_longitude")),
        "dropoff_lat_bin": round_half_even(F.col("dropoff_latitude")),
        "dropoff_lon_bin": round_half_even(F.col("dropoff_longitude")),
    }).withColumns({
        "pickup_zone": zone_key(F.col("pickup_lat_bin"), F.col("pickup_lon_bin")),
        "dropoff_zone": zone_key(F.col("dropoff_lat_bin"), F.col("dropoff_lon_bin")),
    })
    return out


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``cols``."""
    return df.dropna(subset=list(cols))


def select_zone_hour(df: DataFrame, zone: str | None = None, hour: int | None = None) -> DataFrame:
    """Equality drill-down filters."""
    out = df
    if zone is not None:
        out = out.where(F.col("pickup_zone") == F.lit(zone))
    if hour is not None:
        out = out.where(F.col("hour") == F.lit(int(hour)))
    return out


CLEAN_TRIP_EXTRA = ["trip_duration_min", "speed_kph", "fare_per_mile", "total_per_mile"]
