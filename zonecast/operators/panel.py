"""Hourly zone demand panel.

Plan shape: trips -> partial HashAggregate on (date, hour, zone) -> one
exchange -> final aggregate. Only three grouping keys travel through the
shuffle; the 14 other key columns are functions of them and are computed
after the aggregation, once per panel row. ``count(DISTINCT VendorID)`` is
planned by Spark as a second aggregation level on (keys, vendor), still with
map-side combine, so a hot zone never ships its raw trips to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.config import PANEL_COLUMNS
from zonecast.functions import calendar as cal
from zonecast.functions.spatial import round_half_even, zone_key
from zonecast.operators.common import materialize as _materialize


def aggregate_panel(trips: DataFrame) -> DataFrame:
    """Group clean trips by (date, hour, zone) with the 11 panel aggregates."""
    lat_bin = round_half_even(F.col("pickup_latitude"))
    lon_bin = round_half_even(F.col("pickup_longitude"))
    keyed = trips.select(
        F.col("pickup_date"), F.col("hour"),
        zone_key(lat_bin, lon_bin).alias("pickup_zone"),
        lat_bin.alias("pickup_lat_bin"), lon_bin.alias("pickup_lon_bin"),
        "VendorID", "trip_distance", "trip_duration_min", "passenger_count", "fare_amount",
        "total_amount", "tip_amount", "tolls_amount", "speed_kph", "payment_type",
    )
    agg = keyed.groupBy("pickup_date", "hour", "pickup_zone").agg(
        F.count(F.lit(1)).alias("demand"),
        F.avg("trip_distance").alias("avg_trip_distance"),
        F.avg("trip_duration_min").alias("avg_duration_min"),
        F.avg("passenger_count").alias("avg_passenger_count"),
        F.avg("fare_amount").alias("avg_fare_amount"),
        F.avg("total_amount").alias("avg_total_amount"),
        F.avg("tip_amount").alias("avg_tip_amount"),
        F.avg("tolls_amount").alias("avg_tolls_amount"),
        F.avg("speed_kph").alias("avg_speed_kph"),
        F.count_distinct("VendorID").alias("vendor_diversity"),
        F.avg("payment_type").alias("payment_mode"),
        # functions of the zone key: min == the single value of the group
        F.min("pickup_lat_bin").alias("pickup_lat_bin"),
        F.min("pickup_lon_bin").alias("pickup_lon_bin"),
    )
    return agg.withColumns(cal.calendar_columns("pickup_date", "hour"))


def add_panel_derived(panel: DataFrame) -> DataFrame:
    """log_demand, demand_norm and zone_trip_volume.

    * ``demand_norm`` divides by the global max, a scalar subquery over a
      partial aggregate; a global window would move every row into one task.
    * ``zone_trip_volume`` (panel rows per zone, not trips) is a count over a
      window partitioned by zone; each zone has at most one row per hour, so
      the window partition is bounded by the calendar, and the exchange on
      zone is the same one the lag windows reuse.
    """
    max_demand = panel.agg(F.max("demand")).scalar()
    # same partitioning and order as the lag windows: one exchange, one sort
    zone_w = (Window.partitionBy("pickup_zone").orderBy("pickup_date", "hour")
              .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return panel.withColumns({
        "log_demand": F.log1p(F.col("demand")),
        "demand_norm": F.col("demand") / max_demand,
        "zone_trip_volume": F.count(F.lit(1)).over(zone_w),
    })


def build_panel(trips: DataFrame, materialize: bool = True) -> DataFrame:
    """Full 31-column demand panel from clean trips (D1-D3), in panel column order.

    With ``materialize`` the aggregated panel is checkpointed once, so the
    global max and the main branch both read it instead of aggregating the
    trips twice.
    """
    core = aggregate_panel(trips)
    if materialize:
        core = _materialize(core)
    return add_panel_derived(core).select(*PANEL_COLUMNS)
