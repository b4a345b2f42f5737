"""Dashboard scenario and drill-down operators (K1-K6).

K1 builds a model-input context row for every requested (zone, hour) from
medians of the prepared panel, falling back (zone, hour) -> zone -> hour ->
all rows. The two calendar-bounded levels are one GROUPING SETS aggregate;
the hour and all-rows levels use the distributed exact median. Each request
row takes the first level that exists. The request table is bounded: zones are
limited by the bounding box (``MAX_ZONES``) and hours by 24.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.config import ALL_FEATURES, PEAK_HOURS
from zonecast.operators.clean import select_zone_hour
from zonecast.operators.common import with_scalars

# columns whose subset median is truncated to int (day-level calendar)
INT_MEDIAN = ["day_of_week", "month", "week_of_year", "is_weekend"]
# columns whose subset median is used as a float (NaN/NULL -> 0.0)
FLOAT_MEDIAN = ["pickup_lat_bin", "pickup_lon_bin", "zone_trip_volume", "date_ordinal",
                "lag_1", "lag_2", "lag_24", "rolling_mean_3", "rolling_mean_24", "rolling_std_24",
                "expanding_mean_zone"]


def zone_hour_requests(prepared: DataFrame) -> DataFrame:
    """Every (zone, hour 0-23) pair: distinct zones x a fixed 24-hour array."""
    return (prepared.select("pickup_zone").distinct()
            .select("pickup_zone", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")))


def context_rows(prepared: DataFrame, requests: DataFrame) -> DataFrame:
    """Feature row per request (zone, hour) in model feature order (K1)."""
    from zonecast.operators.quantiles import rollup_quantile_columns

    med_cols = INT_MEDIAN + FLOAT_MEDIAN
    # (zone, hour) and zone groups hold at most one row per day / hour of the
    # calendar, so Spark's exact median (a per-group value map) is bounded.
    levels = prepared.groupingSets(
        [["pickup_zone", "hour"], ["pickup_zone"]], "pickup_zone", "hour"
    ).agg(*[F.median(F.col(c).cast("double")).alias(c) for c in med_cols],
          F.grouping_id().alias("_gid"))
    # grouping_id bits: zone=2, hour=1 -> (zone,hour)=0, zone=1
    zh = levels.where(F.col("_gid") == 0).select("pickup_zone", "hour", *[F.col(c).alias(f"zh_{c}") for c in med_cols])
    z = levels.where(F.col("_gid") == 1).select("pickup_zone", *[F.col(c).alias(f"z_{c}") for c in med_cols],
                                                 F.lit(True).alias("_z"))
    # hour and all-rows levels span every zone: distributed exact medians from one table of value counts
    lv = rollup_quantile_columns(prepared.select(F.col("hour").cast("int").alias("hour"), *[c for c in med_cols if c != "hour"]),
                                 "hour", {c: (c, 0.5) for c in med_cols})
    h = lv.where(F.col("_total") == 0).select("hour", *[F.col(c).alias(f"h_{c}") for c in med_cols], F.lit(True).alias("_h"))
    # an aggregate, so that an empty table gives a row of NULLs too
    a = lv.where(F.col("_total") == 1).agg(*[F.max(c).alias(f"a_{c}") for c in med_cols])
    zh = zh.withColumn("_zh", F.lit(True))
    j = (requests.join(zh, on=["pickup_zone", "hour"], how="left")
         .join(z, on="pickup_zone", how="left")
         .join(F.broadcast(h), on="hour", how="left"))
    j = with_scalars(j, a)

    def pick(c):
        return (F.when(F.col("_zh").isNotNull(), F.col(f"zh_{c}"))
                .when(F.col("_z").isNotNull(), F.col(f"z_{c}"))
                .when(F.col("_h").isNotNull(), F.col(f"h_{c}"))
                .otherwise(F.col(f"a_{c}")))

    level = (F.when(F.col("_zh").isNotNull(), "zone_hour").when(F.col("_z").isNotNull(), "zone")
             .when(F.col("_h").isNotNull(), "hour").otherwise("all"))
    hour = F.col("hour")
    dow = F.coalesce(pick("day_of_week").cast("int"), F.lit(0))
    two_pi = F.lit(2 * math.pi)
    feats = {
        "hour": hour.cast("int"),
        "day_of_week": dow,
        "month": F.coalesce(pick("month").cast("int"), F.lit(0)),
        "week_of_year": F.coalesce(pick("week_of_year").cast("int"), F.lit(0)),
        "is_weekend": F.coalesce(pick("is_weekend").cast("int"), F.lit(0)),
        "is_peak_hour": hour.isin(PEAK_HOURS).cast("int"),
        "hour_sin": F.sin(two_pi * hour / F.lit(24)),
        "hour_cos": F.cos(two_pi * hour / F.lit(24)),
        "dow_sin": F.sin(two_pi * dow / F.lit(7)),
        "dow_cos": F.cos(two_pi * dow / F.lit(7)),
    }
    for c in FLOAT_MEDIAN:
        feats[c] = F.coalesce(F.when(~F.isnan(pick(c)), pick(c)), F.lit(0.0))
    return j.select("pickup_zone", level.alias("context_level"), *[feats[c].alias(c) for c in ALL_FEATURES])


def zone_list(panel: DataFrame) -> DataFrame:
    """Sorted distinct zones."""
    return panel.select("pickup_zone").distinct().orderBy("pickup_zone")


def zone_history(prepared: DataFrame, n: int = 10, zone: str | None = None) -> DataFrame:
    """Last-n style history per zone: rows ordered by (hour, date), first n per zone (K3).

    With ``zone`` it is the single drill-down; without it every zone gets its
    n rows through a per-zone ``row_number`` window (rows per zone are
    bounded by the calendar: one per hour).
    """
    from pyspark.sql import Window

    df = select_zone_hour(prepared, zone)
    w = Window.partitionBy("pickup_zone").orderBy("hour", "pickup_date")
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def models_by_val_mae(comparison: DataFrame) -> DataFrame:
    """Model table ordered by validation MAE (K5)."""
    return comparison.orderBy("val_mae", "model_name")
