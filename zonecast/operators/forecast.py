"""Rule forecaster (G20): a deterministic demand forecast as one Column.

``max(1, median * peak_boost * weekend_adj * (1 + min(volume / 1200, .35)))``
with the median of a reference frame (the training part when evaluating).
The median is a one-row aggregate inlined as a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.config import (
    PEAK_HOURS, RULE_FLOOR, RULE_PEAK_BOOST, RULE_VOLUME_CAP, RULE_VOLUME_SCALE, RULE_WEEKEND_ADJ,
)


def rule_forecast_column(base: Column, hour: Column, weekend: Column, volume: Column) -> Column:
    peak = F.when(hour.isin(PEAK_HOURS), F.lit(RULE_PEAK_BOOST)).otherwise(F.lit(1.0))
    wk = F.when(F.coalesce(weekend, F.lit(0)).cast("int") == 1, F.lit(RULE_WEEKEND_ADJ)).otherwise(F.lit(1.0))
    zone = F.lit(1.0) + F.least(F.coalesce(volume.cast("double"), F.lit(0.0)) / F.lit(RULE_VOLUME_SCALE),
                                F.lit(RULE_VOLUME_CAP))
    return F.greatest(F.lit(RULE_FLOOR), base * peak * wk * zone)


def fit_rule_base(reference: DataFrame, target: str = "demand") -> DataFrame:
    """The fitted state: one row with the median target."""
    return reference.agg(F.median(F.col(target).cast("double")).alias("rule_base"))


def rule_forecast(df: DataFrame, reference: DataFrame, target: str = "demand",
                  out_col: str = "predicted_demand") -> DataFrame:
    """Add ``out_col`` to ``df`` using the median target of ``reference``."""
    base = fit_rule_base(reference, target).scalar()
    return df.withColumn(out_col, rule_forecast_column(base, F.col("hour"), F.col("is_weekend"),
                                                       F.col("zone_trip_volume")))
