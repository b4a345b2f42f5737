"""Per-zone lag features.

All seven features share one window spec, so the plan has one exchange on
``pickup_zone``, one sort and one Window operator. Lags count panel rows,
not hours: the panel is sparse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonecast.config import ALL_FEATURES, TARGET
from zonecast.functions.calendar import date_ordinal


def zone_window():
    return Window.partitionBy("pickup_zone").orderBy("pickup_date", "hour")


def add_lag_features(panel: DataFrame, target: str = TARGET) -> DataFrame:
    """date_ordinal + lag_1/2/24 + rolling means/std + expanding mean, excluding the current row."""
    w = zone_window()
    y = F.col(target)
    return panel.withColumns({
        "date_ordinal": date_ordinal(F.col("pickup_date")),
        "lag_1": F.lag(y, 1).over(w),
        "lag_2": F.lag(y, 2).over(w),
        "lag_24": F.lag(y, 24).over(w),
        "rolling_mean_3": F.avg(y).over(w.rowsBetween(-3, -1)),
        "rolling_mean_24": F.avg(y).over(w.rowsBetween(-24, -1)),
        "rolling_std_24": F.stddev_samp(y).over(w.rowsBetween(-24, -1)),
        "expanding_mean_zone": F.avg(y).over(w.rowsBetween(Window.unboundedPreceding, -1)),
    })


def prepare_model_data(panel: DataFrame, target: str = TARGET) -> DataFrame:
    """Add lag features, then drop rows without a date or target (E6, B8): a missing target still holds its place."""
    return add_lag_features(panel.dropna(subset=["pickup_date"]), target).dropna(subset=[target])


def model_frame(panel: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows ready for training: lag features present (the first 24 rows per zone drop out)."""
    return prepare_model_data(panel, target).dropna(subset=ALL_FEATURES + [target])
