"""Fixed values and settings.

Everything under "fixed values" must equal the source pipeline's constants for
results to match; they are stated here once, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# fixed values: raw trip columns, in source order
# --------------------------------------------------------------------------
RAW_COLUMNS = [
    "VendorID",
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
    "payment_type",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
    "total_amount",
    "store_and_fwd_flag",
]

# fixed values: numeric raw columns (coerced to double, nulls dropped)
NUMERIC_COLUMNS = [
    "VendorID",
    "passenger_count",
    "trip_distance",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
    "payment_type",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
    "total_amount",
]

# fixed values: columns that must be present before any coercion
CRITICAL_COLUMNS = [
    "tpep_pickup_datetime",
    "tpep_dropoff_datetime",
    "trip_distance",
    "fare_amount",
    "total_amount",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
    "passenger_count",
]

# fixed values: bounding box (inclusive), pickup and dropoff
LAT_MIN, LAT_MAX = 40.40, 41.20
LON_MIN, LON_MAX = -75.20, -72.70

# fixed values: inclusive sanity ranges
DURATION_MIN_RANGE = (1, 240)
DISTANCE_RANGE = (0.1, 100)
FARE_RANGE = (0, 1000)
TOTAL_RANGE = (0, 1500)
PASSENGER_RANGE = (1, 8)
SPEED_RANGE = (1, 140)

# fixed values: calendar rules
PEAK_HOURS = [7, 8, 9, 16, 17, 18, 19]
HIGH_TRAVEL_MONTHS = [11, 12]
MONTH_START_LAST_DAY = 3
MONTH_END_FIRST_DAY = 28

# fixed values: demand panel columns in output order
PANEL_KEY_COLUMNS = [
    "pickup_date",
    "hour",
    "day_of_week",
    "month",
    "week_of_year",
    "is_weekend",
    "is_peak_hour",
    "is_month_start",
    "is_month_end",
    "is_high_travel_period",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "pickup_zone",
    "pickup_lat_bin",
    "pickup_lon_bin",
]
PANEL_AGG_COLUMNS = [
    "demand",
    "avg_trip_distance",
    "avg_duration_min",
    "avg_passenger_count",
    "avg_fare_amount",
    "avg_total_amount",
    "avg_tip_amount",
    "avg_tolls_amount",
    "avg_speed_kph",
    "vendor_diversity",
    "payment_mode",
]
PANEL_DERIVED_COLUMNS = ["log_demand", "demand_norm", "zone_trip_volume"]
PANEL_COLUMNS = PANEL_KEY_COLUMNS + PANEL_AGG_COLUMNS + PANEL_DERIVED_COLUMNS

# fixed values: narrow sink schema of the panel (A9). Fractional columns go to float; calendar
# fields and 0/1 flags to tinyint. Counts (demand, vendor_diversity, zone_trip_volume) keep bigint:
# their range grows with the data.
PANEL_FLOAT_COLUMNS = [
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "pickup_lat_bin", "pickup_lon_bin",
    "avg_trip_distance", "avg_duration_min", "avg_passenger_count", "avg_fare_amount", "avg_total_amount",
    "avg_tip_amount", "avg_tolls_amount", "avg_speed_kph", "payment_mode", "log_demand", "demand_norm",
]
PANEL_TINYINT_COLUMNS = [
    "hour", "day_of_week", "month", "week_of_year", "is_weekend", "is_peak_hour", "is_month_start",
    "is_month_end", "is_high_travel_period",
]

# fixed values: model features, in model input order
BASE_FEATURES = [
    "hour",
    "day_of_week",
    "month",
    "week_of_year",
    "is_weekend",
    "is_peak_hour",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "pickup_lat_bin",
    "pickup_lon_bin",
    "zone_trip_volume",
    "date_ordinal",
]
LAG_FEATURES = [
    "lag_1",
    "lag_2",
    "lag_24",
    "rolling_mean_3",
    "rolling_mean_24",
    "rolling_std_24",
    "expanding_mean_zone",
]
ALL_FEATURES = BASE_FEATURES + LAG_FEATURES
TARGET = "demand"

# fixed values: time split ratios and walk-forward folds
TRAIN_RATIO = 0.70
VAL_RATIO = 0.15
CV_SPLITS = 3

# fixed values: sensitivity elasticities
SENSITIVITY_ELASTICITIES = [0.15, 0.25, 0.35, 0.50, 0.70]

# fixed values: rule forecast (dashboard fallback forecaster)
RULE_PEAK_BOOST = 1.25
RULE_WEEKEND_ADJ = 0.92
RULE_VOLUME_SCALE = 1200.0
RULE_VOLUME_CAP = 0.35
RULE_FLOOR = 1.0

# fixed values: metric guards
METRIC_EPS = 1e-8
OVERFIT_RATIO = 1.10

# Zone bins are 0.01 degrees inside the bounding box, so the number of
# distinct zones is bounded: 81 latitude bins x 251 longitude bins.
MAX_ZONES = (round((LAT_MAX - LAT_MIN) * 100) + 1) * (round((LON_MAX - LON_MIN) * 100) + 1)


@dataclass(frozen=True)
class PriceConfig:
    """Price search settings; every field becomes a literal in a Column."""

    # fixed values: defaults of the pricing rules
    min_price: float = 5.0
    max_price: float = 100.0
    price_step: float = 1.0
    elasticity: float = 0.35
    floor_demand_ratio: float = 0.05
    min_discount_multiplier: float = 0.75
    max_markup_multiplier: float = 1.35
    price_change_penalty: float = 0.015
    # context elasticity rules: (factor, threshold)
    peak_factor: float = 0.85
    weekend_factor: float = 0.95
    high_volume_threshold: float = 700.0
    high_volume_factor: float = 0.90
    low_volume_threshold: float = 200.0
    low_volume_factor: float = 1.05
    high_demand_threshold: float = 150.0
    high_demand_factor: float = 0.90
    low_demand_threshold: float = 20.0
    low_demand_factor: float = 1.08
    min_elasticity: float = 0.05
    # keep grid prices inside the band (the source overshoots by one step)
    clamp: bool = False

    @property
    def mid_price(self) -> float:
        return (self.min_price + self.max_price) / 2.0

    @property
    def max_grid_size(self) -> int:
        """Upper bound of grid points per row (band is inside [min, max])."""
        import math

        return int(math.ceil((self.max_price + self.price_step - self.min_price) / self.price_step)) + 1


@dataclass(frozen=True)
class ModelProfile:
    """Parameter set of one estimator family (cv or final profile)."""

    name: str
    params: dict = field(default_factory=dict)
