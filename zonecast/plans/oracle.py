"""DuckDB SQL oracles for the registered queries.

Each query is ``WITH <shared CTEs> SELECT ...`` over the pre-registered
driver views. The CTE chain mirrors the Spark operators: events -> trips ->
clean -> panel -> prepared (lags) -> model frame -> split. Output columns
are cast to the Spark result types.
"""

from __future__ import annotations

import math

from zonecast.config import (
    CV_SPLITS, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, PEAK_HOURS, PriceConfig, TRAIN_RATIO, VAL_RATIO,
)

TWO_PI = repr(2 * math.pi)
PEAK = ", ".join(str(h) for h in PEAK_HOURS)


def d(x) -> str:
    """A DOUBLE literal (plain decimals are DECIMAL in DuckDB)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = sql
    DEPS[name] = deps


cte("trips", [], f"""
SELECT
  CAST(1 + user_id % 2 AS DOUBLE) AS VendorID,
  CAST(ts AS TIMESTAMP) AS tpep_pickup_datetime,
  CASE WHEN event_id % 89 = 0 THEN CAST(ts AS TIMESTAMP) - INTERVAL 5 MINUTE
       ELSE CAST(ts AS TIMESTAMP) + to_minutes(CAST(2 + event_id % 40 AS INTEGER)) END AS tpep_dropoff_datetime,
  CAST(event_id % 7 AS DOUBLE) AS passenger_count,
  {d(0.5)} + CAST(event_id % 23 AS DOUBLE) * {d(0.4)} AS trip_distance,
  CASE WHEN event_id % 97 = 0 THEN {d(0.0)} ELSE {d(-73.99)} + CAST(user_id % 4 AS DOUBLE) * {d(0.01)} END AS pickup_longitude,
  CASE WHEN event_id % 97 = 0 THEN {d(0.0)} ELSE {d(40.75)} + CAST(user_id % 3 AS DOUBLE) * {d(0.01)} END AS pickup_latitude,
  {d(-73.95)} AS dropoff_longitude,
  {d(40.72)} AS dropoff_latitude,
  CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3
       WHEN 'purchase' THEN 4 WHEN 'error' THEN 5 END AS DOUBLE) AS payment_type,
  {d(3.0)} + value * {d(0.2)} AS fare_amount,
  {d(0.5)} AS extra, {d(0.5)} AS mta_tax, value * {d(0.02)} AS tip_amount, {d(0.0)} AS tolls_amount,
  {d(0.3)} AS improvement_surcharge,
  {d(4.3)} + value * {d(0.22)} AS total_amount,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN ' y ' ELSE 'n' END AS store_and_fwd_flag
FROM events""")

cte("trips_t", ["trips"], """
SELECT *,
  CAST(epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime) AS DOUBLE) / CAST(60000000.0 AS DOUBLE) AS trip_duration_min
FROM trips""")

cte("clean", ["trips_t"], f"""
SELECT *,
  regexp_replace(upper(coalesce(store_and_fwd_flag, 'N')), '^\\s+|\\s+$', '', 'g') AS flag_clean,
  trip_distance / (trip_duration_min / {d(60.0)}) AS speed_kph,
  CAST(tpep_pickup_datetime AS DATE) AS pickup_date,
  CAST(hour(tpep_pickup_datetime) AS INTEGER) AS hour,
  round_even(pickup_latitude * {d(100.0)}, 0) / {d(100.0)} AS pickup_lat_bin,
  round_even(pickup_longitude * {d(100.0)}, 0) / {d(100.0)} AS pickup_lon_bin
FROM trips_t
WHERE tpep_dropoff_datetime > tpep_pickup_datetime
  AND trip_duration_min BETWEEN 1 AND 240
  AND trip_distance BETWEEN {d(0.1)} AND 100
  AND fare_amount BETWEEN 0 AND 1000
  AND total_amount BETWEEN 0 AND 1500
  AND passenger_count BETWEEN 1 AND 8
  AND pickup_latitude BETWEEN {d(LAT_MIN)} AND {d(LAT_MAX)} AND pickup_longitude BETWEEN {d(LON_MIN)} AND {d(LON_MAX)}
  AND dropoff_latitude BETWEEN {d(LAT_MIN)} AND {d(LAT_MAX)} AND dropoff_longitude BETWEEN {d(LON_MIN)} AND {d(LON_MAX)}
  AND trip_distance / (trip_duration_min / {d(60.0)}) BETWEEN 1 AND 140""")


def calendar_sql(date: str = "pickup_date", hour: str = "hour") -> str:
    dow = f"(isodow({date}) - 1)"
    return f"""
  CAST({dow} AS INTEGER) AS day_of_week,
  CAST(month({date}) AS INTEGER) AS month,
  CAST(week({date}) AS INTEGER) AS week_of_year,
  CAST({dow} >= 5 AS INTEGER) AS is_weekend,
  CAST({hour} IN ({PEAK}) AS INTEGER) AS is_peak_hour,
  CAST(day({date}) <= 3 AS INTEGER) AS is_month_start,
  CAST(day({date}) >= 28 AS INTEGER) AS is_month_end,
  CAST(month({date}) IN (11, 12) AS INTEGER) AS is_high_travel_period,
  sin({TWO_PI} * {hour} / {d(24)}) AS hour_sin,
  cos({TWO_PI} * {hour} / {d(24)}) AS hour_cos,
  sin({TWO_PI} * {dow} / {d(7)}) AS dow_sin,
  cos({TWO_PI} * {dow} / {d(7)}) AS dow_cos"""


cte("panel_core", ["clean"], """
SELECT pickup_date, hour,
  CAST(pickup_lat_bin AS VARCHAR) || '_' || CAST(pickup_lon_bin AS VARCHAR) AS pickup_zone,
  min(pickup_lat_bin) AS pickup_lat_bin, min(pickup_lon_bin) AS pickup_lon_bin,
  count(*) AS demand,
  avg(trip_distance) AS avg_trip_distance, avg(trip_duration_min) AS avg_duration_min,
  avg(passenger_count) AS avg_passenger_count, avg(fare_amount) AS avg_fare_amount,
  avg(total_amount) AS avg_total_amount, avg(tip_amount) AS avg_tip_amount,
  avg(tolls_amount) AS avg_tolls_amount, avg(speed_kph) AS avg_speed_kph,
  count(DISTINCT VendorID) AS vendor_diversity, avg(payment_type) AS payment_mode
FROM clean GROUP BY 1, 2, 3""")

cte("panel", ["panel_core"], f"""
SELECT pickup_date, hour, {calendar_sql()},
  pickup_zone, pickup_lat_bin, pickup_lon_bin,
  CAST(demand AS BIGINT) AS demand, avg_trip_distance, avg_duration_min, avg_passenger_count,
  avg_fare_amount, avg_total_amount, avg_tip_amount, avg_tolls_amount, avg_speed_kph,
  CAST(vendor_diversity AS BIGINT) AS vendor_diversity, payment_mode,
  ln(1 + CAST(demand AS DOUBLE)) AS log_demand,
  CAST(demand AS DOUBLE) / max(demand) OVER () AS demand_norm,
  CAST(count(*) OVER (PARTITION BY pickup_zone) AS BIGINT) AS zone_trip_volume
FROM panel_core""")

cte("prepared", ["panel"], """
SELECT *,
  CAST(date_diff('day', DATE '0001-01-01', pickup_date) + 1 AS INTEGER) AS date_ordinal,
  lag(demand, 1) OVER zw AS lag_1,
  lag(demand, 2) OVER zw AS lag_2,
  lag(demand, 24) OVER zw AS lag_24,
  avg(demand) OVER (zw ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS rolling_mean_3,
  avg(demand) OVER (zw ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_mean_24,
  stddev_samp(demand) OVER (zw ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling_std_24,
  avg(demand) OVER (zw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expanding_mean_zone
FROM panel WINDOW zw AS (PARTITION BY pickup_zone ORDER BY pickup_date, hour)""")

cte("mf", ["prepared"], """
SELECT * FROM prepared
WHERE lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_24 IS NOT NULL AND rolling_mean_3 IS NOT NULL
  AND rolling_mean_24 IS NOT NULL AND rolling_std_24 IS NOT NULL AND expanding_mean_zone IS NOT NULL""")

cte("mf_dates", ["mf"], """
SELECT pickup_date, CAST(row_number() OVER (ORDER BY pickup_date) - 1 AS BIGINT) AS date_idx,
       count(*) OVER () AS n_dates
FROM (SELECT DISTINCT pickup_date FROM mf)""")

cte("split", ["mf", "mf_dates"], f"""
SELECT m.*, CASE WHEN d.date_idx < floor(CAST(d.n_dates AS DOUBLE) * {d(TRAIN_RATIO)}) THEN 'train'
                 WHEN d.date_idx < floor(CAST(d.n_dates AS DOUBLE) * {d(TRAIN_RATIO + VAL_RATIO)}) THEN 'val'
                 ELSE 'test' END AS split
FROM mf m JOIN mf_dates d USING (pickup_date)""")

cte("train_dates", ["split"], """
SELECT pickup_date, CAST(row_number() OVER (ORDER BY pickup_date) - 1 AS BIGINT) AS date_idx,
       count(*) OVER () AS n_dates
FROM (SELECT DISTINCT pickup_date FROM split WHERE split = 'train')""")

cte("folds", ["train_dates"], f"""
SELECT pickup_date, fold,
  CASE WHEN date_idx < n_dates - ({CV_SPLITS} - fold + 1) * (n_dates // {CV_SPLITS + 1}) THEN 'train'
       WHEN date_idx < n_dates - ({CV_SPLITS} - fold + 1) * (n_dates // {CV_SPLITS + 1}) + (n_dates // {CV_SPLITS + 1}) THEN 'val'
  END AS role
FROM train_dates, range(1, {CV_SPLITS + 1}) f(fold)""")

# rule forecast: median demand of the training part
cte("rule_base", ["split"], "SELECT median(CAST(demand AS DOUBLE)) AS rule_base FROM split WHERE split = 'train'")


def rule_forecast_sql(base: str, hour: str = "hour", weekend: str = "is_weekend", volume: str = "zone_trip_volume") -> str:
    return (f"greatest({d(1.0)}, {base} * (CASE WHEN {hour} IN ({PEAK}) THEN {d(1.25)} ELSE {d(1.0)} END)"
            f" * (CASE WHEN coalesce({weekend}, 0) = 1 THEN {d(0.92)} ELSE {d(1.0)} END)"
            f" * ({d(1.0)} + least(coalesce(CAST({volume} AS DOUBLE), {d(0.0)}) / {d(1200.0)}, {d(0.35)})))")


cte("scored", ["split", "rule_base"], f"""
SELECT s.*, {rule_forecast_sql('b.rule_base')} AS predicted_demand
FROM split s CROSS JOIN rule_base b""")

cte("pred_test", ["scored"], """
SELECT pickup_date, hour, day_of_week, month, is_weekend, is_peak_hour, pickup_zone,
  CAST(demand AS DOUBLE) AS actual_demand, predicted_demand,
  CAST(demand AS DOUBLE) - predicted_demand AS error,
  abs(CAST(demand AS DOUBLE) - predicted_demand) AS abs_error,
  (CAST(demand AS DOUBLE) - predicted_demand) * (CAST(demand AS DOUBLE) - predicted_demand) AS sq_error,
  CASE WHEN demand <> 0 THEN abs(CAST(demand AS DOUBLE) - predicted_demand) / CAST(demand AS DOUBLE) END AS pct_error,
  CAST(predicted_demand > demand AS INTEGER) AS over_prediction,
  CAST(predicted_demand < demand AS INTEGER) AS under_prediction
FROM scored WHERE split = 'test'""")


def with_ctes(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in DEPS[n]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order) + "\n"


# --------------------------------------------------------------------------
# price search in SQL: one row per grid point, best by (score desc, index asc)
# --------------------------------------------------------------------------
def price_points_sql(src: str, demand: str, ref: str, cfg: PriceConfig = PriceConfig(), *,
                     elasticity: str | None = None, peak: str | None = None, weekend: str | None = None,
                     volume: str | None = None, keys: str = "*") -> str:
    """SELECT keys, i, price, adjusted_demand, revenue, score, e, ref, demand FROM src x grid."""
    e0 = "_e0"
    carry = [f"{elasticity or d(cfg.elasticity)} AS _e0"]
    f = []
    if peak:
        carry.append(f"{peak} AS _peak")
        f.append(f"(CASE WHEN CAST(_peak AS INTEGER) = 1 THEN {d(cfg.peak_factor)} ELSE {d(1.0)} END)")
    if weekend:
        carry.append(f"{weekend} AS _wk")
        f.append(f"(CASE WHEN CAST(_wk AS INTEGER) = 1 THEN {d(cfg.weekend_factor)} ELSE {d(1.0)} END)")
    if volume:
        carry.append(f"CAST({volume} AS DOUBLE) AS _vol")
        v = "_vol"
        f.append(f"(CASE WHEN {v} > {d(cfg.high_volume_threshold)} THEN {d(cfg.high_volume_factor)} "
                 f"WHEN {v} < {d(cfg.low_volume_threshold)} THEN {d(cfg.low_volume_factor)} ELSE {d(1.0)} END)")
    f.append(f"(CASE WHEN _d >= {d(cfg.high_demand_threshold)} THEN {d(cfg.high_demand_factor)} "
             f"WHEN _d <= {d(cfg.low_demand_threshold)} THEN {d(cfg.low_demand_factor)} ELSE {d(1.0)} END)")
    e = e0
    for x in f:
        e = f"({e} * {x})"
    e = f"greatest({e}, {d(cfg.min_elasticity)})"
    r_band = f"(CASE WHEN _r > 0 THEN _r ELSE {d(cfg.mid_price)} END)"
    lower0 = f"greatest({d(cfg.min_price)}, {r_band} * {d(cfg.min_discount_multiplier)})"
    upper0 = f"least({d(cfg.max_price)}, {r_band} * {d(cfg.max_markup_multiplier)})"
    step = d(cfg.price_step)
    r_dem = f"(CASE WHEN _r > 0 THEN _r ELSE {d(1.0)} END)"
    return f"""
SELECT *, _price * _adj AS _revenue,
       _price * _adj - {d(cfg.price_change_penalty)} * _d * _r * (_pp * _pp) AS _score
FROM (
  SELECT *, greatest(_d * exp(-_e * ((_price - {r_dem}) / {r_dem})), {d(cfg.floor_demand_ratio)} * _d) AS _adj,
         CASE WHEN _r <= 0 THEN {d(0.0)} ELSE (_price - _r) / _r END AS _pp
  FROM (
    SELECT *, _lower + CAST(_i AS DOUBLE) * ((_lower + {step}) - _lower) AS _price
    FROM (
      SELECT *, unnest(range(CAST(ceil(((_upper + {step}) - _lower) / {step}) AS BIGINT))) AS _i
      FROM (
        SELECT *, CASE WHEN {upper0} <= {lower0} THEN {d(cfg.min_price)} ELSE {lower0} END AS _lower,
                  CASE WHEN {upper0} <= {lower0} THEN {d(cfg.max_price)} ELSE {upper0} END AS _upper,
                  {e} AS _e
        FROM (SELECT {keys}, CAST({demand} AS DOUBLE) AS _d, CAST({ref} AS DOUBLE) AS _r, {", ".join(carry)} FROM {src})
      )
    )
  )
)"""


def price_best_sql(points: str, key_cols: list[str], cfg: PriceConfig = PriceConfig()) -> str:
    """Best point per key + static revenue and uplift."""
    keys = ", ".join(key_cols)
    r_dem = f"(CASE WHEN _r > 0 THEN _r ELSE {d(1.0)} END)"
    static_adj = f"greatest(_d * exp(-_e * ((_r - {r_dem}) / {r_dem})), {d(cfg.floor_demand_ratio)} * _d)"
    return f"""
SELECT *, CASE WHEN static_revenue > 0 THEN (expected_revenue - static_revenue) / static_revenue * {d(100.0)}
               ELSE {d(0.0)} END AS uplift_percent
FROM (
  SELECT *, _price AS optimal_price, _adj AS expected_demand, _revenue AS expected_revenue,
         _r AS static_price, _r * {static_adj} AS static_revenue
  FROM ({points})
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY _score DESC, _i ASC) = 1
)"""


def ref_price_sql(cols: list[str], cfg: PriceConfig = PriceConfig()) -> str:
    picks = [f"CASE WHEN CAST({c} AS DOUBLE) > 0 THEN CAST({c} AS DOUBLE) END" for c in cols]
    return f"coalesce({', '.join(picks)}, {d(cfg.mid_price)})"
