"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus their DuckDB oracles.

Every query reads the driver tables (``events`` through the trip adapter) in
full. Date and timestamp columns are presented as ISO text, the form the
source pipeline writes to its CSV sinks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.config import (
    ALL_FEATURES, CRITICAL_COLUMNS, NUMERIC_COLUMNS, PANEL_COLUMNS, PANEL_FLOAT_COLUMNS, PANEL_TINYINT_COLUMNS, RAW_COLUMNS,
)
from zonecast.operators import clean as C
from zonecast.operators import lags as L
from zonecast.operators import metrics as M
from zonecast.operators import panel as PN
from zonecast.operators import splits as S
from zonecast.operators.forecast import rule_forecast
from zonecast.plans import oracle as O
from zonecast.session import ensure_checkpoint_dir
from zonecast.sources import panel_store as PS
from zonecast.sources.sinks import shared_dir, write_table
from zonecast.sources.trips import TIMESTAMP_COLUMNS, parse_raw_trips, raw_trips, read_raw_trips_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def present(df: DataFrame) -> DataFrame:
    """Dates as 'yyyy-MM-dd', timestamps as 'yyyy-MM-dd HH:mm:ss' text (the CSV sink form)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_date(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {c}"


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


# --------------------------------------------------------------------------
# shared Spark building blocks: panel and model rows come from a store partitioned by date
# --------------------------------------------------------------------------
def trips(spark, sf):
    return raw_trips(spark, sf)


def clean(spark, sf):
    return C.clean_trips(trips(spark, sf))


def _store(spark, sf, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return shared_dir(spark, "zonecast-store", PS.fingerprint(spark, f"{sf.rstrip('/')}/events.parquet"), name)


def panel(spark, sf):
    return PS.stored_once(spark, _store(spark, sf, "panel"), lambda: PN.build_panel(clean(spark, sf)))


def model_rows(spark, sf):
    return PS.stored_once(spark, _store(spark, sf, "model_rows"), lambda: L.model_frame(panel(spark, sf)))


def bounds(spark, sf) -> S.DateBounds:
    return PS.date_bounds(model_rows(spark, sf))


def split_rows(spark, sf):
    """Model rows with their part; a filter on ``split`` prunes the store's dates."""
    return model_rows(spark, sf).withColumn("split", bounds(spark, sf).label())


def scored(spark, sf):
    """Model rows with the rule forecast fitted on the training part."""
    sp = split_rows(spark, sf)
    return rule_forecast(sp, sp.where(F.col("split") == "train"))


def test_predictions(spark, sf):
    return M.prediction_frame(scored(spark, sf).where(F.col("split") == "test"))


# --------------------------------------------------------------------------
# A / B / C: sources, cleaning, features
# --------------------------------------------------------------------------
_CRIT = " AND ".join(f"{c} IS NOT NULL" for c in CRITICAL_COLUMNS)
_NUM = " AND ".join(f"{c} IS NOT NULL" for c in NUMERIC_COLUMNS)


@register("cleaning_summary")
def q_cleaning_summary(spark, sf):
    return C.cleaning_summary(trips(spark, sf))


ORACLES["cleaning_summary"] = O.with_ctes("clean") + f"""
SELECT CAST(count(*) AS BIGINT) AS raw_rows,
  CAST(count_if({_CRIT}) AS BIGINT) AS after_dropna,
  CAST(count_if({_CRIT} AND {_NUM}) AS BIGINT) AS after_numeric_coercion,
  CAST((SELECT count(*) FROM clean) AS BIGINT) AS clean_rows,
  CAST(count(*) - (SELECT count(*) FROM clean) AS BIGINT) AS removed_rows
FROM trips"""


# fixed values of the planted text faults: a missing distance, a bad fare, a NaN tip
_NO_DISTANCE, _BAD_FARE, _NAN_TIP = "trip_distance > 9", "(passenger_count = 3 AND VendorID = 2)", "passenger_count = 5"


@register("cleaning_summary_csv", O.with_ctes("clean") + f"""
SELECT CAST(count(*) AS BIGINT) AS raw_rows,
  CAST(count_if({_CRIT} AND NOT {_NO_DISTANCE}) AS BIGINT) AS after_dropna,
  CAST(count_if({_CRIT} AND {_NUM} AND NOT ({_NO_DISTANCE} OR {_BAD_FARE} OR {_NAN_TIP})) AS BIGINT) AS after_numeric_coercion,
  CAST((SELECT count(*) FROM clean WHERE NOT ({_NO_DISTANCE} OR {_BAD_FARE} OR {_NAN_TIP})) AS BIGINT) AS clean_rows,
  CAST(count(*) - (SELECT count(*) FROM clean WHERE NOT ({_NO_DISTANCE} OR {_BAD_FARE} OR {_NAN_TIP})) AS BIGINT) AS removed_rows
FROM trips""")
def q_cleaning_summary_csv(spark, sf):
    """The trips written as CSV text with planted faults, read back by header and typed.

    One vendor writes its times month first, with twelve hours.
    """
    raw = trips(spark, sf)
    text = {"trip_distance": F.when(F.expr(_NO_DISTANCE), "NA"), "fare_amount": F.when(F.expr(_BAD_FARE), "abc"),
            "tip_amount": F.when(F.expr(_NAN_TIP), "NaN"),
            **{c: F.when(F.col("VendorID") == 1, F.date_format(c, "MM/dd/yyyy hh:mm:ss a")) for c in TIMESTAMP_COLUMNS}}
    path = shared_dir(spark, "zonecast-csv", uuid.uuid4().hex)
    write_table(raw.select(*[F.coalesce(text.get(c, F.lit(None)), F.col(c).cast("string")).alias(c) for c in RAW_COLUMNS]), path, fmt="csv")
    return C.cleaning_summary(parse_raw_trips(read_raw_trips_csv(spark, path)))


@register("clean_trips", O.with_ctes("clean") + f"""
SELECT CAST(VendorID AS DOUBLE) AS VendorID, {sql_ts('tpep_pickup_datetime')}, {sql_ts('tpep_dropoff_datetime')},
  passenger_count, trip_distance, pickup_longitude, pickup_latitude, dropoff_longitude, dropoff_latitude,
  payment_type, fare_amount, extra, mta_tax, tip_amount, tolls_amount, improvement_surcharge, total_amount,
  flag_clean AS store_and_fwd_flag, trip_duration_min, speed_kph,
  CASE WHEN trip_distance <> 0 THEN fare_amount / trip_distance END AS fare_per_mile,
  CASE WHEN trip_distance <> 0 THEN total_amount / trip_distance END AS total_per_mile,
  {sql_date('pickup_date')}, hour, CAST(day(pickup_date) AS INTEGER) AS day, {O.calendar_sql()},
  pickup_lat_bin, pickup_lon_bin,
  round_even(dropoff_latitude * {O.d(100.0)}, 0) / {O.d(100.0)} AS dropoff_lat_bin,
  round_even(dropoff_longitude * {O.d(100.0)}, 0) / {O.d(100.0)} AS dropoff_lon_bin,
  CAST(pickup_lat_bin AS VARCHAR) || '_' || CAST(pickup_lon_bin AS VARCHAR) AS pickup_zone,
  CAST(round_even(dropoff_latitude * {O.d(100.0)}, 0) / {O.d(100.0)} AS VARCHAR) || '_' ||
    CAST(round_even(dropoff_longitude * {O.d(100.0)}, 0) / {O.d(100.0)} AS VARCHAR) AS dropoff_zone
FROM clean""")
def q_clean_trips(spark, sf):
    return present(clean(spark, sf))


# --------------------------------------------------------------------------
# D1-D3 panel, E lags, F splits
# --------------------------------------------------------------------------
_PANEL_SQL_COLS = ", ".join(sql_date(c) if c == "pickup_date" else c for c in PANEL_COLUMNS)


@register("demand_panel", O.with_ctes("panel") + f"SELECT {_PANEL_SQL_COLS} FROM panel")
def q_demand_panel(spark, sf):
    return present(panel(spark, sf))


@register("top_zones", O.with_ctes("panel") + """
SELECT pickup_zone, CAST(sum(demand) AS BIGINT) AS demand FROM panel
GROUP BY pickup_zone ORDER BY demand DESC, pickup_zone LIMIT 15""")
def q_top_zones(spark, sf):
    from zonecast.operators.eda import top_zones
    return top_zones(panel(spark, sf), 15)


_MF_COLS = PANEL_COLUMNS + ["date_ordinal", "lag_1", "lag_2", "lag_24", "rolling_mean_3", "rolling_mean_24",
                            "rolling_std_24", "expanding_mean_zone"]


@register("model_frame", O.with_ctes("mf") + "SELECT " + ", ".join(
    sql_date(c) if c == "pickup_date" else c for c in _MF_COLS) + " FROM mf")
def q_model_frame(spark, sf):
    return present(model_rows(spark, sf).select(*_MF_COLS))


@register("lag_features_all_rows", O.with_ctes("prepared") + """
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, demand, date_ordinal,
  lag_1, lag_2, lag_24, rolling_mean_3, rolling_mean_24, rolling_std_24, expanding_mean_zone
FROM prepared""")
def q_lag_features_all_rows(spark, sf):
    p = L.prepare_model_data(panel(spark, sf))
    return present(p.select("pickup_zone", "pickup_date", "hour", "demand", "date_ordinal", *ALL_FEATURES[-7:]))


@register("distinct_dates", O.with_ctes("panel") + """
SELECT strftime(pickup_date, '%Y-%m-%d') AS pickup_date FROM (SELECT DISTINCT pickup_date FROM panel)""")
def q_distinct_dates(spark, sf):
    return present(panel(spark, sf).select("pickup_date").distinct())


@register("time_split", O.with_ctes("split") + """
SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT pickup_date) AS BIGINT) AS dates,
  strftime(min(pickup_date), '%Y-%m-%d') AS first_date, strftime(max(pickup_date), '%Y-%m-%d') AS last_date
FROM split GROUP BY split""")
def q_time_split(spark, sf):
    return present(split_rows(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("pickup_date").alias("dates"),
        F.min("pickup_date").alias("first_date"), F.max("pickup_date").alias("last_date")))


@register("walk_forward_folds", O.with_ctes("split", "folds") + """
SELECT CAST(f.fold AS INTEGER) AS fold, f.role, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(DISTINCT s.pickup_date) AS BIGINT) AS dates,
  strftime(min(s.pickup_date), '%Y-%m-%d') AS first_date, strftime(max(s.pickup_date), '%Y-%m-%d') AS last_date
FROM split s JOIN folds f USING (pickup_date)
WHERE s.split = 'train' AND f.role IS NOT NULL
GROUP BY 1, 2""")
def q_walk_forward_folds(spark, sf):
    train = split_rows(spark, sf).where(F.col("split") == "train").drop("split")
    return present(S.fold_summary(train))


_SAMPLE_KEY = "md5(concat_ws('#', '42', pickup_zone, strftime(pickup_date, '%Y-%m-%d'), CAST(hour AS VARCHAR)))"


@register("seeded_sample", O.with_ctes("split") + f"""
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, demand FROM split
WHERE split = 'test' ORDER BY {_SAMPLE_KEY}, pickup_zone, pickup_date, hour LIMIT 100""")
def q_seeded_sample(spark, sf):
    test = split_rows(spark, sf).where(F.col("split") == "test")
    return present(S.seeded_sample(test, 100, seed=42).select("pickup_zone", "pickup_date", "hour", "demand"))


@register("representative_row", O.with_ctes("split") + """
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, demand FROM split
WHERE split = 'test'
ORDER BY abs(CAST(demand AS DOUBLE) - (SELECT median(CAST(demand AS DOUBLE)) FROM split WHERE split = 'test')),
  pickup_zone, pickup_date, hour LIMIT 1""")
def q_representative_row(spark, sf):
    test = split_rows(spark, sf).where(F.col("split") == "test")
    return present(S.representative_row(test).select("pickup_zone", "pickup_date", "hour", "demand"))


# --------------------------------------------------------------------------
# A9 narrow sink schema, F5 membership filter, G11 target transform
# --------------------------------------------------------------------------
def _downcast_sql(c: str) -> str:
    if c == "pickup_date":
        return sql_date(c)
    if c in PANEL_FLOAT_COLUMNS:
        return f"CAST({c} AS FLOAT) AS {c}"
    if c in PANEL_TINYINT_COLUMNS:
        return f"CAST({c} AS TINYINT) AS {c}"
    return c


@register("panel_downcast", O.with_ctes("panel") + "SELECT " + ", ".join(_downcast_sql(c) for c in PANEL_COLUMNS)
          + " FROM panel")
def q_panel_downcast(spark, sf):
    """The panel as its narrow sink schema writes it (A9): float and tinyint columns."""
    from zonecast.sources.sinks import downcast

    return present(downcast(panel(spark, sf), PANEL_FLOAT_COLUMNS, PANEL_TINYINT_COLUMNS))


@register("validation_rows", O.with_ctes("split") + """
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, demand
FROM mf WHERE pickup_date IN (SELECT pickup_date FROM split WHERE split = 'val')""")
def q_validation_rows(spark, sf):
    """Model-frame rows whose date is a validation date: a left-semi join on the date table."""
    mf = model_rows(spark, sf)
    val_dates = S.split_labels(mf).where(F.col("split") == "val")
    return present(S.in_dates(mf, val_dates).select("pickup_zone", "pickup_date", "hour", "demand"))


@register("log_target_transform", O.with_ctes("split")[:-1] + """,
st AS (
  SELECT avg(ln(1 + greatest(CAST(demand AS DOUBLE), 0))) AS log_mean,
         CASE WHEN stddev_pop(ln(1 + greatest(CAST(demand AS DOUBLE), 0))) > 0
              THEN stddev_pop(ln(1 + greatest(CAST(demand AS DOUBLE), 0))) ELSE 1.0 END AS log_std
  FROM split WHERE split = 'train'),
t AS (
  SELECT s.pickup_zone, s.pickup_date, s.hour, s.split, CAST(s.demand AS DOUBLE) AS demand,
         (ln(1 + greatest(CAST(s.demand AS DOUBLE), 0)) - st.log_mean) / st.log_std AS target_t,
         st.log_mean, st.log_std
  FROM split s CROSS JOIN st)
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, split, demand, target_t,
       greatest(exp(target_t * log_std + log_mean) - 1, 0) AS demand_back
FROM t""")
def q_log_target_transform(spark, sf):
    """Target transform with train-fitted stats and its inverse on every split row."""
    from zonecast.operators import models as ML

    sp = split_rows(spark, sf)
    stats = ML.log_target_stats(sp.where(F.col("split") == "train"))
    t = ML.to_log_standardised(sp.withColumn("demand", F.col("demand").cast("double")), stats)
    back = ML.from_log_standardised(t, stats, "target_t", "demand_back")
    return present(back.select("pickup_zone", "pickup_date", "hour", "split", "demand", "target_t", "demand_back"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)


def _load_all() -> None:
    # importing registers the remaining query groups
    from zonecast.plans import catalog_eval, catalog_pricing, catalog_eda, catalog_models  # noqa: F401
