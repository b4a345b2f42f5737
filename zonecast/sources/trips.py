"""Raw trip sources.

The raw trip frame ("F1") has doubles for the numeric columns,
TIMESTAMP_NTZ pickup/dropoff, a string flag, and ``_critical_present``: true
when every critical column was present in the source text, before numeric
coercion. Cleaning uses it for the ``after_dropna`` counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from zonecast.config import CRITICAL_COLUMNS, NUMERIC_COLUMNS, RAW_COLUMNS

# fixed values: texts that stand for a missing value in a CSV field
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# columns that cleaning bounds from both sides
BOUNDED_COLUMNS = ["trip_distance", "fare_amount", "total_amount", "passenger_count", "pickup_latitude", "pickup_longitude",
                   "dropoff_latitude", "dropoff_longitude"]
TIMESTAMP_COLUMNS = ["tpep_pickup_datetime", "tpep_dropoff_datetime"]
# fixed values: month names by their first three letters
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_CLOCK = r"(?:(?:[ T]+|, *)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?(?: *([AaPp])\.?[Mm]\.?)?)?\s*$"

# All raw CSV columns are read as text; typing happens once, in parse_raw_trips.
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])


def read_raw_trips_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan selecting the raw columns by header name, all as text (A1).

    No schema inference (no extra pass over the files); files may carry more
    columns, in any order; only the listed ones are parsed.
    """
    return (spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
            .csv(path).select(*[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS]))


def _number(c: str) -> Column:
    """A column as double; what is no number, and NaN, is NULL."""
    x = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return F.when(~F.isnan(x), x)


def timestamp(text: Column, day_first: bool = False) -> Column:
    """A text as TIMESTAMP_NTZ; NULL where it is no time (A2).

    ISO text, and else year-month-day parted by ``/``, ``.`` or nothing; numbers month/day/year (day/month/year with
    ``day_first``, or where the first number can be no month); and days with an English month name, in either order.
    The time of day may be missing, without seconds, or of twelve hours with AM or PM.
    """
    text = F.trim(text)

    def parts(pattern: str, year: int, month: int, day: int) -> tuple[Column, list[Column]]:
        whole = "^" + pattern + _CLOCK
        return F.rlike(text, F.lit(whole)), [F.regexp_extract(text, whole, k) for k in (year, month, day, 4, 5, 6, 7)]

    def clock(hour: Column, minute: Column, second: Column, half: Column) -> Column:
        h = F.when(hour == "", F.lit(0)).otherwise(hour.try_cast("int"))
        twelve = F.when(h.between(1, 12), h % 12 + F.when(F.lower(half) == "p", 12).otherwise(0))
        h = F.when(half == "", h).otherwise(twelve)
        return F.concat(h.cast("string"), F.lit(":"), F.when(minute == "", "00").otherwise(minute), F.lit(":"), F.when(second == "", "00").otherwise(second))

    def iso(year: Column, month: Column, day: Column, *time: Column) -> Column:
        return F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock(*time)).try_cast("timestamp_ntz")

    def named(month: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(month, 1, 3)))
        return F.when(at > 0, at.cast("string"))

    said = F.when(F.lit(False), F.lit(None).cast("timestamp_ntz"))
    for pattern in (r"(\d{4})[/.](\d{1,2})[/.](\d{1,2})", r"(\d{4})(\d{2})(\d{2})"):
        fits, p = parts(pattern, 1, 2, 3)
        said = said.when(fits, iso(*p))
    fits, (year, first, second, *time) = parts(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", 3, 1, 2)
    by_month, by_day = iso(year, first, second, *time), iso(year, second, first, *time)
    said = said.when(fits, F.coalesce(by_day, by_month) if day_first else F.coalesce(by_month, by_day))
    for pattern, month, day in ((r"(\d{1,2})[ -]+([A-Za-z]{3,9})\.?[ ,-]+(\d{4})", 2, 1), (r"([A-Za-z]{3,9})\.?[ -]+(\d{1,2})[ ,-]+(\d{4})", 1, 2)):
        fits, (year, name, number, *time) = parts(pattern, 3, month, day)
        said = said.when(fits, iso(year, named(name), number, *time))
    return F.coalesce(text.try_cast("timestamp_ntz"), said)


def parse_raw_trips(text: DataFrame) -> DataFrame:
    """Type a raw text frame: missing-value texts, bad timestamps and bad numbers become NULL."""
    text = text.select(*[F.when(~F.col(c).isin(MISSING_TEXTS), F.col(c)).alias(c) for c in RAW_COLUMNS])
    ts = {c: timestamp(F.col(c)) for c in TIMESTAMP_COLUMNS}
    present = F.lit(True)
    for c in CRITICAL_COLUMNS:
        present = present & (ts[c].isNotNull() if c in ts else F.col(c).isNotNull())
    cols = []
    for c in RAW_COLUMNS:
        if c in ts:
            cols.append(ts[c].alias(c))
        elif c in NUMERIC_COLUMNS:
            cols.append(_number(c).alias(c))
        else:
            cols.append(F.col(c))
    return text.select(*cols, present.alias("_critical_present"))


def typed_raw_trips(df: DataFrame) -> DataFrame:
    """Bring an already typed trip frame (e.g. Parquet) to the raw trip schema."""
    cols = []
    for c in RAW_COLUMNS:
        if c in TIMESTAMP_COLUMNS:
            is_text = isinstance(df.schema[c].dataType, T.StringType)
            cols.append((timestamp(F.col(c)) if is_text else F.col(c).try_cast("timestamp_ntz")).alias(c))
        elif c in BOUNDED_COLUMNS and isinstance(df.schema[c].dataType, T.DoubleType):
            cols.append(F.col(c))  # as it is, so that cleaning's bounds reach the scan; NaN is outside every bound
        elif c in NUMERIC_COLUMNS:
            cols.append(_number(c).alias(c))
        else:
            cols.append(F.col(c).cast("string").alias(c))
    present = F.lit(True)
    for c in CRITICAL_COLUMNS:
        there = F.col(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            there = there & ~F.isnan(c)
        present = present & there
    return df.select(*cols, present.alias("_critical_present"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (A3)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# events -> raw trips adapter
# --------------------------------------------------------------------------
# fixed values: payment type per event type
PAYMENT_BY_EVENT = {"view": 1, "click": 2, "signup": 3, "purchase": 4, "error": 5}


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def events_as_trips(events: DataFrame, wide_zones: bool = False) -> DataFrame:
    """Derive raw trips from the ``events`` table with integer arithmetic.

    Dirty rows are planted on purpose: every 89th event ends before it starts,
    every 97th sits at (0, 0), passenger count 0 for every 7th, and flags come
    in mixed case with spaces or NULL. The DuckDB oracle uses the same rules.

    ``wide_zones`` spreads pickups over one zone per user (150 users -> 150
    zones: 15 latitude x 10 longitude bins) so the panel keeps growing with
    the data; it is used for benchmarking, not by the oracle-checked queries.
    """
    eid, uid, value = F.col("event_id"), F.col("user_id"), F.col("value")
    lat_steps, lon_steps = (uid % 15, (uid / 15).cast("long") % 10) if wide_zones else (uid % 3, uid % 4)
    et = F.col("event_type")
    ts = F.col("ts").cast("timestamp_ntz")
    dropoff = F.when(eid % 89 == 0, ts - _minutes(F.lit(5))).otherwise(ts + _minutes(F.lit(2) + eid % 40))
    on_origin = eid % 97 == 0
    payment = F.lit(None).cast("double")
    for k, v in PAYMENT_BY_EVENT.items():
        payment = F.when(et == k, F.lit(float(v))).otherwise(payment)
    flag = F.when(et == "error", F.lit(None).cast("string")).when(et == "click", F.lit(" y ")).otherwise(F.lit("n"))
    trips = events.select(
        (F.lit(1) + uid % 2).cast("double").alias("VendorID"),
        ts.alias("tpep_pickup_datetime"),
        dropoff.alias("tpep_dropoff_datetime"),
        (eid % 7).cast("double").alias("passenger_count"),
        (F.lit(0.5) + (eid % 23).cast("double") * F.lit(0.4)).alias("trip_distance"),
        F.when(on_origin, F.lit(0.0)).otherwise(F.lit(-73.99) + lon_steps.cast("double") * F.lit(0.01)).alias("pickup_longitude"),
        F.when(on_origin, F.lit(0.0)).otherwise(F.lit(40.75) + lat_steps.cast("double") * F.lit(0.01)).alias("pickup_latitude"),
        F.lit(-73.95).alias("dropoff_longitude"),
        F.lit(40.72).alias("dropoff_latitude"),
        payment.alias("payment_type"),
        (F.lit(3.0) + value * F.lit(0.2)).alias("fare_amount"),
        F.lit(0.5).alias("extra"),
        F.lit(0.5).alias("mta_tax"),
        (value * F.lit(0.02)).alias("tip_amount"),
        F.lit(0.0).alias("tolls_amount"),
        F.lit(0.3).alias("improvement_surcharge"),
        (F.lit(4.3) + value * F.lit(0.22)).alias("total_amount"),
        flag.alias("store_and_fwd_flag"),
    )
    return typed_raw_trips(trips)


def raw_trips(spark: SparkSession, sf_dir: str, wide_zones: bool = False) -> DataFrame:
    """Raw trips of a driver data directory, via the events adapter."""
    return events_as_trips(table(spark, sf_dir, "events"), wide_zones)


def read_optional(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame | None:
    """Read ``path``; a missing path gives None, any other error propagates."""
    try:
        return spark.read.format(fmt).options(**options).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or "") or "Path does not exist" in str(e):
            return None
        raise
