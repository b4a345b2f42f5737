"""Missing and NaN values: typing, reference price, lags, correlation."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from zonecast.config import RAW_COLUMNS
from zonecast.functions.pricing import reference_price
from zonecast.operators.clean import clean_trips, cleaning_summary
from zonecast.operators.eda import correlation_long
from zonecast.operators.lags import prepare_model_data
from zonecast.sources.trips import parse_raw_trips, timestamp, typed_raw_trips

GOOD = {
    "VendorID": "1", "tpep_pickup_datetime": "2024-01-02 10:00:00", "tpep_dropoff_datetime": "2024-01-02 10:20:00", "passenger_count": "1",
    "trip_distance": "3.0", "pickup_longitude": "-73.98", "pickup_latitude": "40.75", "dropoff_longitude": "-73.95", "dropoff_latitude": "40.72",
    "payment_type": "1", "fare_amount": "12", "extra": "0.5", "mta_tax": "0.5", "tip_amount": "1", "tolls_amount": "0", "improvement_surcharge": "0.3",
    "total_amount": "15", "store_and_fwd_flag": "N",
}


def text_frame(spark, *changes):
    rows = [tuple({**GOOD, **c}[k] for k in RAW_COLUMNS) for c in changes]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in RAW_COLUMNS))


def test_missing_texts_and_bad_numbers(spark):
    df = text_frame(spark, {}, {"trip_distance": "NA"}, {"fare_amount": "NaN"}, {"fare_amount": "abc"}, {"store_and_fwd_flag": "null"}, {"tpep_pickup_datetime": "soon"})
    raw = parse_raw_trips(df)
    r = cleaning_summary(raw).first()
    assert (r.raw_rows, r.after_dropna, r.after_numeric_coercion, r.clean_rows) == (6, 3, 2, 2)
    assert raw.where("store_and_fwd_flag IS NULL").count() == 1 and raw.where(F.isnan("fare_amount")).count() == 0


def test_typed_input_with_nan_and_bad_text(spark):
    df = text_frame(spark, {}, {"fare_amount": "oops"}).withColumn("tip_amount", F.when(F.col("fare_amount") == "12", F.lit(float("nan"))).otherwise(1.0))
    raw = typed_raw_trips(df)
    assert raw.where("tip_amount IS NULL").count() == 1 and raw.where("fare_amount IS NULL").count() == 1
    assert cleaning_summary(raw).first().clean_rows == 0


def test_nan_reference_price(spark):
    df = spark.createDataFrame([(float("nan"), 12.0)], "avg_fare_amount double, avg_total_amount double")
    assert df.select(reference_price(df.columns).alias("p")).first().p == 12.0


def test_a_missing_target_keeps_its_place(spark):
    df = spark.createDataFrame([("z", f"2024-01-0{i + 1}", 5, d) for i, d in enumerate([5, None, 7, 9])], "pickup_zone string, pickup_date string, hour int, demand long")
    got = [(r.demand, r.lag_1) for r in prepare_model_data(df.withColumn("pickup_date", F.to_date("pickup_date"))).orderBy("pickup_date").collect()]
    assert got == [(5, None), (7, None), (9, 7)]


def test_correlation_deletes_pairwise(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame(rng.normal(size=(60, 4)) + 1e6, columns=list("abcd"))
    x["b"] += x["a"]
    x["d"] = 3.0
    x[rng.random(x.shape) < 0.3] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(x.to_numpy())], "a double, b double, c double, d double").repartition(3)
    want = x.corr()
    for r in correlation_long(df).collect():
        w = want.loc[r.col_a, r.col_b]
        assert (r.r is None and (np.isnan(w) or "d" in (r.col_a, r.col_b))) or abs(r.r - w) < 1e-6


def test_bounds_reach_a_typed_parquet_scan(spark, tmp_path):
    text = text_frame(spark, {}, {"trip_distance": "900"})
    numbers = [c for c in RAW_COLUMNS if c not in ("tpep_pickup_datetime", "tpep_dropoff_datetime", "store_and_fwd_flag")]
    typed = text.withColumns({c: F.col(c).cast("double") for c in numbers}).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")})
    typed.write.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    try:
        spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
        clean = clean_trips(typed_raw_trips(spark.read.parquet(str(tmp_path / "t"))))
        plan = clean._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(trip_distance" in pushed and "LessThanOrEqual(trip_distance" in pushed
    assert "GreaterThanOrEqual(pickup_latitude" in pushed and clean.count() == 1


def test_timestamps_that_are_not_iso(spark):
    texts = ["2024-01-02 10:00:00", "01/02/2024 10:20:30 PM", "1/2/2024 12:05 am", "2024/01/02 23:59", "20240102", "20240102 10:11:12", "25/12/2024 01:02:03",
             "02-Jan-2024 10:00", "January 2, 2024 4:05:06.5 PM", "Jan 2 2024", " 1/2/2024 ", "2024.1.2 7:08:09.123456", "2 Sept 2024, 13:00", "2024-01-02T10:00:00"]
    bad = ["soon", "13/13/2024", "02/30/2024", "1/2/2024 25:00", "1/2/2024 13:00 PM", "1/2/2024 0:30 AM", "Foo 2 2024", "1/2/24x", "", None, "20241301", "12:30"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + bad)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(timestamp(F.col("t"))).collect()]
    assert got[: len(texts)] == [pd.to_datetime(t).to_pydatetime() for t in texts]
    assert got[len(texts):] == [None] * len(bad)
    assert df.where("i = 1").select(timestamp(F.col("t"), day_first=True)).first()[0] == pd.Timestamp("2024-02-01 22:20:30")
