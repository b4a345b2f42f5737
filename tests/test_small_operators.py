"""Small operators: downcast (A9), drill-down filters (B9), date membership (F5), text helpers."""

import datetime as dt

import numpy as np

from pyspark.sql import functions as F

from zonecast.functions.text import normalise_flag, number_text, strip_suffix_title
from zonecast.operators.clean import select_zone_hour
from zonecast.operators.splits import in_dates
from zonecast.sources.sinks import downcast


def test_downcast_types(spark):
    df = spark.createDataFrame([(1.5, 3)], "a double, b int")
    out = downcast(df, ["a"], ["b"])
    assert dict(out.dtypes) == {"a": "float", "b": "tinyint"}


def test_zone_hour_filters(spark):
    df = spark.createDataFrame([("z1", 1), ("z1", 2), ("z2", 1)], "pickup_zone string, hour int")
    assert select_zone_hour(df, "z1").count() == 2
    assert select_zone_hour(df, "z1", 2).count() == 1
    assert select_zone_hour(df, hour=1).count() == 2


def test_in_dates_is_semi_join(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in (1, 2, 3, 3)], "pickup_date date, v int")
    dates = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 1, 3),), (dt.date(2024, 1, 9),)],
                                  "pickup_date date")
    out = in_dates(df, dates)
    assert sorted(r["v"] for r in out.collect()) == [3, 3]
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()


def test_text_helpers(spark):
    df = spark.createDataFrame([("train_mae", None, 1234567.125), ("val_mae", " y\t", 2.675)], "s string, f string, x double")
    r = df.select(strip_suffix_title(F.col("s"), "_mae").alias("a"), normalise_flag(F.col("f")).alias("b"),
                  number_text(F.col("x")).alias("c")).collect()
    assert [x["a"] for x in r] == ["Train", "Val"]
    assert [x["b"] for x in r] == ["N", "Y"]
    assert [x["c"] for x in r] == [f"{1234567.125:,.2f}", f"{2.675:,.2f}"]


def test_log_target_transform_round_trip(spark):
    from zonecast.operators import models as ML

    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (41.0,), (2765.0,)], "demand double")
    stats = ML.log_target_stats(df)
    st = stats.first()
    logs = np.log1p(np.array([0.0, 1.0, 5.0, 41.0, 2765.0]))
    assert abs(st["log_mean"] - logs.mean()) < 1e-12 and abs(st["log_std"] - logs.std()) < 1e-12
    t = ML.to_log_standardised(df, stats)
    back = ML.from_log_standardised(t, stats, "target_t", "demand_back").collect()
    for r in back:
        assert abs(r["demand_back"] - r["demand"]) < 1e-9 * max(1.0, r["demand"])
    # constant target: std 0 is replaced by 1
    const = spark.createDataFrame([(3.0,), (3.0,)], "demand double")
    assert ML.log_target_stats(const).first()["log_std"] == 1.0
