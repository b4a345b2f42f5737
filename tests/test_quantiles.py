"""Distributed exact quantiles against numpy, with one hot group."""

import numpy as np
import pandas as pd

from zonecast.operators.quantiles import exact_quantiles, quantile_columns, rollup_quantile_columns


def test_matches_numpy_with_hot_group(spark):
    rng = np.random.default_rng(11)
    g = np.concatenate([np.zeros(6000, int), rng.integers(1, 6, 3000), [9]])
    v = np.round(rng.normal(0, 10, len(g)), 3)
    v[:500] = 1.5  # heavy ties in the hot group
    pdf = pd.DataFrame({"g": g, "v": v})
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]
    got = exact_quantiles(df, ["g"], "v", probs, num_partitions=13).toPandas()
    for (gg, q), val in got.set_index(["g", "q"])["value"].items():
        assert np.isclose(val, np.quantile(pdf.loc[pdf.g == gg, "v"], q)), (gg, q)
    assert len(got) == pdf.g.nunique() * len(probs)


def test_global_and_wide(spark):
    rng = np.random.default_rng(12)
    x = rng.exponential(3, 2001)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "k": "a"}))
    w = quantile_columns(df, [], "x", {"p50": 0.5, "p95": 0.95}).first()
    assert np.isclose(w["p50"], np.median(x)) and np.isclose(w["p95"], np.percentile(x, 95))
    w2 = quantile_columns(df.where("x < 0"), ["k"], "x", {"p50": 0.5})
    assert w2.count() == 0


def test_no_exchange_holds_a_whole_group(spark):
    df = spark.range(1000).selectExpr("0 AS g", "CAST(id AS DOUBLE) AS v")
    out = exact_quantiles(df, ["g"], "v", [0.5], num_partitions=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the hot group's rows are range-partitioned (checkpointed); no percentile map is used
    assert "percentile" not in plan.lower()
    assert out.first()["value"] == 499.5


def test_releases_persisted_intermediate(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(500).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v")
    out = quantile_columns(df, ["g"], "v", {"p50": 0.5})
    assert out.count() == 3
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_rollup_counts_values_once_for_groups_and_total(spark):
    rng = np.random.default_rng(13)
    h = np.concatenate([np.zeros(4000, int), rng.integers(1, 5, 1500)])  # a hot group
    pdf = pd.DataFrame({"h": h, "x": np.round(rng.normal(0, 5, len(h)), 1), "y": rng.integers(0, 3, len(h)).astype(float)})
    pdf.loc[::7, "x"] = None
    df = spark.createDataFrame(pdf).repartition(6)
    df = df.unionByName(spark.createDataFrame([(None, 1000.0, 1.0)], df.schema))  # no group: in the total only
    got = rollup_quantile_columns(df, "h", {"mx": ("x", 0.5), "px": ("x", 0.9), "my": ("y", 0.5)}, num_partitions=9).toPandas()
    assert len(got) == 6 and dict(df.dtypes)["h"] == str(rollup_quantile_columns(df, "h", {"m": ("x", 0.5)}).dtypes[0][1])
    for _, r in got[got._total == 0].iterrows():
        sub = pdf[pdf.h == r.h]
        assert np.allclose([r.mx, r.px, r.my], [sub.x.median(), sub.x.quantile(0.9), sub.y.median()])
    total = got[got._total == 1].iloc[0]
    x = pd.concat([pdf.x, pd.Series([1000.0])])
    assert pd.isna(total.h) and np.allclose([total.mx, total.px], [x.median(), x.quantile(0.9)])
