"""Metrics, calibration and EDA aggregates against numpy / pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from zonecast.operators import eda as EDA
from zonecast.operators import metrics as M


def preds(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 60, n).astype(float)
    p = np.round(y + rng.normal(0, 5, n), 1)
    p[:40] = 10.0  # ties for quantile edges
    hours = rng.integers(0, 24, n)
    pdf = pd.DataFrame({"pickup_date": pd.to_datetime("2024-01-01").date(), "hour": hours.astype("int32"),
                        "day_of_week": 0, "month": 1, "is_weekend": 0,
                        "is_peak_hour": np.isin(hours, [7, 8, 9, 16, 17, 18, 19]).astype("int32"),
                        "pickup_zone": np.where(hours % 2 == 0, "z0", "z1"), "demand": y, "predicted_demand": p})
    return spark.createDataFrame(pdf), y, p


def test_regression_metrics(spark):
    df, y, p = preds(spark)
    r = M.regression_metrics(df.withColumnRenamed("demand", "actual_demand")).first().asDict()
    e = p - y
    assert np.isclose(r["mae"], np.mean(np.abs(e)))
    assert np.isclose(r["rmse"], np.sqrt(np.mean(e ** 2)))
    assert np.isclose(r["r2"], 1 - np.sum(e ** 2) / np.sum((y - y.mean()) ** 2))
    assert np.isclose(r["median_ae"], np.median(np.abs(e)))
    assert np.isclose(r["mape"], np.mean(np.abs((y - p) / np.clip(np.abs(y), 1e-8, None))) * 100)
    assert np.isclose(r["smape"], np.mean(2 * np.abs(p - y) / np.clip(np.abs(y) + np.abs(p), 1e-8, None)) * 100)
    assert np.isclose(r["bias"], np.mean(e))


def test_prediction_frame_signs(spark):
    df, y, p = preds(spark)
    pf = M.prediction_frame(df).toPandas()
    assert np.allclose(pf["error"], y - p)
    zero = pf[pf["actual_demand"] == 0]
    assert zero["pct_error"].isna().all()
    assert ((pf["over_prediction"] == 1) == (pf["predicted_demand"] > pf["actual_demand"])).all()


def test_error_summary_and_residuals(spark):
    df, y, p = preds(spark)
    pf = M.prediction_frame(df)
    got = {r["is_peak_hour"]: r for r in M.error_summary(pf, "is_peak_hour").collect()}
    pdf = pf.toPandas()
    for k, g in pdf.groupby("is_peak_hour"):
        r = got[k]
        assert r["count"] == len(g)
        assert np.isclose(r["median_abs_error"], np.median(g["abs_error"]))
        assert np.isclose(r["p95_abs_error"], np.percentile(g["abs_error"], 95))
        assert np.isclose(r["rmse"], np.sqrt(np.mean(g["sq_error"])))
    rs = M.residual_summary(pf).first()
    assert np.isclose(rs["std_error"], np.std(pdf["error"]))  # population std
    assert np.isclose(rs["p90_abs_error"], np.percentile(pdf["abs_error"], 90))


def test_calibration_matches_qcut(spark):
    df, y, p = preds(spark)
    pf = M.prediction_frame(df)
    got = M.calibration(pf).orderBy("bin").toPandas()
    t = pd.DataFrame({"a": y, "p": p})
    t["bin"] = pd.qcut(t["p"], q=10, duplicates="drop")
    want = t.groupby("bin", observed=False).agg(mp=("p", "mean"), ma=("a", "mean"), n=("a", "size")).reset_index()
    assert len(got) == len(want)
    assert got["count"].tolist() == want["n"].tolist()
    assert np.allclose(got["mean_predicted"], want["mp"]) and np.allclose(got["mean_actual"], want["ma"])


def test_cv_summary_sample_std(spark):
    rows = [(f, m, float(f * 2 + i), float(f + i), 1.0, 2.0, 3.0, 4.0, 0.5, 0.1, 0.2, 0.3, 0.4, 0.5)
            for f in (1, 2, 3) for i, m in enumerate(("a", "b"))]
    cols = ("fold model_name train_mae val_mae train_rmse train_r2 val_rmse val_r2 mae_gap rmse_gap bias "
            "median_ae mape smape").split()
    cv = spark.createDataFrame(rows, cols)
    got = {r["model_name"]: r for r in M.cv_summary(cv).collect()}
    assert np.isclose(got["a"]["cv_train_mae_std"], np.std([2, 4, 6], ddof=1))
    assert np.isclose(got["b"]["cv_val_mae_mean"], np.mean([2, 3, 4]))


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(1, 2766, 3000), [1, 2765, 1382]]).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"demand": x}))
    got = EDA.histogram(df, "demand", 50).orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins=50)
    assert got["count"].tolist() == counts.tolist()
    assert np.allclose(got["bin_lo"], edges[:-1])


def test_histogram_edges_and_continuous_values(spark):
    """Values on every edge, continuous values and a constant column bin like numpy."""
    rng = np.random.default_rng(7)
    lo, hi = -3.7, 11.9
    edges = np.linspace(lo, hi, 51)
    x = np.concatenate([rng.uniform(lo, hi, 4000), edges, np.nextafter(edges, -np.inf)[1:],
                        np.nextafter(edges, np.inf)[:-1]])
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    got = EDA.histogram(df, "v", 50).orderBy("bin").toPandas()
    counts, _ = np.histogram(x, bins=50)
    assert got["count"].tolist() == counts.tolist()
    const = spark.createDataFrame(pd.DataFrame({"v": [2.5] * 7}))
    c = EDA.histogram(const, "v", 50).orderBy("bin").toPandas()
    assert c["count"].sum() == 7 and c["count"].iloc[-1] == 7


def test_describe_and_kde(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(1, 100, 500).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"demand": x}))
    d = EDA.describe(df).first()
    s = pd.Series(x).describe()
    assert np.isclose(d["std"], s["std"]) and np.isclose(d["p25"], s["25%"]) and np.isclose(d["p75"], s["75%"])
    k = EDA.kde_curve(df, "demand", 200).orderBy("g").toPandas()
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert np.allclose(k["density"], dens) and np.allclose(k["x"], grid)


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300), "c": 7.0})
    pdf["d"] = pdf["a"] * 3 + rng.normal(size=300)
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in EDA.correlation_long(df, ["a", "b", "c", "d"]).collect()}
    want = pdf.corr()
    for a in "abd":
        for b in "abd":
            assert np.isclose(got[(a, b)], want.loc[a, b])
    assert got[("a", "c")] is None and got[("c", "c")] is None


def test_mean_by_keys_grouping_sets(spark):
    df, y, p = preds(spark)
    df = df.withColumns({"is_month_start": F.lit(0), "is_month_end": F.lit(1), "is_high_travel_period": F.lit(0)})
    got = EDA.mean_by_keys(df).where("dimension = 'hour'").toPandas().set_index("key_value")["mean_demand"]
    want = df.toPandas().groupby("hour")["demand"].mean()
    assert np.allclose(got.sort_index().to_numpy(), want.sort_index().to_numpy())


def test_kde_resolution_close_to_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(50, 10, 2000)
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    exact = EDA.kde_curve(df, "v").orderBy("g").toPandas()["density"].to_numpy()
    snapped = EDA.kde_curve(df, "v", resolution=0.05).orderBy("g").toPandas()["density"].to_numpy()
    assert np.max(np.abs(exact - snapped)) < 1e-3 * np.max(exact) + 1e-6
    d = EDA.describe(df, "v", quantiles="map").first()
    d2 = EDA.describe(df, "v").first()
    assert np.isclose(d["p75"], d2["p75"]) and np.isclose(d2["p50"], np.median(x))
