"""Fold fits from per-date moments equal fits on the fold's rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from zonecast.operators import gram as G
from zonecast.operators import metrics as M
from zonecast.operators import models as ML
from zonecast.operators import splits as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(900):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 23)))
        a, b = rng.normal(), 735_000 + float(rng.integers(0, 90))  # a large offset
        out.append((day, a, b, 1.0, 3 * a - 0.25 * b + rng.normal()))
    out += [(dt.date(2024, 1, 5), None, 735_000.0, 1.0, 1.0), (dt.date(2024, 1, 5), float("nan"), 735_000.0, 1.0, 1.0), (dt.date(2024, 1, 5), 1.0, 735_000.0, 1.0, None)]
    return spark.createDataFrame(out, "pickup_date date, a double, b double, same double, demand double").repartition(6)


def xy(df):
    t = np.array(df.select("a", "b", "demand").collect())
    return t[:, :2], t[:, 2]


def test_every_fold_equals_linear_regression(spark, rows):
    folds, fits = G.fold_fits(rows, {"two": (["a", "b"], 0.0)}, 4)
    clean = rows.dropna().where("NOT isnan(a)")
    tagged = S.fold_frame(clean, 4)
    assert [f for f, _, _ in folds] == [1, 2, 3, 4]
    for fold, _, _ in folds:
        train = tagged.where((F.col("fold") == fold) & (F.col("role") == "train"))
        x, y = xy(train)
        z = x - x.mean(axis=0)
        want = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
        own = fits[fold, "two"]
        assert np.allclose(own.coefficients, want, rtol=1e-8, atol=1e-8)
        model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LinearRegression(featuresCol="features", labelCol="demand", solver="normal")]).fit(train)
        spark_fit = model.stages[-1]
        assert np.allclose(own.coefficients, spark_fit.coefficients.toArray(), rtol=1e-6, atol=1e-8)


def test_small_offsets_equal_spark_to_1e_8_and_ridge_equals_the_closed_form(spark, rows):
    near = rows.withColumn("b", F.col("b") - 735_000).dropna().where("NOT isnan(a)")
    fits = G.fit_linear(near, {"plain": (["a", "b"], 0.0), "ridge": (["a", "b"], 5.0)})
    lr = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), LinearRegression(featuresCol="features", labelCol="demand", solver="normal")]).fit(near).stages[-1]
    assert np.allclose(fits["plain"].coefficients, lr.coefficients.toArray(), atol=1e-8, rtol=0) and abs(fits["plain"].intercept - lr.intercept) < 1e-7
    x, y = xy(near)
    z = x - x.mean(axis=0)
    want = np.linalg.solve(z.T @ z + 5.0 * np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(fits["ridge"].coefficients, want, atol=1e-9)


def test_constant_and_collinear_features(spark, rows):
    double = rows.withColumn("twice", F.col("a") * 2).dropna().where("NOT isnan(a)")
    fits = G.fit_linear(double, {"m": (["a", "same", "twice"], 0.0), "one": (["a"], 0.0)})
    assert fits["m"].coefficients[1] == 0.0
    p = G.predictions(double, fits, []).groupBy("model_name").agg(F.sum("predicted_demand").alias("s"), F.sum(F.col("predicted_demand") ** 2).alias("q")).collect()
    assert np.allclose([p[0].s, p[0].q], [p[1].s, p[1].q])


def test_cv_equals_fold_by_fold_fits(spark, rows):
    """Metrics of one-pass folds are those of fits on every fold's own rows."""
    clean = rows.withColumn("b", F.col("b") - 735_000).dropna().where("NOT isnan(a)")
    got = {r.fold: r for r in M.fold_metrics(G.fold_predictions(clean, {"m": (["a", "b"], 0.0)}, 3)).collect()}
    tagged = S.fold_frame(clean, 3)
    for fold in (1, 2, 3):
        parts = {}
        for role in ("train", "val"):
            part = tagged.where((F.col("fold") == fold) & (F.col("role") == role)).select("a", "b", "demand").collect()
            parts[role] = np.array(part)
        t = parts["train"]
        z = np.column_stack([np.ones(len(t)), t[:, :2]])
        b = np.linalg.lstsq(z, t[:, 2], rcond=None)[0]
        for role, x in parts.items():
            e = np.column_stack([np.ones(len(x)), x[:, :2]]) @ b - x[:, 2]
            assert np.isclose(got[fold][f"{role}_mae"], np.abs(e).mean()) and np.isclose(got[fold][f"{role}_rmse"], np.sqrt((e * e).mean()))


def test_rows_are_read_once_and_only_moments_shuffle(spark, rows):
    plan = G.date_moments(rows, ["a", "b", "demand"])._jdf.queryExecution().executedPlan().toString()
    # the source's own exchange is repartition(6); the fit adds one, of tasks x dates moments
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_few_dates_and_no_rows(spark, rows):
    assert G.fold_fits(rows.where("pickup_date < '2024-01-03'"), {"m": (["a"], 0.0)}, 3) == ([], {})
    none = rows.where("false")
    assert G.fold_fits(none, {"m": (["a"], 0.0)}, 3) == ([], {}) and G.fit_linear(none, {"m": (["a"], 0.0)}) == {}
    assert G.fold_predictions(none, {"m": (["a"], 0.0)}, 3).collect() == []


def test_walk_forward_cv_takes_linear_candidates_from_moments(spark):
    from zonecast.plans.catalog import split_rows
    from tests.conftest import SF_SMOKE

    train = split_rows(spark, SF_SMOKE).where("split = 'train'").drop("split")
    got = ML.walk_forward_cv(train, ["linear_regression", "ridge_regression"]).collect()
    assert len(got) == 6
    # a fit by pyspark.ml on one fold's rows scores the same
    f = S.fold_frame(train).where("fold = 3")
    model = ML.fit("ridge_regression", f.where("role = 'train'"), "cv")
    mae = ML.predict(model, f.where("role = 'train'")).agg(F.avg(F.abs(F.col("predicted_demand") - F.col("demand")))).first()[0]
    own = next(r for r in got if r.fold == 3 and r.model_name == "ridge_regression")
    assert abs(own.train_mae - mae) < 1e-5  # there the matrix is singular and Spark falls back to an iterative solver
