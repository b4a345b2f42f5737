"""pyspark.ml candidates on a small synthetic frame."""

import numpy as np
import pandas as pd

from zonecast.config import ALL_FEATURES
from zonecast.operators import models as ML


def frame(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, len(ALL_FEATURES)))
    y = 50 + X[:, 0] * 3 - X[:, 15] * 2 + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame(X, columns=ALL_FEATURES)
    pdf["demand"] = y
    pdf.loc[:5, "lag_24"] = np.nan  # imputed by the median
    return spark.createDataFrame(pdf), X, y


def test_ridge_equals_closed_form(spark):
    df, X, y = frame(spark)
    m = ML.fit("ridge_regression", df.dropna())
    keep = ~np.isnan(X).any(1)
    Xk, yk = X[keep], y[keep]
    Xc, yc = Xk - Xk.mean(0), yk - yk.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(Xk.shape[1]), Xc.T @ yc)
    assert np.allclose(m.stages[-1].coefficients.toArray(), w, atol=1e-6)


def test_pipeline_predicts_with_imputer(spark):
    df, X, y = frame(spark)
    m = ML.fit("linear_regression", df)
    out = ML.predict(m, df).toPandas()
    assert out["predicted_demand"].notna().all() and len(out) == len(y)
    imp = ML.native_importance(m)
    assert imp.count() == len(ALL_FEATURES) and "raw_coefficient" in imp.columns


def test_tree_profile_and_permutation_importance(spark):
    df, X, y = frame(spark)
    m = ML.fit("random_forest", df, overrides={"numTrees": 5, "maxDepth": 4})
    assert ML.native_importance(m).count() == len(ALL_FEATURES)
    pi = ML.permutation_importance(m, df, n_repeats=2).toPandas()
    assert len(pi) == len(ALL_FEATURES)
    assert pi.iloc[0]["feature"] in (ALL_FEATURES[0], ALL_FEATURES[15])


def test_unknown_model_raises(spark):
    import pytest

    with pytest.raises(ValueError):
        ML.build_pipeline("no_such_model")


def test_standardiser_population_std(spark):
    df, X, y = frame(spark)
    st = ML.fit_standardiser(df.dropna(), ALL_FEATURES[:3])
    out = ML.standardise(df.dropna(), st, ALL_FEATURES[:3]).toPandas()
    keep = ~np.isnan(X).any(1)
    want = (X[keep, :3] - X[keep, :3].mean(0)) / X[keep, :3].std(0)
    assert np.allclose(out[ALL_FEATURES[:3]].to_numpy(), want)
