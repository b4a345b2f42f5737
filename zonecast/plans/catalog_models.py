"""Registered model queries (G1-G19). Fitted regressors have no SQL oracle here; the preprocessing stages have."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonecast.config import ALL_FEATURES
from zonecast.operators import metrics as M
from zonecast.operators import models as ML
from zonecast.operators import stages as ST
from zonecast.plans import oracle as O
from zonecast.plans.catalog import present, register, split_rows

LINEAR = ["linear_regression", "ridge_regression"]
TREES = ["random_forest", "gradient_boosting"]
BOOSTED_PROFILES = ["gbt_xgboost_profile", "gbt_lightgbm_profile", "gbt_catboost_profile"]


# planted gaps: a column loses a day's first hours, another every third hour, the last all its values
_GAPS = {"lag_1": "hour < 5", "rolling_std_24": "hour % 3 = 0", "expanding_mean_zone": "pickup_zone IS NOT NULL"}
_KEYS = ["pickup_zone", "pickup_date", "hour"]


def _with_gaps(df):
    return df.withColumns({c: F.expr(f"CASE WHEN NOT ({gap}) THEN CAST({c} AS DOUBLE) END") for c, gap in _GAPS.items()})


_GAPS_SQL = O.with_ctes("split")[:-1] + ", gaps AS (SELECT pickup_zone, pickup_date, hour, split, " + ", ".join(
    f"CASE WHEN NOT ({gap}) THEN CAST({c} AS DOUBLE) END AS {c}" for c, gap in _GAPS.items()) + " FROM split)"


@register("imputed_features", _GAPS_SQL + ", med AS (SELECT " + ", ".join(
    f"coalesce(median({c}), {O.d(0)}) AS m_{c}" for c in _GAPS) + """ FROM gaps WHERE split = 'train')
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, """ + ", ".join(
    f"coalesce({c}, m_{c}) AS {c}" for c in _GAPS) + " FROM gaps CROSS JOIN med")
def q_imputed_features(spark, sf):
    """Every model row with planted gaps filled by the training part's medians (G1)."""
    rows, cols = _with_gaps(split_rows(spark, sf)), list(_GAPS)
    model = ST.MedianImputer(inputCols=cols, outputCols=cols).fit(rows.where(F.col("split") == "train"))
    return present(model.transform(rows).select(*_KEYS, *cols))


_SCALED_SQL = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in ALL_FEATURES)


@register("scaled_features", O.with_ctes("split")[:-1] + f""", st AS (SELECT {_SCALED_SQL} FROM split WHERE split = 'train')
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour AS hour_of_day, """ + ", ".join(
    f"(CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE {O.d(1)} END AS {c}" for c in ALL_FEATURES) +
    " FROM split CROSS JOIN st")
def q_scaled_features(spark, sf):
    """Every model row scaled by the training part's means and population deviations."""
    rows = split_rows(spark, sf)
    scaled = [f"{c}__scaled" for c in ALL_FEATURES]
    model = ST.PopulationScaler(inputCols=ALL_FEATURES, outputCols=scaled).fit(rows.where(F.col("split") == "train"))
    return present(model.transform(rows).select("pickup_zone", "pickup_date", F.col("hour").alias("hour_of_day"),
                                                *[F.col(f"{c}__scaled").alias(c) for c in ALL_FEATURES]))


@register("ml_holdout_linear")
def q_ml_holdout_linear(spark, sf):
    return ML.holdout_comparison(split_rows(spark, sf), LINEAR, "final")


@register("ml_holdout_trees_quick")
def q_ml_holdout_trees_quick(spark, sf):
    """Tree families with the smoke-size profile; the full profiles run in ``zonecast.plans.train``."""
    return ML.holdout_comparison(split_rows(spark, sf), TREES + BOOSTED_PROFILES, "final", ML.QUICK_OVERRIDES)


@register("ml_holdout_extra_trees")
def q_ml_holdout_extra_trees(spark, sf):
    """Extremely randomised trees with their real profile: 220 trees without a depth cap."""
    return ML.holdout_comparison(split_rows(spark, sf), ["extra_trees"], "final")


@register("ml_holdout_random_forest")
def q_ml_holdout_random_forest(spark, sf):
    """The random forest with its real profile: 180 trees, depth 20."""
    return ML.holdout_comparison(split_rows(spark, sf), ["random_forest"], "final")


@register("ml_holdout_gradient_boosting")
def q_ml_holdout_gradient_boosting(spark, sf):
    """Gradient boosting with its real profile: 250 iterations of depth 4."""
    return ML.holdout_comparison(split_rows(spark, sf), ["gradient_boosting"], "final")


@register("ml_holdout_hist_boosting")
def q_ml_holdout_hist_boosting(spark, sf):
    """Histogram boosting with its real profile: 320 trees, 31 leaves, depth 8, L2 0.1."""
    return ML.holdout_comparison(split_rows(spark, sf), ["hist_gradient_boosting"], "final")


@register("ml_walk_forward_cv_linear")
def q_ml_walk_forward_cv_linear(spark, sf):
    train = split_rows(spark, sf).where(F.col("split") == "train").drop("split")
    return ML.walk_forward_cv(train, LINEAR, "cv")


@register("ml_cv_summary_linear")
def q_ml_cv_summary_linear(spark, sf):
    return M.cv_summary(q_ml_walk_forward_cv_linear(spark, sf))


@register("ml_native_importance")
def q_ml_native_importance(spark, sf):
    sp = split_rows(spark, sf)
    return ML.native_importance(ML.fit("linear_regression", sp.where(F.col("split") == "train")))


@register("ml_permutation_importance")
def q_ml_permutation_importance(spark, sf):
    sp = split_rows(spark, sf)
    model = ML.fit("linear_regression", sp.where(F.col("split") == "train"))
    return ML.permutation_importance(model, sp.where(F.col("split") == "val"), n_repeats=5)


@register("ml_test_predictions")
def q_ml_test_predictions(spark, sf):
    """Selected-by-validation linear family model scored on the test part."""
    sp = split_rows(spark, sf)
    model = ML.fit("linear_regression", sp.where(F.col("split") == "train"))
    return M.prediction_frame(ML.predict(model, sp.where(F.col("split") == "test")))
