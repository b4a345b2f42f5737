"""Demand regressors in ``pyspark.ml``.

Every candidate is a ``Pipeline``: ``MedianImputer`` -> ``VectorAssembler`` -> regressor of Spark ML, or
``MedianImputer`` -> ``HistBoostedRegressor`` (``boosting``) for histogram boosting and the depth-wise and
leaf-wise profiles, or ``ExtraTreesRegressor`` (``extra_trees``). Fitting is distributed; the driver only loops over the short, fixed list of candidates and
folds. The source's boosting libraries are not available, so their parameter profiles carry their own names
(``gbt_*_profile``; the CatBoost one runs on ``GBTRegressor``). No number of the source's models is claimed.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.config import ALL_FEATURES, TARGET
from zonecast.operators import gram as GR
from zonecast.operators import metrics as M
from zonecast.operators import splits as S
from zonecast.operators.boosting import BoostParams, HistBoostedRegressor
from zonecast.operators.common import row_numbers, scalar_row
from zonecast.operators.extra_trees import ExtraTreesParams, ExtraTreesRegressor
from zonecast.operators.stages import LogTargetInverse, MedianImputer

SEED = 42

# fixed values: candidate names and their two parameter profiles (cv, final)
PROFILES = {
    "linear_regression": ({}, {}),
    "ridge_regression": ({"alpha": 1.0}, {"alpha": 1.0}),
    "random_forest": ({"numTrees": 120, "maxDepth": 16, "minInstancesPerNode": 5},
                      {"numTrees": 180, "maxDepth": 20, "minInstancesPerNode": 4}),
    "extra_trees": ({"trees": 160, "min_leaf": 3}, {"trees": 220, "min_leaf": 2}),
    "gradient_boosting": ({"maxIter": 150, "stepSize": 0.05, "maxDepth": 4},
                          {"maxIter": 250, "stepSize": 0.05, "maxDepth": 4}),
    "hist_gradient_boosting": ({"trees": 220, "max_leaves": 31, "max_depth": 8, "min_leaf": 20, "l2": 0.1},
                               {"trees": 320, "max_leaves": 31, "max_depth": 8, "min_leaf": 20, "l2": 0.1}),
    "gbt_xgboost_profile": ({"trees": 220, "max_leaves": None, "max_depth": 6, "min_leaf": 1, "l2": 1.0,
                             "subsample": 0.85, "colsample": 0.85},
                            {"trees": 350, "max_leaves": None, "max_depth": 6, "min_leaf": 1, "l2": 1.0,
                             "subsample": 0.85, "colsample": 0.85}),
    "gbt_lightgbm_profile": ({"trees": 250, "max_leaves": 63, "min_leaf": 20, "subsample": 0.85, "colsample": 0.85},
                             {"trees": 400, "max_leaves": 63, "min_leaf": 20, "subsample": 0.85, "colsample": 0.85}),
    "gbt_catboost_profile": ({"maxIter": 220, "stepSize": 0.05, "maxDepth": 8},
                             {"maxIter": 400, "stepSize": 0.05, "maxDepth": 8}),
}
HIST_BOOSTED = ("hist_gradient_boosting", "gbt_xgboost_profile", "gbt_lightgbm_profile")

# A smoke-size profile for checks on small data: same families and settings,
# fewer and shallower trees. Not used by the training plan.
QUICK_OVERRIDES = {
    "random_forest": {"numTrees": 20, "maxDepth": 8},
    "gradient_boosting": {"maxIter": 20},
    "hist_gradient_boosting": {"trees": 20},
    "gbt_xgboost_profile": {"trees": 20},
    "gbt_lightgbm_profile": {"trees": 20},
    "gbt_catboost_profile": {"maxIter": 20, "maxDepth": 6},
}
CANDIDATES = list(PROFILES)


def candidate_names() -> list[str]:
    return list(CANDIDATES)


def _regressor(name: str, params: dict, label: str, train: DataFrame | None):
    if name == "linear_regression":
        return LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, solver="normal")
    if name == "ridge_regression":
        # Spark scales the label internally; this regParam equals the closed-form ridge with ``alpha``.
        stats = train.agg(F.stddev_pop(F.col(label).cast("double")).alias("sd"), F.count(F.lit(1)).alias("n")).first()
        reg = params["alpha"] * float(stats["sd"] or 0.0) / max(int(stats["n"]), 1)
        return LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=0.0,
                                standardization=False, solver="normal")
    if name == "random_forest":
        return RandomForestRegressor(featuresCol="features", labelCol=label, featureSubsetStrategy="all",
                                     seed=SEED, **params)
    return GBTRegressor(featuresCol="features", labelCol=label, seed=SEED, **params)


def build_pipeline(name: str, profile: str = "final", features: list[str] = ALL_FEATURES, label: str = TARGET,
                   train: DataFrame | None = None, overrides: dict | None = None) -> Pipeline:
    """Median imputer, assembler where the regressor needs one, and regressor of one candidate."""
    if name not in PROFILES:
        raise ValueError(f"unknown model: {name}")
    params = dict(PROFILES[name][0 if profile == "cv" else 1])
    params.update(overrides or {})
    imputed = [f"{c}__imp" for c in features]
    imputer = MedianImputer(inputCols=features, outputCols=imputed)
    if name == "extra_trees":
        settings = json.dumps(asdict(ExtraTreesParams(seed=SEED, **params)))
        return Pipeline(stages=[imputer, ExtraTreesRegressor(inputCols=imputed, labelCol=label, settings=settings)])
    if name in HIST_BOOSTED:
        boost = json.dumps(asdict(BoostParams(seed=SEED, **params)))
        return Pipeline(stages=[imputer, HistBoostedRegressor(inputCols=imputed, labelCol=label, boost=boost)])
    assembler = VectorAssembler(inputCols=imputed, outputCol="features", handleInvalid="error")
    return Pipeline(stages=[imputer, assembler, _regressor(name, params, label, train)])


def _as_double(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def fit(name: str, train: DataFrame, profile: str = "final", features: list[str] = ALL_FEATURES,
        label: str = TARGET, overrides: dict | None = None) -> PipelineModel:
    tr = _as_double(train, features + [label])
    return build_pipeline(name, profile, features, label, tr, overrides).fit(tr)


def predict(model: PipelineModel, df: DataFrame, features: list[str] = ALL_FEATURES,
            out_col: str = "predicted_demand") -> DataFrame:
    """Batch scoring (G17): one ``transform``; helper columns are dropped."""
    scored = model.transform(_as_double(df, features)).withColumnRenamed("prediction", out_col)
    return scored.drop("features", *[f"{c}__imp" for c in features])


# ---- G11 target transform ---------------------------------------------------
def _log_target(c: str) -> Column:
    return F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))


def log_target_stats(train: DataFrame, label: str = TARGET) -> DataFrame:
    """One row (log_mean, log_std): mean and population std of ``log1p(max(y, 0))``; std 0 -> 1."""
    y = _log_target(label)
    return train.agg(F.avg(y).alias("log_mean"), F.stddev_pop(y).alias("_s")).select(
        "log_mean", F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0)).alias("log_std"))


def to_log_standardised(df: DataFrame, stats: DataFrame, label: str = TARGET, out_col: str = "target_t") -> DataFrame:
    """Forward transform with fitted stats (a scalar subquery): ``(log1p(y) - mean) / std``."""
    row = scalar_row(stats)
    return df.withColumn(out_col, (_log_target(label) - row.getField("log_mean")) / row.getField("log_std"))


def from_log_standardised(df: DataFrame, stats: DataFrame, col: str, out_col: str) -> DataFrame:
    """Inverse transform: ``max(expm1(z * std + mean), 0)``."""
    row = scalar_row(stats)
    return df.withColumn(out_col, F.greatest(F.expm1(F.col(col) * row.getField("log_std") + row.getField("log_mean")),
                                             F.lit(0.0)))


def fit_log_standardised(name: str, train: DataFrame, profile: str = "final", label: str = TARGET, **kw) -> PipelineModel:
    """A pipeline fitted on ``(log1p(y) - mean) / std`` whose last stage undoes that (G11); ``predict`` and
    ``save_model`` take it like any other.

    The two fitted numbers are model state, so they are read back once.
    """
    st = log_target_stats(train, label).first()
    m, s = float(st["log_mean"]), float(st["log_std"])
    t = train.withColumn("_y_t", (_log_target(label) - F.lit(m)) / F.lit(s))
    return PipelineModel([*fit(name, t, profile, label="_y_t", **kw).stages, LogTargetInverse(mean=m, std=s)])


# ---- G15 holdout comparison, G14 walk-forward CV ---------------------------
def holdout_metrics(model: PipelineModel, split_df: DataFrame, name: str, label: str = TARGET) -> DataFrame:
    """(model_name, split, metrics) for every split in one scoring pass."""
    p = predict(model, split_df).withColumn("actual_demand", F.col(label).cast("double")) \
        .withColumn("model_name", F.lit(name))
    return M.regression_metrics(p, group_cols=("model_name", "split"))


def _fit_all(train: DataFrame, names: list[str], profile: str, overrides: dict | None = None) -> list:
    """Fit each named candidate on ``train``, persisted for the fits and released after them."""
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [(n, fit(n, train, profile, overrides=(overrides or {}).get(n))) for n in names]
    finally:
        train.unpersist()


def holdout_comparison(split_df: DataFrame, names: list[str], profile: str = "final",
                       overrides: dict | None = None) -> DataFrame:
    """Fit every candidate on the train part, score train/val/test, one row per model.

    The train part is persisted while the candidates are fitted (fits are
    eager) and released afterwards; scoring reads ``split_df``.
    """
    models = _fit_all(split_df.where(F.col("split") == "train"), names, profile, overrides)
    parts = [holdout_metrics(m, split_df, n) for n, m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return M.comparison_row(out)


def walk_forward_cv(train_df: DataFrame, names: list[str], profile: str = "cv", n_splits: int = 3,
                    overrides: dict | None = None) -> DataFrame:
    """CV result rows (fold, model_name, metrics) on expanding date folds.

    The linear candidates of all folds are fitted from one pass (``gram``); the others one
    fold after the other.
    """
    linear = GR.linear_candidates(names)
    parts = [GR.fold_predictions(train_df, linear, n_splits)] if linear else []
    others = [n for n in names if n not in linear]
    ff = S.fold_frame(train_df, n_splits)
    for fold in range(1, n_splits + 1) if others else ():
        f = ff.where(F.col("fold") == fold)
        for n, m in _fit_all(f.where(F.col("role") == "train"), others, profile, overrides):
            parts.append(predict(m, f).select(F.lit(n).alias("model_name"), "fold", "role",
                                              F.col(TARGET).cast("double").alias("actual_demand"),
                                              "predicted_demand"))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return M.fold_metrics(allp)


# ---- G18 native importance, G19 permutation importance ---------------------
def native_importance(model: PipelineModel, features: list[str] = ALL_FEATURES):
    """(feature, importance[, raw_coefficient]) from trees or |coefficients|.

    Returns a DataFrame built from the fitted model's metadata (one value per
    feature), or None when the model has neither.
    """
    est = next(s for s in reversed(model.stages) if not isinstance(s, LogTargetInverse))
    from pyspark.sql import SparkSession

    ss = SparkSession.getActiveSession()
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
        return ss.createDataFrame([(f, float(v)) for f, v in zip(features, vals)], "feature string, importance double") \
            .orderBy(F.desc("importance"), "feature")
    if hasattr(est, "coefficients"):
        vals = est.coefficients.toArray().tolist()
        return ss.createDataFrame([(f, abs(float(v)), float(v)) for f, v in zip(features, vals)],
                                  "feature string, importance double, raw_coefficient double") \
            .orderBy(F.desc("importance"), "feature")
    return None


def permutation_importance(model: PipelineModel, sample: DataFrame, features: list[str] = ALL_FEATURES,
                           n_repeats: int = 5, seed: int = SEED, label: str = TARGET,
                           max_rows: int | None = None) -> DataFrame:
    """Increase of MAE when one feature is shuffled, mean and population std over repeats.

    One scoring job: the sample is joined to itself through ``n_repeats``
    seeded permutations, exploded once per feature with only that feature
    replaced, scored by one ``transform`` and aggregated per (feature,
    repeat). Permutation ``r`` pairs the row at position k of a hash order
    with the row at position k of a second, repeat-seeded hash order; the
    positions come from ``row_numbers`` (range-partitioned, no one-task
    window). All rows are used unless ``max_rows`` asks for a sample, taken by a
    seeded hash order.
    """
    base = sample.select(*features, F.col(label).cast("double").alias("_y"))
    if max_rows is not None:
        base = base.orderBy(F.xxhash64(F.lit(seed), *features, "_y"), *features).limit(int(max_rows))
    base = row_numbers(base, [F.xxhash64(*features, "_y"), *features], "_rid")
    reps = base.select("_rid", *[F.col(c).alias(f"_src_{c}") for c in features],
                       F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))
    src = row_numbers(reps, [F.xxhash64(F.col("repeat") + F.lit(seed), "_rid"), "_rid"], "_k",
                      group_cols=["repeat"]).drop("_rid")
    allp = base.join(src, on=F.col("_rid") == F.col("_k")).drop("_k")
    fx = allp.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in features])))
    swapped = fx.select("repeat", "feature", "_y", *[
        F.when(F.col("feature") == c, F.col(f"_src_{c}")).otherwise(F.col(c)).alias(c) for c in features])
    scored = predict(model, swapped)
    perm_mae = scored.groupBy("feature", "repeat").agg(F.avg(F.abs(F.col("predicted_demand") - F.col("_y"))).alias("mae"))
    ref_mae = predict(model, base).agg(F.avg(F.abs(F.col("predicted_demand") - F.col("_y")))).scalar()
    return (perm_mae.withColumn("ref_mae", ref_mae)
            .groupBy("feature").agg(F.avg(F.col("mae") - F.col("ref_mae")).alias("importance_mean"),
                                    F.stddev_pop(F.col("mae") - F.col("ref_mae")).alias("importance_std"))
            .orderBy(F.desc("importance_mean"), "feature"))


# ---- G12 feature standardiser ------------------------------------------------
def fit_standardiser(train: DataFrame, features: list[str] = ALL_FEATURES) -> DataFrame:
    """One row of per-feature mean and population std (zero std -> 1), from one aggregate.

    ``pyspark.ml.feature.StandardScaler`` divides by the sample std; the
    source scales by the population std, which this reproduces.
    """
    aggs = []
    for c in features:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    st = train.agg(*aggs)
    return st.select(*[F.col(f"{c}__mean") for c in features],
                     *[F.when(F.col(f"{c}__std") > 0, F.col(f"{c}__std")).otherwise(F.lit(1.0)).alias(f"{c}__std")
                       for c in features])


def standardise(df: DataFrame, stats: DataFrame, features: list[str] = ALL_FEATURES) -> DataFrame:
    """``(x - mean) / std`` per feature with the fitted one-row stats (a scalar subquery)."""
    row = scalar_row(stats)
    return df.withColumns({c: (F.col(c).cast("double") - row.getField(f"{c}__mean")) / row.getField(f"{c}__std")
                           for c in features})
