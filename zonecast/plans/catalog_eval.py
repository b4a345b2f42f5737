"""Registered evaluation queries.

The forecaster here is the rule forecaster (G20), fitted on the training
part, so every table below has an exact SQL oracle. The same operators take
``pyspark.ml`` predictions unchanged (see ``zonecast.plans.train``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from zonecast.operators import eda as EDA
from zonecast.operators import gram as GR
from zonecast.operators import metrics as M
from zonecast.operators import splits as S
from zonecast.operators.forecast import rule_forecast_column
from zonecast.plans import oracle as O
from zonecast.plans.catalog import bounds, model_rows, present, register, scored, split_rows, test_predictions

MODEL = "rule_forecast"
EPS = O.d(1e-8)


def metrics_sql(y: str = "actual_demand", p: str = "predicted_demand") -> str:
    return f"""
  avg(abs({p} - {y})) AS mae,
  sqrt(avg(({p} - {y}) * ({p} - {y}))) AS rmse,
  {O.d(1.0)} - avg(({p} - {y}) * ({p} - {y})) / nullif(var_pop({y}), 0) AS r2,
  median(abs({p} - {y})) AS median_ae,
  avg(abs(({y} - {p}) / greatest(abs({y}), {EPS}))) * {O.d(100.0)} AS mape,
  avg({O.d(2.0)} * abs({p} - {y}) / greatest(abs({y}) + abs({p}), {EPS})) * {O.d(100.0)} AS smape,
  avg({p} - {y}) AS bias"""


_PRED_COLS = ("pickup_date, hour, day_of_week, month, is_weekend, is_peak_hour, pickup_zone, actual_demand, "
              "predicted_demand, error, abs_error, sq_error, pct_error, over_prediction, under_prediction")
_PRED_SQL_COLS = _PRED_COLS.replace("pickup_date,", "strftime(pickup_date, '%Y-%m-%d') AS pickup_date,", 1)


@register("rule_forecast_test", O.with_ctes("scored") + """
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, predicted_demand
FROM scored WHERE split = 'test'""")
def q_rule_forecast_test(spark, sf):
    s = scored(spark, sf).where(F.col("split") == "test")
    return present(s.select("pickup_zone", "pickup_date", "hour", "predicted_demand"))


@register("prediction_frame", O.with_ctes("pred_test") + f"SELECT {_PRED_SQL_COLS} FROM pred_test")
def q_prediction_frame(spark, sf):
    return present(test_predictions(spark, sf))


def _metrics_by_split(spark, sf):
    s = scored(spark, sf).withColumn("model_name", F.lit(MODEL)).withColumn("actual_demand", F.col("demand").cast("double"))
    return M.regression_metrics(s, group_cols=("model_name", "split"))


@register("metrics_by_split", O.with_ctes("scored") + f"""
SELECT '{MODEL}' AS model_name, split, {metrics_sql()}
FROM (SELECT split, CAST(demand AS DOUBLE) AS actual_demand, predicted_demand FROM scored)
GROUP BY split""")
def q_metrics_by_split(spark, sf):
    return _metrics_by_split(spark, sf)


_COMPARISON_SQL = f"""
comparison AS (
  SELECT model_name,
""" + ",\n".join(f"    max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}"
                 for m in M.METRIC_NAMES for s in ("train", "val", "test")) + f"""
  FROM (SELECT '{MODEL}' AS model_name, split, {metrics_sql()}
        FROM (SELECT split, CAST(demand AS DOUBLE) AS actual_demand, predicted_demand FROM scored)
        GROUP BY split)
  GROUP BY model_name)"""


def _comparison(spark, sf):
    return M.comparison_row(_metrics_by_split(spark, sf))


@register("model_comparison", O.with_ctes("scored")[:-1] + ",\n" + _COMPARISON_SQL + "\nSELECT * FROM comparison")
def q_model_comparison(spark, sf):
    return _comparison(spark, sf)


@register("generalisation", O.with_ctes("scored")[:-1] + ",\n" + _COMPARISON_SQL + f"""
SELECT model_name, val_mae - train_mae AS generalization_gap_mae, val_rmse - train_rmse AS generalization_gap_rmse,
  val_mae > train_mae * {O.d(1.10)} AS overfitting_suspected
FROM comparison""")
def q_generalisation(spark, sf):
    c = _comparison(spark, sf)
    return c.select("model_name",
                    M.generalisation(F.col("train_mae"), F.col("val_mae")).alias("generalization_gap_mae"),
                    M.generalisation(F.col("train_rmse"), F.col("val_rmse")).alias("generalization_gap_rmse"),
                    M.overfitting_flag(F.col("train_mae"), F.col("val_mae")).alias("overfitting_suspected"))


# ---- walk-forward CV of the rule forecaster --------------------------------
def _cv_predictions(spark, sf):
    train = split_rows(spark, sf).where(F.col("split") == "train").drop("split")
    ff = S.fold_frame(train)
    base = ff.where(F.col("role") == "train").groupBy("fold").agg(
        F.median(F.col("demand").cast("double")).alias("rule_base"))
    return (ff.join(F.broadcast(base), on="fold")
            .select(F.lit(MODEL).alias("model_name"), "fold", "role",
                    F.col("demand").cast("double").alias("actual_demand"),
                    rule_forecast_column(F.col("rule_base"), F.col("hour"), F.col("is_weekend"),
                                         F.col("zone_trip_volume")).alias("predicted_demand")))


def _cv_results(spark, sf):
    return M.fold_metrics(_cv_predictions(spark, sf))


_CV_SQL = f"""
cvp AS (
  SELECT '{MODEL}' AS model_name, f.fold, f.role, CAST(s.demand AS DOUBLE) AS actual_demand,
    {O.rule_forecast_sql('b.rule_base', 's.hour', 's.is_weekend', 's.zone_trip_volume')} AS predicted_demand
  FROM split s JOIN folds f USING (pickup_date)
  JOIN (SELECT f2.fold, median(CAST(s2.demand AS DOUBLE)) AS rule_base
        FROM split s2 JOIN folds f2 USING (pickup_date) WHERE s2.split = 'train' AND f2.role = 'train'
        GROUP BY f2.fold) b ON b.fold = f.fold
  WHERE s.split = 'train' AND f.role IS NOT NULL),
cvm AS (
  SELECT model_name, fold, role, {metrics_sql()} FROM cvp GROUP BY model_name, fold, role),
cv_results AS (
  SELECT CAST(t.fold AS INTEGER) AS fold, t.model_name, t.mae AS train_mae, t.rmse AS train_rmse, t.r2 AS train_r2,
    v.mae AS val_mae, v.rmse AS val_rmse, v.r2 AS val_r2, v.mae - t.mae AS mae_gap, v.rmse - t.rmse AS rmse_gap,
    v.bias AS bias, v.median_ae AS median_ae, v.mape AS mape, v.smape AS smape
  FROM cvm t JOIN cvm v ON t.model_name = v.model_name AND t.fold = v.fold AND t.role = 'train' AND v.role = 'val'),
cv_summary AS (
  SELECT model_name, avg(train_mae) AS cv_train_mae_mean, stddev_samp(train_mae) AS cv_train_mae_std,
    avg(val_mae) AS cv_val_mae_mean, stddev_samp(val_mae) AS cv_val_mae_std,
    avg(train_rmse) AS cv_train_rmse_mean, avg(val_rmse) AS cv_val_rmse_mean, avg(val_r2) AS cv_val_r2_mean,
    avg(mae_gap) AS cv_gap_mae_mean, avg(rmse_gap) AS cv_gap_rmse_mean, avg(bias) AS cv_bias_mean,
    avg(median_ae) AS cv_median_ae_mean, avg(mape) AS cv_mape_mean, avg(smape) AS cv_smape_mean
  FROM cv_results GROUP BY model_name)"""

_CV_WITH = O.with_ctes("split", "folds", "scored")[:-1] + ",\n" + _CV_SQL


@register("cv_results", _CV_WITH + "\nSELECT * FROM cv_results")
def q_cv_results(spark, sf):
    return _cv_results(spark, sf)


@register("cv_summary", _CV_WITH + "\nSELECT * FROM cv_summary")
def q_cv_summary(spark, sf):
    return M.cv_summary(_cv_results(spark, sf))


@register("model_selection", _CV_WITH + ",\n" + _COMPARISON_SQL + """
SELECT c.*, s.* EXCLUDE (model_name),
  CAST(dense_rank() OVER (ORDER BY c.val_mae) AS INTEGER) AS holdout_val_rank,
  CAST(dense_rank() OVER (ORDER BY s.cv_val_mae_mean NULLS LAST) AS INTEGER) AS cv_val_rank
FROM comparison c LEFT JOIN cv_summary s USING (model_name)""")
def q_model_selection(spark, sf):
    return M.selection_table(_comparison(spark, sf), M.cv_summary(_cv_results(spark, sf)))


@register("best_model", _CV_WITH + ",\n" + _COMPARISON_SQL + """
SELECT c.model_name, c.val_mae, s.cv_val_mae_mean
FROM comparison c LEFT JOIN cv_summary s USING (model_name)
ORDER BY c.val_mae, s.cv_val_mae_mean NULLS LAST, c.model_name LIMIT 1""")
def q_best_model(spark, sf):
    sel = M.selection_table(_comparison(spark, sf), M.cv_summary(_cv_results(spark, sf)))
    return M.best_model(sel).select("model_name", "val_mae", "cv_val_mae_mean")


for _metric in ("mae", "rmse"):
    def _mk(metric):
        @register(f"comparison_long_{metric}", O.with_ctes("scored")[:-1] + ",\n" + _COMPARISON_SQL + f"""
SELECT model_name, s AS split, v AS {metric} FROM (
  SELECT model_name, 'Train' AS s, train_{metric} AS v FROM comparison
  UNION ALL SELECT model_name, 'Val', val_{metric} FROM comparison
  UNION ALL SELECT model_name, 'Test', test_{metric} FROM comparison)""")
        def q(spark, sf):
            return EDA.melt_metric(_comparison(spark, sf), metric)
        return q
    _mk(_metric)


# ---- error tables on the test part ----------------------------------------
def _err_sql(key: str) -> str:
    k = "strftime(pickup_date, '%Y-%m-%d') AS pickup_date" if key == "pickup_date" else key
    return O.with_ctes("pred_test") + f"""
SELECT {k}, CAST(count(*) AS BIGINT) AS count, avg(abs_error) AS mean_abs_error,
  median(abs_error) AS median_abs_error, avg(error) AS mean_error, sqrt(avg(sq_error)) AS rmse,
  quantile_cont(abs_error, 0.95) AS p95_abs_error
FROM pred_test GROUP BY {key}"""


for _name, _key in (("error_by_hour", "hour"), ("error_by_zone", "pickup_zone"), ("error_by_peak_hour", "is_peak_hour")):
    def _mk2(key):
        def q(spark, sf):
            return M.error_summary(test_predictions(spark, sf), key)
        return q
    register(_name, _err_sql(_key))(_mk2(_key))


@register("calibration", O.with_ctes("pred_test")[:-1] + """,
edges AS (
  SELECT list_sort(list_distinct(quantile_cont(predicted_demand, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
  FROM pred_test),
bins AS (
  SELECT CAST(i AS INTEGER) AS bin, e[i] AS bin_lo, e[i + 1] AS bin_hi FROM edges, range(1, len(e)) r(i)),
binned AS (
  SELECT greatest(1, len(list_filter(e, lambda x: x < predicted_demand))) AS bin,
         avg(predicted_demand) AS mean_predicted, avg(actual_demand) AS mean_actual, count(*) AS n
  FROM pred_test, edges GROUP BY 1)
SELECT b.bin, b.bin_lo, b.bin_hi, mean_predicted, mean_actual, CAST(coalesce(n, 0) AS BIGINT) AS count,
       mean_actual - mean_predicted AS calibration_gap
FROM bins b LEFT JOIN binned USING (bin)""")
def q_calibration(spark, sf):
    return M.calibration(test_predictions(spark, sf))


@register("residual_summary", O.with_ctes("pred_test") + """
SELECT CAST(count(*) AS BIGINT) AS count, avg(error) AS mean_error, stddev_pop(error) AS std_error,
  median(error) AS median_error, avg(abs_error) AS mean_abs_error, median(abs_error) AS median_abs_error,
  sqrt(avg(sq_error)) AS rmse, quantile_cont(abs_error, 0.9) AS p90_abs_error,
  quantile_cont(abs_error, 0.95) AS p95_abs_error
FROM pred_test""")
def q_residual_summary(spark, sf):
    return M.residual_summary(test_predictions(spark, sf))


for _name, _over in (("top_over_predictions", True), ("top_under_predictions", False)):
    def _mk3(over):
        def q(spark, sf):
            return present(M.worst_cases(test_predictions(spark, sf), 20, over))
        return q
    _ord = "error ASC" if _over else "error DESC"
    register(_name, O.with_ctes("pred_test") + f"""
SELECT {_PRED_SQL_COLS} FROM pred_test ORDER BY {_ord}, pickup_zone, pickup_date, hour LIMIT 20""")(_mk3(_over))


@register("mae_by_hour", O.with_ctes("pred_test") + "SELECT hour, avg(abs_error) AS abs_error FROM pred_test GROUP BY hour")
def q_mae_by_hour(spark, sf):
    return EDA.mae_by(test_predictions(spark, sf), "hour")


@register("mae_by_peak_hour", O.with_ctes("pred_test") +
          "SELECT is_peak_hour, avg(abs_error) AS abs_error FROM pred_test GROUP BY is_peak_hour")
def q_mae_by_peak_hour(spark, sf):
    return EDA.mae_by(test_predictions(spark, sf), "is_peak_hour")


@register("mae_top_zones", O.with_ctes("pred_test") + """
SELECT pickup_zone, avg(abs_error) AS abs_error FROM pred_test GROUP BY pickup_zone
ORDER BY abs_error DESC, pickup_zone LIMIT 15""")
def q_mae_top_zones(spark, sf):
    return EDA.top_mae_zones(test_predictions(spark, sf), 15)


# ---- K6 selected-model metrics row ----------------------------------------
_K6 = [f"{s}_{m}" for m in ("mae", "rmse", "r2") for s in ("train", "val", "test")]


@register("selected_model_metrics", O.with_ctes("scored")[:-1] + ",\n" + _COMPARISON_SQL + f"""
SELECT model_name, {", ".join(_K6)}, val_mae - train_mae AS generalization_gap_mae,
  val_rmse - train_rmse AS generalization_gap_rmse, val_mae > train_mae * {O.d(1.10)} AS overfitting_suspected
FROM comparison""")
def q_selected_model_metrics(spark, sf):
    """The dashboard's quality row of the selected model (K6, H7)."""
    c = _comparison(spark, sf)
    return c.select("model_name", *_K6,
                    M.generalisation(F.col("train_mae"), F.col("val_mae")).alias("generalization_gap_mae"),
                    M.generalisation(F.col("train_rmse"), F.col("val_rmse")).alias("generalization_gap_rmse"),
                    M.overfitting_flag(F.col("train_mae"), F.col("val_mae")).alias("overfitting_suspected"))


@register("models_by_val_mae", O.with_ctes("scored")[:-1] + ",\n" + _COMPARISON_SQL + """
SELECT model_name, train_mae, val_mae, test_mae FROM comparison ORDER BY val_mae, model_name""")
def q_models_by_val_mae(spark, sf):
    """Model table ordered by validation MAE (K5)."""
    from zonecast.operators.scenario import models_by_val_mae

    return models_by_val_mae(_comparison(spark, sf)).select("model_name", "train_mae", "val_mae", "test_mae")


# ---- linear models: fits of all folds from per-date moments, two models to rank ----------------
_LINEAR = {"one_feature": (["lag_1"], 0.0), "two_features": (["lag_1", "rolling_mean_24"], 0.0)}


def _fits_sql(src: str, by: str) -> str:
    """Least squares of demand on lag_1, and on lag_1 and rolling_mean_24, in closed form for each group."""
    sums = f"""SELECT {by}, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2,
      covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
    FROM (SELECT {by}, CAST(lag_1 AS DOUBLE) AS x1, rolling_mean_24 AS x2, CAST(demand AS DOUBLE) AS y FROM {src}) GROUP BY {by}"""
    return f"""
  SELECT {by}, 'one_feature' AS model_name, my - c1 / v1 * m1 AS b0, c1 / v1 AS b1, CAST(NULL AS DOUBLE) AS b2 FROM ({sums})
  UNION ALL
  SELECT {by}, 'two_features', my - b1 * m1 - b2 * m2, b1, b2
  FROM (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM ({sums}))"""


_LINEAR_WITH = O.with_ctes("split", "folds")[:-1] + f""",
fold_rows AS (SELECT s.*, CAST(f.fold AS INTEGER) AS fold, f.role FROM split s JOIN folds f USING (pickup_date) WHERE s.split = 'train' AND f.role IS NOT NULL),
fold_fits AS ({_fits_sql("fold_rows WHERE role = 'train'", "fold")}),
fits AS ({_fits_sql("(SELECT *, 1 AS g FROM split WHERE split = 'train')", "g")}),
cvp AS (
  SELECT model_name, fold, role, CAST(demand AS DOUBLE) AS actual_demand, b0 + b1 * lag_1 + coalesce(b2 * rolling_mean_24, 0) AS predicted_demand
  FROM fold_rows JOIN fold_fits USING (fold)),
{_CV_SQL[_CV_SQL.index("cvm AS ("):]},
comparison AS (
  SELECT model_name,
""" + ",\n".join(f"    max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}" for m in M.METRIC_NAMES for s in ("train", "val", "test")) + f"""
  FROM (SELECT model_name, split, {metrics_sql()}
        FROM (SELECT model_name, split, CAST(demand AS DOUBLE) AS actual_demand, b0 + b1 * lag_1 + coalesce(b2 * rolling_mean_24, 0) AS predicted_demand
              FROM split, fits)
        GROUP BY model_name, split)
  GROUP BY model_name)
"""


def _linear_train(spark, sf):
    return model_rows(spark, sf).where(bounds(spark, sf).in_part("train"))


def _linear_cv(spark, sf):
    return M.fold_metrics(GR.fold_predictions(_linear_train(spark, sf), _LINEAR))


def _linear_comparison(spark, sf):
    fits = GR.fit_linear(_linear_train(spark, sf), _LINEAR)
    return M.comparison_row(M.regression_metrics(GR.predictions(split_rows(spark, sf), fits, ["split"]), group_cols=("model_name", "split")))


@register("linear_fold_coefficients", _LINEAR_WITH + """
SELECT fold, model_name, 'intercept' AS feature, b0 AS coefficient FROM fold_fits
UNION ALL SELECT fold, model_name, 'lag_1', b1 FROM fold_fits
UNION ALL SELECT fold, model_name, 'rolling_mean_24', b2 FROM fold_fits WHERE b2 IS NOT NULL""")
def q_linear_fold_coefficients(spark, sf):
    """Coefficients of two linear models for every fold, from one pass."""
    return GR.coefficient_rows(spark, GR.fold_fits(_linear_train(spark, sf), _LINEAR)[1])


@register("linear_cv_results", _LINEAR_WITH + "SELECT * FROM cv_results")
def q_linear_cv_results(spark, sf):
    """Fold metrics of two fitted linear models."""
    return _linear_cv(spark, sf)


@register("linear_cv_summary", _LINEAR_WITH + "SELECT * FROM cv_summary")
def q_linear_cv_summary(spark, sf):
    """Their summary over the folds."""
    return M.cv_summary(_linear_cv(spark, sf))


@register("linear_model_comparison", _LINEAR_WITH + "SELECT * FROM comparison")
def q_linear_model_comparison(spark, sf):
    """Train, validation and test metrics of the two models fitted on the train part."""
    return _linear_comparison(spark, sf)


@register("linear_model_selection", _LINEAR_WITH + """
SELECT c.*, s.* EXCLUDE model_name,
  CAST(dense_rank() OVER (ORDER BY val_mae) AS INTEGER) AS holdout_val_rank,
  CAST(dense_rank() OVER (ORDER BY cv_val_mae_mean) AS INTEGER) AS cv_val_rank
FROM comparison c LEFT JOIN cv_summary s ON s.model_name = c.model_name""")
def q_linear_model_selection(spark, sf):
    """Both tables joined and ranked: more than one model to order."""
    return M.selection_table(_linear_comparison(spark, sf), M.cv_summary(_linear_cv(spark, sf)))
