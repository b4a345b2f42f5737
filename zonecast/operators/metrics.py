"""Forecast evaluation.

Each metric table is one aggregate plus, for medians and percentiles of
errors, the distributed exact quantile operator (``quantiles="distributed"``,
the default): errors are continuous, so a value->count map per group could
hold a hot group's every row in one task. ``quantiles="map"`` uses Spark's
exact ``percentile`` (fine for few distinct values) and ``"approx"`` the
mergeable ``percentile_approx`` sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.config import METRIC_EPS, OVERFIT_RATIO
from zonecast.operators.common import with_scalars
from zonecast.operators.quantiles import multi_quantile_columns, quantile_columns


def _quantile(c: Column, q, mode: str) -> Column:
    if mode == "approx":
        return F.percentile_approx(c, q, 100000)
    return F.percentile(c, q) if not isinstance(q, float) or q != 0.5 else F.median(c)


def _agg_with_quantiles(df: DataFrame, group_cols, aggs: list, value: Column, named: dict[str, float],
                        mode: str, order: list[str]) -> DataFrame:
    """``aggs`` plus quantiles of ``value`` per group, columns in ``order``."""
    group_cols = list(group_cols)
    if mode == "distributed":
        base = df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
        q = quantile_columns(df.withColumn("_qv", value), group_cols, "_qv", named)
        out = base.join(q, on=group_cols, how="left") if group_cols else with_scalars(base, q)
    else:
        extra = [_quantile(value, p, mode).alias(n) for n, p in named.items()]
        out = df.groupBy(*group_cols).agg(*aggs, *extra) if group_cols else df.agg(*aggs, *extra)
    return out.select(*group_cols, *order)


def regression_metrics(df: DataFrame, actual: str = "actual_demand", predicted: str = "predicted_demand",
                       group_cols: tuple[str, ...] = (), quantiles: str = "distributed") -> DataFrame:
    """mae, rmse, r2, median_ae, mape, smape, bias (H1); optionally per group.

    r2 = 1 - mean squared error / population variance of the actual values; for constant actual
    values it is 1 where every prediction is exact, else 0.
    bias = mean(predicted - actual).
    """
    y = F.col(actual).cast("double")
    p = F.col(predicted).cast("double")
    err = p - y
    ae = F.abs(err)
    eps = F.lit(METRIC_EPS)
    aggs = [
        F.avg(ae).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.when(F.var_pop(y) == 0, F.when(F.avg(err * err) == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(F.lit(1.0) - F.try_divide(F.avg(err * err), F.var_pop(y))).alias("r2"),
        (F.avg(F.abs((y - p) / F.greatest(F.abs(y), eps))) * F.lit(100.0)).alias("mape"),
        (F.avg(F.lit(2.0) * F.abs(p - y) / F.greatest(F.abs(y) + F.abs(p), eps)) * F.lit(100.0)).alias("smape"),
        F.avg(err).alias("bias"),
    ]
    return _agg_with_quantiles(df, group_cols, aggs, ae, {"median_ae": 0.5}, quantiles, METRIC_NAMES)


METRIC_NAMES = ["mae", "rmse", "r2", "median_ae", "mape", "smape", "bias"]


def prediction_frame(df: DataFrame, actual: str = "demand", predicted: str = "predicted_demand") -> DataFrame:
    """Keys + actual/predicted + error columns (H2). error = actual - predicted."""
    a = F.col(actual).cast("double")
    p = F.col(predicted).cast("double")
    return df.select(
        "pickup_date", "hour", "day_of_week", "month", "is_weekend", "is_peak_hour", "pickup_zone",
        a.alias("actual_demand"), p.alias("predicted_demand"),
    ).withColumns({
        "error": F.col("actual_demand") - F.col("predicted_demand"),
    }).withColumns({
        "abs_error": F.abs(F.col("error")),
        "sq_error": F.col("error") * F.col("error"),
    }).withColumns({
        "pct_error": F.when(F.col("actual_demand") != 0, F.col("abs_error") / F.col("actual_demand")),
        "over_prediction": (F.col("predicted_demand") > F.col("actual_demand")).cast("int"),
        "under_prediction": (F.col("predicted_demand") < F.col("actual_demand")).cast("int"),
    })


def error_summary(pred: DataFrame, key: str, quantiles: str = "distributed") -> DataFrame:
    """count, mean/median abs error, mean error, rmse, p95 abs error by one key."""
    aggs = [F.count(F.lit(1)).alias("count"), F.avg("abs_error").alias("mean_abs_error"),
            F.avg("error").alias("mean_error"), F.sqrt(F.avg("sq_error")).alias("rmse")]
    return _agg_with_quantiles(pred, [key], aggs, F.col("abs_error"),
                               {"median_abs_error": 0.5, "p95_abs_error": 0.95}, quantiles,
                               ["count", "mean_abs_error", "median_abs_error", "mean_error", "rmse", "p95_abs_error"])


def calibration(pred: DataFrame, n_bins: int = 10, quantiles: str = "distributed") -> DataFrame:
    """Quantile bins of the prediction with mean predicted/actual, count and gap.

    Edges are the 0, 1/n, ..., 1 quantiles with duplicates removed; a value
    goes to the bin whose upper edge is the first edge >= it (the lowest
    edge belongs to bin 1). Bins without rows are kept with count 0.
    """
    qs = [i / n_bins for i in range(n_bins + 1)]
    if quantiles == "distributed":
        from zonecast.operators.quantiles import exact_quantiles

        long = exact_quantiles(pred, [], "predicted_demand", qs)
        edges = long.agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))),
                                                      lambda s: s["value"])).alias("edges"))
    else:
        edges = pred.agg(F.array_distinct(
            F.percentile_approx("predicted_demand", qs, 100000) if quantiles == "approx"
            else F.percentile(F.col("predicted_demand"), qs)).alias("edges"))
    # bin = number of edges below the value (at least 1): a fixed sum over the
    # at most n_bins + 1 edge positions, plain comparisons with no per-row lambda
    below = sum(F.when(F.try_element_at(F.col("_edges"), F.lit(j)) < F.col("predicted_demand"), F.lit(1))
                .otherwise(F.lit(0)) for j in range(1, n_bins + 2))
    binned = (pred.withColumn("_edges", edges.scalar())
              .withColumn("bin", F.greatest(F.lit(1), below))
              .groupBy("bin").agg(
                  F.avg("predicted_demand").alias("mean_predicted"),
                  F.avg("actual_demand").alias("mean_actual"),
                  F.count(F.lit(1)).alias("count")))
    bins = edges.select(F.posexplode("edges").alias("i", "bin_hi"), "edges").where(F.col("i") >= 1) \
        .select(F.col("i").alias("bin"), F.element_at("edges", F.col("i")).alias("bin_lo"), "bin_hi")
    return (bins.join(binned, on="bin", how="left")
            .select("bin", "bin_lo", "bin_hi", "mean_predicted", "mean_actual",
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                    (F.col("mean_actual") - F.col("mean_predicted")).alias("calibration_gap")))


def residual_summary(pred: DataFrame, quantiles: str = "distributed") -> DataFrame:
    """Nine residual statistics in one row (D6); std is the population std."""
    e, ae = F.col("error"), F.col("abs_error")
    base = [F.count(F.lit(1)).alias("count"), F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"),
            F.avg(ae).alias("mean_abs_error"), F.sqrt(F.avg("sq_error")).alias("rmse")]
    order = ["count", "mean_error", "std_error", "median_error", "mean_abs_error", "median_abs_error", "rmse",
             "p90_abs_error", "p95_abs_error"]
    if quantiles != "distributed":
        return pred.agg(*base, _quantile(e, 0.5, quantiles).alias("median_error"),
                        _quantile(ae, 0.5, quantiles).alias("median_abs_error"),
                        _quantile(ae, 0.9, quantiles).alias("p90_abs_error"),
                        _quantile(ae, 0.95, quantiles).alias("p95_abs_error")).select(*order)
    q = multi_quantile_columns(pred, [], {"median_error": ("error", 0.5), "median_abs_error": ("abs_error", 0.5),
                                          "p90_abs_error": ("abs_error", 0.9), "p95_abs_error": ("abs_error", 0.95)})
    return with_scalars(pred.agg(*base), q).select(*order)


CV_MEAN_COLUMNS = [
    ("cv_train_mae_mean", "train_mae"), ("cv_val_mae_mean", "val_mae"),
    ("cv_train_rmse_mean", "train_rmse"), ("cv_val_rmse_mean", "val_rmse"),
    ("cv_val_r2_mean", "val_r2"), ("cv_gap_mae_mean", "mae_gap"), ("cv_gap_rmse_mean", "rmse_gap"),
    ("cv_bias_mean", "bias"), ("cv_median_ae_mean", "median_ae"), ("cv_mape_mean", "mape"),
    ("cv_smape_mean", "smape"),
]


def cv_summary(cv_results: DataFrame) -> DataFrame:
    """Mean of 11 fold metrics and sample std of train/val MAE per model."""
    means = {out: F.avg(src).alias(out) for out, src in CV_MEAN_COLUMNS}
    return cv_results.groupBy("model_name").agg(
        means["cv_train_mae_mean"], F.stddev_samp("train_mae").alias("cv_train_mae_std"),
        means["cv_val_mae_mean"], F.stddev_samp("val_mae").alias("cv_val_mae_std"),
        *[means[o] for o, _ in CV_MEAN_COLUMNS if o not in ("cv_train_mae_mean", "cv_val_mae_mean")],
    )


def fold_metrics(pred_by_fold: DataFrame, model_name_col: str = "model_name") -> DataFrame:
    """CV result rows from fold predictions tagged (fold, role, model_name).

    One aggregate over (model, fold, role), pivoted on role into train_/val_
    columns: a single pass, no self-join of the metric table.
    """
    m = regression_metrics(pred_by_fold, group_cols=(model_name_col, "fold", "role"))
    wide = m.groupBy(model_name_col, "fold").pivot("role", ["train", "val"]).agg(
        *[F.first(c).alias(c) for c in METRIC_NAMES])
    return wide.select(
        "fold", model_name_col, "train_mae", "train_rmse", "train_r2", "val_mae", "val_rmse", "val_r2",
        (F.col("val_mae") - F.col("train_mae")).alias("mae_gap"),
        (F.col("val_rmse") - F.col("train_rmse")).alias("rmse_gap"),
        F.col("val_bias").alias("bias"), F.col("val_median_ae").alias("median_ae"),
        F.col("val_mape").alias("mape"), F.col("val_smape").alias("smape"),
    ).where(F.col("train_mae").isNotNull() & F.col("val_mae").isNotNull())


def comparison_row(metrics_by_split: DataFrame, model_name_col: str = "model_name") -> DataFrame:
    """(model, split, metrics) -> one wide row per model with train_/val_/test_ columns."""
    wide = metrics_by_split.groupBy(model_name_col).pivot("split", ["train", "val", "test"]).agg(
        *[F.first(c).alias(c) for c in METRIC_NAMES])
    cols = [model_name_col]
    for metric in METRIC_NAMES:
        for split in ("train", "val", "test"):
            cols.append(F.col(f"{split}_{metric}").alias(f"{split}_{metric}"))
    return wide.select(*cols)


def selection_table(comparison: DataFrame, cv_sum: DataFrame) -> DataFrame:
    """comparison LEFT JOIN cv summary + dense ranks.

    The comparison table has one row per candidate model (a handful), so
    the cv summary side is broadcast and the rank windows run on that tiny
    table.
    """
    j = comparison.join(F.broadcast(cv_sum), on="model_name", how="left")
    return j.withColumns({
        "holdout_val_rank": F.dense_rank().over(Window.orderBy("val_mae")),
        "cv_val_rank": F.dense_rank().over(Window.orderBy(F.col("cv_val_mae_mean").asc_nulls_last())),
    })


def best_model(selection: DataFrame) -> DataFrame:
    """First model by validation MAE, then CV MAE."""
    return selection.orderBy("val_mae", F.col("cv_val_mae_mean").asc_nulls_last(), "model_name").limit(1)


def generalisation(train_m: Column, val_m: Column) -> Column:
    return val_m - train_m


def overfitting_flag(train_mae: Column, val_mae: Column) -> Column:
    """val MAE > 1.10 x train MAE (H7)."""
    return val_mae > train_mae * F.lit(OVERFIT_RATIO)


def worst_cases(pred: DataFrame, k: int = 20, over: bool = True) -> DataFrame:
    """k most over- (error ascending) or under-predicted (error descending) rows (H8, F8)."""
    order = F.asc("error") if over else F.desc("error")
    return pred.orderBy(order, "pickup_zone", "pickup_date", "hour").limit(int(k))
