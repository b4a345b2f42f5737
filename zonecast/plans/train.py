"""Entry 2: panel -> model frame -> split -> CV + holdout comparison -> selection -> diagnostics (E, F, G, H).

Each fitted candidate is a distributed ``pyspark.ml`` job; the driver loops
over the fixed candidate list. Diagnostics are DataFrames written by
executors; the metrics document is one nested row written as JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.config import ALL_FEATURES
from zonecast.operators import metrics as M
from zonecast.operators import models as ML
from zonecast.operators.common import with_scalars
from zonecast.operators.lags import model_frame
from zonecast.sources.panel_store import date_bounds, rewritten
from zonecast.sources.sinks import save_model, write_document, write_table


def train_models(spark: SparkSession, panel: DataFrame, output_dir: str, names: list[str] | None = None,
                 cv_profile: str = "cv", final_profile: str = "final", overrides: dict | None = None) -> dict:
    names = names or ML.candidate_names()
    rows = rewritten(model_frame(panel), f"{output_dir}/model_rows")
    split_df = rows.withColumn("split", date_bounds(rows).label())  # filters on the part prune dates
    train = split_df.where(F.col("split") == "train").drop("split")

    cv_results = ML.walk_forward_cv(train, names, cv_profile, overrides=overrides)
    write_table(cv_results, f"{output_dir}/cross_validation_results")
    cv_results = spark.read.parquet(f"{output_dir}/cross_validation_results")
    cv_sum = M.cv_summary(cv_results)
    write_table(cv_sum, f"{output_dir}/cross_validation_summary")

    fitted = {n: ML.fit(n, split_df.where(F.col("split") == "train"), final_profile,
                        overrides=(overrides or {}).get(n)) for n in names}
    parts = [ML.holdout_metrics(m, split_df, n) for n, m in fitted.items()]
    by_split = parts[0]
    for p in parts[1:]:
        by_split = by_split.unionByName(p)
    comparison = M.comparison_row(by_split)
    write_table(comparison, f"{output_dir}/model_comparison")
    comparison = spark.read.parquet(f"{output_dir}/model_comparison")
    selection = M.selection_table(comparison, spark.read.parquet(f"{output_dir}/cross_validation_summary"))
    write_table(selection, f"{output_dir}/model_selection_summary")
    best = M.best_model(selection).first()
    best_name = best["model_name"]
    model = fitted[best_name]
    save_model(model, f"{output_dir}/model")

    scored = ML.predict(model, split_df)
    test_pred_all = scored.select("split", "demand", "predicted_demand")
    for part in ("train", "val", "test"):
        write_table(M.prediction_frame(scored.where(F.col("split") == part)), f"{output_dir}/predictions/{part}")
    test_pred = spark.read.parquet(f"{output_dir}/predictions/test")
    for key, name in (("hour", "error_by_hour"), ("pickup_zone", "error_by_zone"), ("is_peak_hour", "error_by_peak_hour")):
        write_table(M.error_summary(test_pred, key), f"{output_dir}/{name}")
    write_table(M.calibration(test_pred), f"{output_dir}/calibration_summary")
    resid = M.residual_summary(test_pred)
    write_table(M.worst_cases(test_pred, 20, True), f"{output_dir}/top_over_predictions")
    write_table(M.worst_cases(test_pred, 20, False), f"{output_dir}/top_under_predictions")

    imp, method = ML.native_importance(model), "native_importance_or_coefficients"
    if imp is None:
        method = "permutation_importance"
        imp = ML.permutation_importance(model, split_df.where(F.col("split") == "val"))
    write_table(imp, f"{output_dir}/feature_importance")
    write_document(spark.createDataFrame([(method,)], "method string"), f"{output_dir}/feature_importance_meta")

    row = comparison.where(F.col("model_name") == best_name).first().asDict()
    # one pass for the three part sizes (three rows come back)
    sizes = {r["split"]: r["n"] for r in split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    doc = spark.createDataFrame([{
        "best_model": best_name,
        "train_rows": sizes.get("train", 0),
        "val_rows": sizes.get("val", 0),
        "test_rows": sizes.get("test", 0),
        "generalization_gap_mae": row["val_mae"] - row["train_mae"],
        "generalization_gap_rmse": row["val_rmse"] - row["train_rmse"],
        "overfitting_suspected": bool(row["val_mae"] > row["train_mae"] * 1.10),
        "feature_columns": ALL_FEATURES,
        "feature_importance_method": method,
        "cross_validation_profile": "walk_forward_time_series",
        "cross_validation_splits": 3,
    }]).withColumn("residual_summary", resid.select(F.struct("*")).scalar())
    # comparison / selection tables have one row per candidate model (a handful)
    doc = doc.withColumns({
        "comparison": comparison.agg(F.collect_list(F.struct("*"))).scalar(),
        "selection_table": selection.agg(F.collect_list(F.struct("*"))).scalar()})
    doc = with_scalars(doc, M.regression_metrics(
        test_pred_all.withColumnRenamed("demand", "actual_demand"), group_cols=("split",))
        .agg(*[F.first(F.when(F.col("split") == s, F.struct(*M.METRIC_NAMES)), ignorenulls=True)
               .alias(f"selected_model_{n}_metrics")
               for s, n in (("train", "train"), ("val", "validation"), ("test", "test"))]))
    write_document(doc, f"{output_dir}/model_metrics")
    return {"best_model": best_name, "model": model}
