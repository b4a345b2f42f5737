"""Entry 3: model frame -> test part -> forecast -> demo case + batch simulation -> report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.config import PriceConfig
from zonecast.operators import models as ML
from zonecast.operators import pricing as PR
from zonecast.operators.forecast import rule_forecast
from zonecast.operators.common import with_scalars
from zonecast.operators.lags import model_frame
from zonecast.operators.splits import representative_row, seeded_sample
from zonecast.sources.panel_store import date_bounds, rewritten
from zonecast.sources.sinks import write_document, write_lines, write_table


def cv_lines(cv_summary: DataFrame, n: int = 5) -> DataFrame:
    """One array of the run summary's lines on the best cross-validated models (one row for each candidate model)."""
    ranked = F.array_sort(F.collect_list(F.struct("cv_val_mae_mean", "model_name", "cv_val_rmse_mean", "cv_val_r2_mean")))
    line = lambda m: F.format_string("%s  val MAE %.4f  val RMSE %.4f  val R2 %.4f", m.model_name, m.cv_val_mae_mean, m.cv_val_rmse_mean, m.cv_val_r2_mean)
    return cv_summary.agg(F.concat(F.array(F.lit(""), F.lit("Top CV models:")), F.transform(F.slice(ranked, 1, n), line)).alias("lines"))


def run_pricing(spark: SparkSession, panel: DataFrame, output_dir: str, model=None,
                cfg: PriceConfig = PriceConfig(), sample_size: int | None = None,
                model_name: str = "rule_forecast", model_summary: DataFrame | None = None,
                cv_summary: DataFrame | None = None) -> dict:
    """Price the demo row and every test row (or a seeded sample of ``sample_size``).

    ``model_summary`` (one row, the metrics document of the training plan) goes into the final report, and the
    first five models of ``cv_summary`` into the run summary.

    ``model`` is a fitted ``PipelineModel``; without one the rule forecaster,
    fitted on the training part, supplies the predicted demand.
    """
    rows = rewritten(model_frame(panel), f"{output_dir}/model_rows")
    split_df = rows.withColumn("split", date_bounds(rows).label())  # filters on the part prune dates
    test = split_df.where(F.col("split") == "test")
    if model is not None:
        scored = ML.predict(model, test)
    else:
        scored = rule_forecast(test, split_df.where(F.col("split") == "train"))

    demo = PR.optimize_prices(representative_row(scored), "predicted_demand", cfg, use_context=False)
    write_table(demo, f"{output_dir}/best_pricing_result")
    write_table(PR.revenue_curve(representative_row(scored), "predicted_demand", cfg, use_context=False),
                f"{output_dir}/revenue_curve")
    write_table(PR.sensitivity(representative_row(scored), "predicted_demand", cfg, use_context=False),
                f"{output_dir}/sensitivity_curve")
    sens = spark.read.parquet(f"{output_dir}/sensitivity_curve")
    write_table(PR.scenario_table(demo), f"{output_dir}/scenario_comparison")

    batch = seeded_sample(scored, sample_size) if sample_size else scored
    sim = PR.simulation_table(PR.optimize_prices(batch, "predicted_demand", cfg))
    write_table(sim, f"{output_dir}/pricing_simulation_summary")
    sim = spark.read.parquet(f"{output_dir}/pricing_simulation_summary")
    summary = PR.simulation_summary(sim)
    top5 = PR.top_uplift(sim, 5)

    d = spark.read.parquet(f"{output_dir}/best_pricing_result")
    report = (d.select(F.struct(F.lit(model_name).alias("model_type"),
                                F.lit("demand forecast + rule-based price search").alias("notes")).alias("project"),
                       F.struct(F.date_format("pickup_date", "yyyy-MM-dd'T'HH:mm:ss").alias("pickup_date"), "hour",
                                "pickup_zone", F.col("demand").cast("double").alias("actual_demand"),
                                "predicted_demand", "reference_price", "static_price", "static_revenue",
                                "optimal_price", F.col("expected_demand").alias("optimal_demand"),
                                F.col("expected_revenue").alias("optimal_revenue"), "uplift_percent").alias("demo_case"))
              .withColumns({
                  "pricing_sensitivity": sens.agg(F.collect_list(F.struct("*"))).scalar(),
                  "batch_summary": summary.select(F.struct("*")).scalar(),
                  "top_5_uplift_cases": top5.agg(F.collect_list(F.struct("*"))).scalar(),
                  "model_summary": F.create_map().cast("map<string,string>") if model_summary is None else model_summary.select(F.struct("*")).scalar()}))
    write_document(report, f"{output_dir}/final_report")

    top_cv = F.array().cast("array<string>") if cv_summary is None else cv_lines(cv_summary).scalar()
    lines = (with_scalars(d, summary).select(F.posexplode(F.concat(F.array(
        F.lit("RUN SUMMARY"), F.lit("=" * 50), F.concat(F.lit("Best model: "), F.lit(model_name)),
        F.format_string("Demo uplift: %.2f%%", "uplift_percent"),
        F.format_string("Average uplift: %.2f%%", "average_uplift_percent"),
        F.format_string("Average static revenue: %.2f", "average_static_revenue"),
        F.format_string("Average optimal revenue: %.2f", "average_optimal_revenue")), top_cv)).alias("line_no", "value")))
    write_lines(lines, f"{output_dir}/run_summary")
    return {"simulation": sim, "summary": summary}
