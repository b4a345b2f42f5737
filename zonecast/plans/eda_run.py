"""EDA and diagnostic tables: the data behind every chart of the source.

No pictures are drawn; each chart's aggregate is written as a table, and
the EDA summary as text lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.config import PANEL_COLUMNS
from zonecast.operators import eda as EDA
from zonecast.operators import metrics as M
from zonecast.operators.common import with_scalars
from zonecast.sources.sinks import write_lines, write_table

NUMERIC_PANEL_COLUMNS = [c for c in PANEL_COLUMNS if c not in ("pickup_date", "pickup_zone")]


def eda_summary_lines(panel: DataFrame, top_k: int = 5) -> DataFrame:
    """EDA summary report as (line_no, value) rows: size, demand statistics, top zones."""
    d = EDA.describe(panel, "demand")
    # the array itself is sorted: collect_list keeps no order of its own
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("demand")).alias("k"), "pickup_zone", "demand")))
    top = EDA.top_zones(panel, top_k).agg(F.transform(ranked, lambda r: F.format_string("%s  %d", r.pickup_zone, r.demand)).alias("tz"))
    n = panel.agg(F.count(F.lit(1)).alias("rows"))
    header = F.array(
        F.lit("EDA SUMMARY"), F.lit("=" * 50),
        F.format_string("Rows: %d", "rows"), F.lit(f"Columns: {len(panel.columns)}"), F.lit(""),
        F.lit("Demand Statistics:"),
        F.format_string("count %.6f", F.col("count").cast("double")), F.format_string("mean %.6f", "mean"),
        F.format_string("std %.6f", "std"), F.format_string("min %.6f", "min"),
        F.format_string("25%% %.6f", "p25"), F.format_string("50%% %.6f", "p50"),
        F.format_string("75%% %.6f", "p75"), F.format_string("max %.6f", "max"), F.lit(""),
        F.lit(f"Top {top_k} Zones by Total Demand:"))
    return (with_scalars(with_scalars(n, d), top)
            .select(F.posexplode(F.concat(header, F.col("tz"))).alias("line_no", "value")))


def _sampled(df: DataFrame, n: int | None) -> DataFrame:
    """A seeded sample for a picture; all rows unless a number is asked for."""
    from zonecast.operators.splits import seeded_sample

    return df if n is None else seeded_sample(df, n)


def write_eda_tables(spark: SparkSession, panel: DataFrame, out: str, sample_rows: int | None = None) -> None:
    """Distribution, one-key means, top zones, correlation, scatter samples, heatmap, summary."""
    write_table(EDA.histogram(panel, "demand", 50), f"{out}/demand_histogram")
    write_table(EDA.kde_curve(panel, "demand", 200), f"{out}/demand_kde")
    write_table(EDA.mean_by_keys(panel), f"{out}/mean_demand_by_key")
    write_table(EDA.top_zones(panel, 15), f"{out}/top_zones")
    write_table(EDA.correlation_long(panel, NUMERIC_PANEL_COLUMNS), f"{out}/correlation")
    write_table(_sampled(panel, sample_rows).select("demand", "avg_trip_distance", "avg_fare_amount",
                                                  "avg_duration_min", "avg_speed_kph"), f"{out}/scatter_sample")
    write_table(EDA.weekday_hour_pivot(panel), f"{out}/hour_weekday_heatmap")
    write_lines(eda_summary_lines(panel), f"{out}/eda_summary")


def write_diagnostic_tables(spark: SparkSession, selection: DataFrame, test_pred: DataFrame,
                            importance: DataFrame | None, out: str, sample_rows: int | None = None) -> None:
    """Model comparison melts, gaps, error by key, residuals, calibration, importances."""
    write_table(EDA.melt_metric(selection, "mae"), f"{out}/model_comparison_mae")
    write_table(EDA.melt_metric(selection, "rmse"), f"{out}/model_comparison_rmse")
    write_table(selection.select("model_name", (F.col("val_mae") - F.col("train_mae")).alias("mae_gap")),
                f"{out}/train_val_gap")
    write_table(_sampled(test_pred, sample_rows).select("actual_demand", "predicted_demand", "error"),
                f"{out}/actual_vs_predicted_sample")
    write_table(EDA.histogram(test_pred, "error", 50), f"{out}/residual_histogram")
    write_table(EDA.binned_density(test_pred, "error", 200), f"{out}/residual_density")
    write_table(EDA.mae_by(test_pred, "hour"), f"{out}/error_by_hour")
    write_table(EDA.top_mae_zones(test_pred, 15), f"{out}/error_by_zone_top15")
    write_table(EDA.mae_by(test_pred, "is_peak_hour"), f"{out}/error_peak_vs_nonpeak")
    write_table(M.calibration(test_pred).select("bin", "mean_predicted", "mean_actual"), f"{out}/calibration_plot")
    if importance is not None:
        write_table(importance.orderBy(F.desc(importance.columns[1]), "feature").limit(15), f"{out}/feature_importance_top15")
