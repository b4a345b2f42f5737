"""Price optimisation over DataFrames.

All of these are projections of ``zonecast.functions.pricing``: the search
runs inside each row, so pricing every panel row costs one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.config import PriceConfig, SENSITIVITY_ELASTICITIES
from zonecast.functions import pricing as P
from zonecast.functions.text import price_explanation


def _context(df: DataFrame, use_context: bool) -> dict:
    if not use_context:
        return {}
    ctx = {}
    for key, col in (("peak", "is_peak_hour"), ("weekend", "is_weekend"), ("volume", "zone_trip_volume")):
        if col in df.columns:
            ctx[key] = F.col(col)
    return ctx


def optimize_prices(df: DataFrame, demand_col: str = "predicted_demand", cfg: PriceConfig = PriceConfig(),
                    ref_col: str | None = None, use_context: bool = True,
                    elasticity_col: str | None = None) -> DataFrame:
    """Add ``reference_price`` and the six pricing result columns to every row.

    ``ref_col`` names a reference price column; by default the first
    positive observed fare column is used. ``use_context=False`` applies only
    the demand rules of the elasticity (the source's demo path).
    """
    ref = F.col(ref_col) if ref_col else P.reference_price(df.columns, cfg)
    out = df.withColumn("reference_price", ref)
    el = F.col(elasticity_col) if elasticity_col else None
    res = P.price_search(F.col(demand_col).cast("double"), F.col("reference_price"), cfg,
                         elasticity=el, **_context(df, use_context))
    # ``inline`` of a one-element array expands the result struct once per row;
    # six field extractions of the struct would each be inlined with the whole search
    return out.select("*", F.inline(F.array(res)))


def revenue_curve(df: DataFrame, demand_col: str = "predicted_demand", cfg: PriceConfig = PriceConfig(),
                  ref_col: str | None = None, use_context: bool = True,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (input row, grid price): price, adjusted_demand, revenue, objective_score (I8)."""
    ref = F.col(ref_col) if ref_col else P.reference_price(df.columns, cfg)
    pts = P.grid_points(F.col(demand_col).cast("double"), ref, cfg, **_context(df, use_context))
    return (df.select(*keep, F.posexplode(pts).alias("point", "_p"))
            .select(*keep, "point",
                    F.col("_p.price").alias("price"),
                    F.col("_p.adjusted_demand").alias("adjusted_demand"),
                    F.col("_p.revenue").alias("revenue"),
                    F.col("_p.score").alias("objective_score")))


def sensitivity(df: DataFrame, demand_col: str = "predicted_demand", cfg: PriceConfig = PriceConfig(),
                ref_col: str | None = None, use_context: bool = True,
                elasticities=SENSITIVITY_ELASTICITIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Optimum under each elasticity assumption.

    The elasticity list is a fixed literal array exploded per row: a bounded
    generator instead of a join.
    """
    arr = F.array(*[F.lit(float(e)) for e in elasticities])
    base = df.withColumn("elasticity", F.explode(arr))
    priced = optimize_prices(base, demand_col, cfg, ref_col, use_context, elasticity_col="elasticity")
    return priced.select(*keep, "elasticity", "optimal_price", "expected_demand", "expected_revenue",
                         "static_price", "static_revenue", "uplift_percent")


def explain(df: DataFrame) -> DataFrame:
    """Add the explanation text of each pricing result."""
    return df.withColumn("explanation", price_explanation(
        F.col("optimal_price"), F.col("expected_demand"), F.col("expected_revenue"), F.col("uplift_percent")))


def scenario_table(priced: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Static vs dynamic rows per priced row (I14, F10): a two-row ``stack``."""
    return priced.select(*keep, F.expr(
        "stack(2, 'Static pricing', static_price, static_revenue, "
        "'Dynamic pricing', optimal_price, expected_revenue) AS (scenario, price, revenue)"))


def simulation_table(priced: DataFrame) -> DataFrame:
    """Batch simulation rows in the source's layout."""
    from zonecast.functions.calendar import iso_text

    return priced.select(
        iso_text(F.col("pickup_date").cast("timestamp_ntz")).alias("pickup_date"),
        F.col("hour").cast("int").alias("hour"),
        F.col("pickup_zone"),
        F.col("demand").cast("double").alias("actual_demand"),
        F.col("predicted_demand").cast("double").alias("predicted_demand"),
        "static_price", "static_revenue", "optimal_price",
        F.col("expected_revenue").alias("optimal_revenue"),
        "uplift_percent",
    )


def simulation_summary(sim: DataFrame) -> DataFrame:
    """Batch averages."""
    return sim.agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.avg("predicted_demand").alias("average_predicted_demand"),
        F.avg("static_revenue").alias("average_static_revenue"),
        F.avg("optimal_revenue").alias("average_optimal_revenue"),
        F.avg("uplift_percent").alias("average_uplift_percent"),
    )


def top_uplift(sim: DataFrame, k: int = 5) -> DataFrame:
    """Top-k rows by uplift, keys as tie-break."""
    return sim.orderBy(F.desc("uplift_percent"), "pickup_zone", "pickup_date", "hour").limit(int(k))
