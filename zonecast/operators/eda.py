"""Exploratory and diagnostic aggregates.

These are the numbers behind the source's charts; no pictures are drawn.
Scalars that later stages need (min, max, counts, edges) are one-row
aggregates read as scalar subqueries, never joins or global windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast.operators.common import scalar_row, with_scalars

# fixed values: the one-key mean-demand breakdowns, in chart order
MEAN_DEMAND_KEYS = ["hour", "day_of_week", "is_weekend", "is_peak_hour", "month",
                    "is_month_start", "is_month_end", "is_high_travel_period"]


def mean_by_keys(panel: DataFrame, keys=MEAN_DEMAND_KEYS, value: str = "demand") -> DataFrame:
    """Mean ``value`` by each key separately, in one GROUPING SETS pass.

    Output is long: (dimension, key_value, mean_demand, rows). One scan, one
    Expand, one aggregation instead of one job per key.
    """
    sets = [[k] for k in keys]
    g = panel.groupingSets(sets, *keys).agg(
        F.avg(value).alias("mean_demand"), F.count(F.lit(1)).alias("rows"),
        *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("int")
    for k in keys:
        dim = F.when(F.col(f"_g_{k}") == 0, F.lit(k)).otherwise(dim)
        val = F.when(F.col(f"_g_{k}") == 0, F.col(k).cast("int")).otherwise(val)
    return g.select(dim.alias("dimension"), val.alias("key_value"), "mean_demand", "rows")


def top_zones(panel: DataFrame, k: int = 15) -> DataFrame:
    """Zones by total demand, top k, ties by zone name."""
    return (panel.groupBy("pickup_zone").agg(F.sum("demand").alias("demand"))
            .orderBy(F.desc("demand"), "pickup_zone").limit(int(k)))


def weekday_hour_pivot(panel: DataFrame, value: str = "demand") -> DataFrame:
    """Mean demand, rows = day_of_week, columns hour_0..hour_23.

    The pivot values are listed, so Spark skips the distinct-values job.
    """
    p = panel.groupBy("day_of_week").pivot("hour", list(range(24))).agg(F.avg(value))
    return p.select("day_of_week", *[F.col(str(h)).alias(f"hour_{h}") for h in range(24)])


def numeric_columns(df: DataFrame) -> list[str]:
    num = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num)]


def _pair_sums(cols: list[str]):
    """mapInPandas function: per-task sums over the rows where both columns of a pair are present.

    With z the shifted values (0 where missing) and m the 0/1 presence, a task emits
    m'm (counts), z'm (sums), (z^2)'m (squares) and z'z (products), each k x k, and
    each column's range.
    """
    import numpy as np
    import pandas as pd

    k = len(cols)

    def fn(batches):
        sums = np.zeros((4, k, k))
        lo, hi = np.full(k, np.inf), np.full(k, -np.inf)
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64")
            m = ~np.isnan(x)
            z, m = np.where(m, x, 0.0), m.astype("float64")
            sums += np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
            lo, hi = np.minimum(lo, np.where(m > 0, x, np.inf).min(axis=0, initial=np.inf)), np.maximum(hi, np.where(m > 0, x, -np.inf).max(axis=0, initial=-np.inf))
        yield pd.DataFrame({"sums": [np.concatenate([sums.ravel(), hi, -lo]).tolist()]})

    return fn


def correlation_long(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair as (col_a, col_b, r).

    Pairwise deletion: a pair uses the rows where both its columns are present. A first
    aggregate gives each column's mean, which is subtracted for stability (a scalar
    subquery); one pass then reduces every task's rows to four k x k matrices of sums and
    2 k extremes, which Spark adds up by position (tasks x 4 k^2 short rows, summed before
    the shuffle). A constant column, or a pair without two common rows, gives NULL.
    """
    cols = cols or numeric_columns(df)
    k = len(cols)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    x = x.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    means = scalar_row(x.agg(*[F.avg(c).alias(c) for c in cols]))
    parts = x.select(*[(F.col(c) - means.getField(c)).alias(c) for c in cols]).mapInPandas(_pair_sums(cols), "sums array<double>")
    totals = parts.select(F.posexplode("sums").alias("p", "x")).groupBy("p").agg(
        F.when(F.col("p") < 4 * k * k, F.sum("x")).otherwise(F.max("x")).alias("x"))
    one = totals.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda r: r["x"]).alias("s"))
    cell = one.select("s", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("c")).where(F.size("s") > 0)
    i, j = (F.col("c") / k).cast("int"), (F.col("c") % k).cast("int")
    at = lambda part, a, b: F.col("s")[F.lit(part * k * k) + a * k + b]
    varies = lambda a: F.col("s")[F.lit(4 * k * k) + a] + F.col("s")[F.lit(4 * k * k + k) + a] > 0
    n = at(0, i, j)
    cov = at(3, i, j) - at(1, i, j) * at(1, j, i) / n
    var_i, var_j = at(2, i, j) - at(1, i, j) * at(1, i, j) / n, at(2, j, i) - at(1, j, i) * at(1, j, i) / n
    names = F.array(*[F.lit(c) for c in cols])
    ok = (n > 1) & varies(i) & varies(j) & (var_i > 0) & (var_j > 0)
    return cell.select(names[i].alias("col_a"), names[j].alias("col_b"), F.when(ok, cov / F.sqrt(var_i * var_j)).alias("r"))


def describe(df: DataFrame, col: str = "demand", quantiles: str = "distributed") -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max.

    ``quantiles="distributed"`` uses the range-partitioned exact operator;
    ``"map"`` Spark's ``percentile`` (bounded when the column has few
    distinct values, e.g. integer demand).
    """
    x = F.col(col).cast("double")
    base = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max")]
    order = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    if quantiles == "distributed":
        from zonecast.operators.quantiles import quantile_columns

        q = quantile_columns(df, [], col, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
        return with_scalars(df.agg(*base), q).select(*order)
    return df.agg(*base, F.percentile(x, 0.25).alias("p25"), F.median(x).alias("p50"),
                  F.percentile(x, 0.75).alias("p75")).select(*order)


def histogram(df: DataFrame, col: str = "demand", bins: int = 50) -> DataFrame:
    """Equal-width histogram from min to max, last bin closed.

    Edges are ``min + i * ((max - min) / bins)`` with the last edge = max; a
    value goes to the bin of the last interior edge <= it. Empty bins are
    kept with count 0.
    """
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    edges = rng.select(F.transform(F.sequence(F.lit(0), F.lit(bins)),
                                   lambda i: F.when(i == bins, F.col("hi"))
                                   .otherwise(F.col("lo") + i.cast("double") * ((F.col("hi") - F.col("lo")) / F.lit(float(bins)))))
                       .alias("edges"))
    # bin = number of interior edges <= x, found without a per-row array scan:
    # an arithmetic estimate, then one comparison with the computed edge on
    # each side (the estimate is off by at most one)
    r = scalar_row(rng)
    lo, hi = r.getField("lo"), r.getField("hi")
    width = (hi - lo) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return lo + i.cast("double") * width

    last = F.lit(bins - 1)
    est = F.least(F.greatest(F.floor((F.col("_x") - lo) / width).cast("int"), F.lit(0)), last)
    fixed = (F.when((F.col("_est") > 0) & (F.col("_x") < edge(F.col("_est"))), F.col("_est") - 1)
             .when((F.col("_est") < last) & (F.col("_x") >= edge(F.col("_est") + 1)), F.col("_est") + 1)
             .otherwise(F.col("_est")))
    counts = (df.select(x.alias("_x")).where(F.col("_x").isNotNull())
              .select("_x", F.when(hi > lo, est).otherwise(last).alias("_est"))
              .select(fixed.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    all_bins = edges.select(F.posexplode(F.slice("edges", 1, bins)).alias("bin", "bin_lo"), "edges") \
        .select("bin", "bin_lo", F.element_at("edges", F.col("bin") + 2).alias("bin_hi"))
    return (all_bins.join(counts, on="bin", how="left")
            .select("bin", "bin_lo", "bin_hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def kde_curve(df: DataFrame, col: str = "demand", grid: int = 200, resolution: float | None = None) -> DataFrame:
    """Gaussian kernel density on ``grid`` points from min to max.

    Scott's bandwidth (sample std * n^-1/5). The data are first reduced to
    (value, count) by a partial aggregation; each distinct value then adds
    its kernel to the fixed grid, a bounded per-row generator. Exact when
    ``resolution`` is None (the work is distinct values x grid points; fine
    for counts). For a continuous column at scale, ``resolution`` snaps
    values to multiples of it first: at most range / resolution distinct
    kernels, an approximation with error bounded by resolution / bandwidth.
    """
    x = F.col(col).cast("double")
    stats = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi")) \
        .withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    v = x if resolution is None else F.rint(x / F.lit(float(resolution))) * F.lit(float(resolution))
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("w"))
    norm = F.lit(1.0 / math.sqrt(2 * math.pi))
    pts = (with_scalars(vals, stats)
           .select("v", "w", "n", "bw", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g")))
    gx = F.col("lo") + F.col("g").cast("double") * ((F.col("hi") - F.col("lo")) / F.lit(float(grid - 1)))
    z = (gx - F.col("v")) / F.col("bw")
    contrib = F.col("w").cast("double") * F.exp(F.lit(-0.5) * z * z)
    return (pts.select("g", gx.alias("x"), "n", "bw", contrib.alias("c"))
            .groupBy("g", "x", "n", "bw").agg(F.sum("c").alias("s"))
            .select(F.col("g").cast("int").alias("g"), "x",
                    (F.col("s") * norm / (F.col("n").cast("double") * F.col("bw"))).alias("density")))


def binned_density(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian density of a continuous column on ``grid`` points from min to max, by linear binning.

    A row's weight is dealt to the two grid points around it in proportion to its distances, which is one partial
    aggregation to ``grid`` rows; the kernel is applied between grid points. The work is rows + grid^2, whatever
    the number of distinct values; the error is of second order in grid step / bandwidth. Scott's bandwidth, as in
    ``kde_curve``. NULL and NaN are left out; a column without two different values has no density (no rows).
    """
    x = F.col(col).cast("double")
    rows = df.select(x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    last = F.lit(float(grid - 1))
    stats = rows.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")) \
        .select("lo", "hi", ((F.col("hi") - F.col("lo")) / last).alias("step"), "n",
                (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))
    at = (F.col("v") - F.col("lo")) / F.col("step")
    dealt = (with_scalars(rows, stats.select("lo", "hi", "step")).where(F.col("hi") > F.col("lo")).select(at.alias("at"))
             .select("at", F.least(F.floor("at").cast("int"), F.lit(grid - 2)).alias("b"))
             .groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("at") - F.col("b")).alias("f")))
    weights = dealt.select(F.explode(F.array(
        F.struct(F.col("b").alias("b"), (F.col("n") - F.col("f")).alias("w")),
        F.struct((F.col("b") + 1).alias("b"), F.col("f").alias("w")))).alias("p")).select("p.b", "p.w")
    points = with_scalars(weights, stats).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    z = (F.col("g") - F.col("b")) * F.col("step") / F.col("bw")
    norm = F.lit(1.0 / math.sqrt(2 * math.pi))
    return (points.groupBy("g", "lo", "step", "n", "bw").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("s"))
            .select("g", (F.col("lo") + F.col("g") * F.col("step")).alias("x"),
                    (F.col("s") * norm / (F.col("n") * F.col("bw"))).alias("density")))


def mae_by(pred: DataFrame, key: str) -> DataFrame:
    """Mean absolute error by one key."""
    return pred.groupBy(key).agg(F.avg("abs_error").alias("abs_error"))


def top_mae_zones(pred: DataFrame, k: int = 15) -> DataFrame:
    return mae_by(pred, "pickup_zone").orderBy(F.desc("abs_error"), "pickup_zone").limit(int(k))


def melt_metric(comparison: DataFrame, metric: str) -> DataFrame:
    """Wide model comparison -> (model_name, split, <metric>) with split title-cased."""
    from zonecast.functions.text import strip_suffix_title

    cols = [f"train_{metric}", f"val_{metric}", f"test_{metric}"]
    long = comparison.unpivot(["model_name"], cols, "split", metric)
    return long.withColumn("split", strip_suffix_title(F.col("split"), f"_{metric}"))
