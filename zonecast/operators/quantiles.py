"""Exact grouped quantiles without putting a group in one task.

Spark's exact ``percentile`` merges a value->count map per group in one task,
so its memory is the number of distinct values in the group. That is fine
for counts (demand), but not for a continuous column (forecast errors) when
one group holds a third of a 100 TB table. This operator gives the same
values (linear interpolation between the two order statistics around
``q * (n - 1)``), with every step bounded by a partition:

1. ``(group, value) -> count``: partial aggregation; a hot group's distinct
   values are hash-spread over many tasks.
2. Range-partition those pairs by (group, value) and number the partitions.
   A hot group spans many consecutive partitions. The result is persisted
   (memory and disk) while the operator runs: both later branches read the
   same blocks, and a lost block is recomputed from the same shuffle and
   partitioner, so partition numbers stay consistent. The operator is eager:
   its small result is checkpointed and the persisted pairs are released.
3. Counts per (group, partition) form a table of at most partitions +
   groups rows. Its prefix sums give each partition's first rank in its
   group and each group's size.
4. Target ranks ``floor(q(n-1))`` and ``ceil(q(n-1))`` are located on that
   small table: (group, partition) pairs.
5. Rows are joined to the targets on (group, partition), an equi-join whose
   keys each hold one range partition, and the two order statistics are
   interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark import StorageLevel


def _order_statistics(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                      num_partitions: int | None, count_col: str | None = None) -> tuple[DataFrame, list[str], DataFrame]:
    """Rows (group..., q, side, _pos, _v): the lower/upper order statistic around q(n-1) per group.

    With ``count_col`` a row stands for so many equal values.
    """
    g = list(group_cols) or ["_all"]
    src = df if group_cols else df.withColumn("_all", F.lit(0))
    v = F.col(value_col).cast("double")
    n = F.lit(1) if count_col is None else F.col(count_col)
    base = src.select(*g, v.alias("_v"), n.cast("long").alias("_c")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = base.groupBy(*g, "_v").agg(F.sum("_c").alias("_c"))
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (counts.repartitionByRange(parts, *g, "_v").withColumn("_pid", F.spark_partition_id())
              .persist(StorageLevel.MEMORY_AND_DISK))

    per_part = ranged.groupBy(*g, "_pid").agg(F.sum("_c").alias("_pc"))
    wg = Window.partitionBy(*g).orderBy("_pid")
    prefix = per_part.select(
        *g, "_pid", "_pc",
        F.coalesce(F.sum("_pc").over(wg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_pc").over(Window.partitionBy(*g)).alias("_n"))
    # each prefix row checks which target ranks fall inside its slice: no join needed
    qs = F.array(*[F.lit(float(q)) for q in probs])
    located = (prefix.select(*g, "_pid", "_pc", "_before", "_n", F.explode(qs).alias("q"))
               .withColumn("_pos", F.col("q") * (F.col("_n") - 1).cast("double"))
               .select(*g, "_pid", "_pc", "_before", "q", "_pos", F.explode(F.array(
                   F.struct(F.lit("lo").alias("side"), F.floor("_pos").cast("long").alias("r")),
                   F.struct(F.lit("hi").alias("side"), F.ceil("_pos").cast("long").alias("r")))).alias("_t"))
               .select(*g, "_pid", "_before", "_pc", "q", "_pos", "_t.side", "_t.r")
               .where((F.col("r") >= F.col("_before")) & (F.col("r") < F.col("_before") + F.col("_pc")))
               .drop("_pc"))

    # ranks inside each (group, partition) slice. The located table has
    # 2 x groups x probabilities rows; it is not force-broadcast (the group
    # count is the caller's): AQE broadcasts it after its runtime size check,
    # else the join reuses the window's (group, partition) hash partitioning,
    # whose keys each hold one range slice.
    wl = Window.partitionBy(*g, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # only the slices that hold a target rank are shuffled, sorted and numbered
    wanted = located.select(*g, "_pid").distinct()
    rows = ranged.join(wanted, on=g + ["_pid"], how="left_semi").withColumn("_cum", F.sum("_c").over(wl))
    hits = (rows.join(located, on=g + ["_pid"])
            .where((F.col("r") >= F.col("_before") + F.col("_cum") - F.col("_c"))
                   & (F.col("r") < F.col("_before") + F.col("_cum")))
            .select(*g, "q", "side", "_pos", "_v"))
    return hits, g, ranged


def _finish(result: DataFrame, ranged: DataFrame) -> DataFrame:
    """Checkpoint the small result (groups x probabilities rows), then release the persisted pairs.

    The operator is eager: the big intermediate lives only while it runs.
    """
    from zonecast.operators.common import materialize

    try:
        return materialize(result)
    finally:
        ranged.unpersist()


def _interpolate(lo: Column, hi: Column, pos: Column) -> Column:
    return lo + (hi - lo) * (pos - F.floor(pos))


def exact_quantiles(df: DataFrame, group_cols: list[str] | tuple[str, ...], value_col: str,
                    probs: list[float], num_partitions: int | None = None) -> DataFrame:
    """(group_cols..., q, value) for every group and probability; NULL/NaN values are ignored."""
    hits, g, ranged = _order_statistics(df, list(group_cols), value_col, probs, num_partitions)
    out = hits.groupBy(*g, "q").agg(
        F.max(F.when(F.col("side") == "lo", F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("_v"))).alias("_hi"),
        F.max("_pos").alias("_pos"))
    res = out.select(*g, "q", _interpolate(F.col("_lo"), F.col("_hi"), F.col("_pos")).alias("value"))
    return _finish(res.drop("_all") if not group_cols else res, ranged)


def quantile_columns(df: DataFrame, group_cols: list[str] | tuple[str, ...], value_col: str,
                     named_probs: dict[str, float], num_partitions: int | None = None) -> DataFrame:
    """Wide form: one column per named probability, one row per group."""
    return multi_quantile_columns(df, group_cols, {name: (value_col, p) for name, p in named_probs.items()},
                                  num_partitions)


def multi_quantile_columns(df: DataFrame, group_cols: list[str] | tuple[str, ...],
                           named: dict[str, tuple[str, float]], num_partitions: int | None = None) -> DataFrame:
    """Several (column, probability) quantiles per group in one pass, one row per group.

    The value columns are stacked into (column name, value) rows and the
    column name joins the group key, so one run serves them all; the final
    aggregate picks each (column, probability) pair into its own column.
    """
    cols = sorted({c for c, _ in named.values()})
    probs = sorted({float(p) for _, p in named.values()})
    hits, _, ranged = _order_statistics(_stacked(df, group_cols, cols), list(group_cols) + ["_col"], "_val", probs,
                                        num_partitions)
    return _wide(hits, ranged, group_cols, named)


def rollup_quantile_columns(df: DataFrame, group_col: str, named: dict[str, tuple[str, float]],
                            num_partitions: int | None = None) -> DataFrame:
    """``multi_quantile_columns`` by one column (text or whole numbers) and, in the row with ``_total`` = 1 (0 else)
    and no group, over all rows. Rows without a group count in the total only.

    Rows are reduced to (group, column, value, n) once; the counts of all rows are sums of the groups', so the
    total level costs no second pass and no second copy of the rows.
    """
    cols = sorted({c for c, _ in named.values()})
    probs = sorted({float(p) for _, p in named.values()})
    counts = _stacked(df, [group_col], cols).groupBy(group_col, "_col", "_val").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy("_col", "_val").agg(F.sum("_n").alias("_n"))
    # the groups are joined on, so the total has a text as its key, not NULL
    both = (counts.where(F.col(group_col).isNotNull())
            .select(F.col(group_col).cast("string").alias("_key"), F.lit(0).alias("_total"), "_col", "_val", "_n")
            .unionByName(total.select(F.lit("").alias("_key"), F.lit(1).alias("_total"), "_col", "_val", "_n")))
    hits, _, ranged = _order_statistics(both, ["_key", "_total", "_col"], "_val", probs, num_partitions, count_col="_n")
    group = F.when(F.col("_total") == 0, F.col("_key")).cast(df.schema[group_col].dataType).alias(group_col)
    return _wide(hits, ranged, ["_key", "_total"], named).select(group, "_total", *named)


def _stacked(df: DataFrame, group_cols, cols: list[str]) -> DataFrame:
    """(group_cols..., _col, _val): a row for each value column."""
    return df.select(*group_cols, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c in cols])).alias("_s")) \
        .select(*group_cols, "_s._col", "_s._val")


def _wide(hits: DataFrame, ranged: DataFrame, group_cols, named: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per group with a column for each named quantile."""

    def pick(c, p, side):
        return F.max(F.when((F.col("_col") == F.lit(c)) & (F.col("q") == F.lit(float(p)))
                            & (F.col("side") == side), F.col("_v")))

    aggs = []
    for name, (c, p) in named.items():
        aggs += [pick(c, p, "lo").alias(f"{name}__lo"), pick(c, p, "hi").alias(f"{name}__hi"),
                 F.max(F.when((F.col("_col") == F.lit(c)) & (F.col("q") == F.lit(float(p))), F.col("_pos")))
                 .alias(f"{name}__pos")]
    wide = hits.groupBy(*group_cols).agg(*aggs) if group_cols else hits.agg(*aggs)
    return _finish(wide.select(*group_cols, *[
        _interpolate(F.col(f"{n}__lo"), F.col(f"{n}__hi"), F.col(f"{n}__pos")).alias(n) for n in named]), ranged)
