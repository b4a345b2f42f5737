"""Shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's ``spark.checkpoint.dir``.

    Used where a small derived table (e.g. the aggregated panel) is read
    more than once: later branches read the checkpoint instead of re-running
    the scan and shuffle of the raw data, and a lost executor does not force
    a recompute from raw trips.

    Writing the checkpoint runs the plan a second time after the counting
    job. Every plan materialized here ends in a shuffle (aggregate, window or
    range repartition), so that second run reads the shuffle output instead
    of rescanning the source.
    """
    from zonecast.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scalar_row(one_row: DataFrame) -> Column:
    """The single row of a one-row aggregate as a struct-valued scalar subquery.

    The aggregate runs once and its value is inlined into the consuming
    projection; nothing is joined. ``one_row`` must yield exactly one row
    (a global ``agg`` does).
    """
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_row")).scalar()


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` plus every column of the one-row aggregate ``one_row`` (scalar subquery, no join)."""
    row = scalar_row(one_row)
    return df.withColumns({c: row.getField(c) for c in one_row.columns})


def row_numbers(df: DataFrame, order: list, out: str = "row_no", group_cols: list[str] | tuple[str, ...] = (),
                num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (within ``group_cols``), with no one-task window.

    The rows are range-partitioned on (group, order), so a large group spans
    many consecutive partitions, sorted inside each partition and tagged
    there with ``monotonically_increasing_id`` (partition id in the high
    bits, position in the low bits), all in one stage. That is checkpointed
    so both branches below read the same ids. A slice's offset is the row
    count of the group's earlier slices, from a table of at most
    partitions + groups rows; no window runs over the rows themselves.
    ``order`` should be a total order; ties are numbered in an arbitrary but
    fixed way.
    """
    from pyspark.sql import Window

    g = list(group_cols)
    # computed order keys become columns; named ones are used as they are
    computed = {f"_ord{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    keyed = df.withColumns(computed) if computed else df
    okeys = [c if isinstance(c, str) else f"_ord{i}" for i, c in enumerate(order)]
    parts = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(keyed.repartitionByRange(parts, *g, *okeys).sortWithinPartitions(*g, *okeys)
                         .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    slices = ranged.groupBy(*g, "_pid").agg(F.count(F.lit(1)).alias("_pn"), F.min("_mid").alias("_first"))
    before = F.sum("_pn").over(Window.partitionBy(*g).orderBy("_pid")
                               .rowsBetween(Window.unboundedPreceding, -1))
    # one row per (group, partition) slice: at most partitions + groups rows.
    # Without groups that is the partition count, so it is broadcast; with
    # groups the count is the caller's, and AQE broadcasts it after its
    # runtime size check or falls back to a shuffle join.
    offsets = slices.select(*g, "_pid", (F.coalesce(before, F.lit(0)) - F.col("_first") + F.lit(1)).alias("_shift"))
    return (ranged.join(offsets if g else F.broadcast(offsets), on=g + ["_pid"])
            .withColumn(out, F.col("_mid") + F.col("_shift"))
            .drop("_pid", "_mid", "_shift", *computed))
