"""Sinks (A4, A5, A7, A9, A10).

Everything is written by executors into a shared location; nothing is
collected to the driver to be written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    """Tabular sink (A4); ``partition_by=['pickup_date']`` enables partition pruning on reads."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def read_table(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """Read back what ``write_table`` wrote, with the schema that it was written with."""
    r = spark.read.format(fmt).schema(schema)
    return (r.option("header", True) if fmt == "csv" else r).load(path)


def write_document(row_df: DataFrame, path: str) -> None:
    """JSON sink of a one-row (possibly nested) DataFrame."""
    row_df.coalesce(1).write.mode("overwrite").json(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """Text report sink; ``lines`` has one string column ``value`` and an order column ``line_no`` (A10)."""
    lines.orderBy("line_no").select("value").coalesce(1).write.mode("overwrite").text(path)


def downcast(df: DataFrame, float_cols: list[str] = (), small_int_cols: list[str] = ()) -> DataFrame:
    """Explicit narrow sink schema (A9): doubles to float, small ints to tinyint."""
    out = df
    for c in float_cols:
        out = out.withColumn(c, F.col(c).cast("float"))
    for c in small_int_cols:
        out = out.withColumn(c, F.col(c).cast("tinyint"))
    return out


def save_model(model, path: str) -> None:
    """Persist a fitted ``PipelineModel``."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session; a test session without it gets
    one set by ``zonecast.session``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set")
    base = base.rstrip("/")
    return "/".join([base, *parts])
