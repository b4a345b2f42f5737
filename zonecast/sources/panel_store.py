"""A pruned store of panel and model rows: Parquet partitioned by ``pickup_date``.

Dates are the store's partitions, so the time split and the walk-forward folds are plain date
bounds: two to seven literals, computed once from the list of partitions (a row per calendar
day). A read of one part lists only its folders (``PartitionFilters``) and reads only the used
columns (``ReadSchema``); nothing is joined and nothing is kept in memory between queries.

A store is named by a fingerprint of its source files (paths, sizes, modification times) and
lies in the session's shared folder. Sessions with the same files find it there; after a file
changes the name is another one, so no query sees an old answer. It is written beside its
place and renamed when whole: of two writers one wins, and a lost writer leaves nothing behind
that a reader could take for a store.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonecast.operators.splits import DateBounds
from zonecast.sources.sinks import write_table


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modified) of every file under a path, by Spark's own file systems."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(root, True)
    while listed.hasNext():
        f = listed.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for the present state of the files under a path."""
    return hashlib.sha256(repr(_files(spark, path)).encode()).hexdigest()[:24]


def stored_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: str = "pickup_date") -> DataFrame:
    """The table at ``path``; it is built and written there first if it isn't there."""
    sc = spark.sparkContext
    fs_path = sc._jvm.org.apache.hadoop.fs.Path
    place = fs_path(path)
    fs = place.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(place):
        beside = f"{path}.{uuid.uuid4().hex}"
        df = build()
        _write(df, beside, partition_by)
        out = fs.create(fs_path(f"{beside}/_schema"), True)
        try:
            out.write(bytearray(df.schema.json().encode()))
        finally:
            out.close()
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), sc._jsc.hadoopConfiguration())
        rename = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs_path(beside), place, rename)  # fails where another writer was first
        except Py4JJavaError:
            if not fs.exists(place):
                raise
            fs.delete(fs_path(beside), True)
    stream = fs.open(fs_path(f"{path}/_schema"))
    try:
        text = sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return _read(spark, path, StructType.fromJson(json.loads(text)))


def rewritten(df: DataFrame, path: str, partition_by: str = "pickup_date") -> DataFrame:
    """The rows, written to ``path`` (whatever was there goes) and read from it."""
    _write(df, path, partition_by)
    return _read(df.sparkSession, path, df.schema)


def _write(df: DataFrame, path: str, partition_by: str) -> None:
    # a date's rows (one for each zone and hour at most) are one task's, so it has one file
    write_table(df.repartition(partition_by), path, [partition_by])


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The stored rows, with the columns, order and types that they were written with."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def date_bounds(rows: DataFrame, date_col: str = "pickup_date", **ratios) -> DateBounds:
    """Bounds of the split and the folds, from the distinct dates (one row per calendar day reaches the driver)."""
    dates = [r[0] for r in rows.select(date_col).where(F.col(date_col).isNotNull()).distinct().collect()]
    return DateBounds.of(dates, **ratios)
