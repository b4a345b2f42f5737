"""Helpers for tasks that read texts as Arrow batches, and for tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from zonecast.session import ensure_checkpoint_dir

FILES_A_CORE = 2


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; null is empty."""
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of one column (a longer text stands alone)."""
    for batch in batches:
        n, average = batch.num_rows, batch.column(column).nbytes / max(1, batch.num_rows)
        step = max(1, min(n, int(most_bytes / max(1.0, average))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


_KEPT: dict = {}


def kept(key, make):
    """What a worker process keeps between its tasks: one object, so those of earlier stages don't pile up in it."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """The frame as a checkpoint in the session's shared folder: lineage ends there.

    It has a few files a core at most: on a local file system each file costs its executor a chmod
    process, which shares the executor's memory until it starts, so for a moment that counts twice.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism).checkpoint(eager=True)


def shared_file(spark, name: str, data: bytes) -> str:
    """Write a small file to the shared folder and let every executor fetch it; its name for SparkFiles.get()."""
    sc = spark.sparkContext
    unique = f"{name}-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{unique}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(data)
    finally:
        out.close()
    sc.addFile(path.toString())
    return unique


def fetched_files(df: DataFrame) -> list[str]:
    """Write the frame to the shared folder and let every executor fetch its files; their names, in order of partitions, for SparkFiles.get()."""
    sc = df.sparkSession.sparkContext
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
    files = sorted((f.getPath().getName(), f.getPath().toString()) for f in found if f.getPath().getName().startswith("part-"))
    for _, file in files:
        sc.addFile(file)
    return [name for name, _ in files]


def stored(df: DataFrame) -> DataFrame:
    """The frame as a compressed table in the session's shared folder; for what is larger than a few columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
