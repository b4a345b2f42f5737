"""Centroid clustering of integer vectors with a LAESA pivot table.

A vector's components become integers, floor(scale * x). The k starting centroids, fixed by a
hash of the ids, are also the pivots: one pass stores each vector with its exact squared
distances to them. In every round a centroid c has a lower bound for a vector x without
touching x's components: |d(x, p) - d(c, p)| for each pivot p, by the triangle inequality, the
best of all pivots. The centroid of the least bound is measured first; those whose bound
doesn't exceed that distance survive, and only they receive an exact integer distance. The
bounds are compared with a margin far above the error of the square roots, so no centroid that
could win or tie is left out, and the assignment is that of a whole comparison.

Every task sums its vectors by cluster, so a round shuffles at most k rows for each task and
k rows, a bound that doesn't grow with the table, reach the driver. A hot cluster is
therefore no hot key.

Defined results for odd input: vectors that are null, of another length, or with a component
null, not finite or beyond 2^27 once scaled (their distances would not fit a long) take no
part; a null id is never a starting centroid before other ids, and its vector is assigned like
any; rows of one id, equal or not, are vectors of their own (equal hashes are ordered by the
vectors); with fewer vectors than k all are centroids, and of equal centroids the larger number
stays empty; an empty table gives an empty result; other columns aren't read. A sum of
distances beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from zonecast.llm.batches import stored, written

MOST = 1 << 27
CHUNK = 4096


def integers(table: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v) of the rows that take part, v as integers."""
    x = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).alias("id"), x.alias("x")).where(F.size("x") == dim)
    fits = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < MOST))
    return rows.where(fits).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each row, and how many distances were computed.

    ``to_pivots`` [row, pivot] and ``of_centroids`` [pivot, centroid] are exact squared distances.
    """
    near, far = np.sqrt(to_pivots.astype(float)), np.sqrt(of_centroids.astype(float))
    bound = np.zeros((len(x), len(centroids)))
    for j in range(near.shape[1]):
        np.maximum(bound, np.abs(near[:, j, None] - far[j]), out=bound)
    first = bound.argmin(axis=1)
    rows = np.arange(len(x))
    best = ((x - centroids[first]) ** 2).sum(axis=1)
    margin = 1e-9 * (1 + near.max(axis=1) + far.max())
    survives = bound <= (np.sqrt(best.astype(float)) + margin)[:, None]
    survives[rows, first] = False
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, first] = best
    i, c = np.nonzero(survives)
    exact[i, c] = ((x[i] - centroids[c]) ** 2).sum(axis=1)
    cluster = exact.argmin(axis=1)  # the first of equal ones
    return cluster, exact[rows, cluster], len(x) + len(i)


def _pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("p", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            d = squared(_matrix(v, pivots.shape[1]), pivots)
            offsets = np.arange(len(d) + 1, dtype=np.int32) * len(pivots)
            p = pa.ListArray.from_arrays(pa.array(offsets), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, p], ["id", "v", "p"])

    return stored(rows.mapInArrow(run, schema))


def _assigned(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray, totals: bool) -> DataFrame:
    """(id, cluster, distance) of every vector, or a task's (cluster, n, computed, sums) when only totals are asked for."""
    between = squared(pivots, centroids)
    k, dim = centroids.shape
    if totals:
        schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("computed", T.LongType()),
                               T.StructField("sums", T.ArrayType(T.LongType()))])
    else:
        schema = T.StructType([table.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, computed, sums = np.zeros(k, np.int64), 0, np.zeros((k, dim), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = _matrix(part.column("v"), dim)
                cluster, distance, done = nearest(x, _matrix(part.column("p"), len(pivots)), centroids, between)
                if not totals:
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], schema.names)
                    continue
                computed += done
                n += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, x)
        if totals:
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array([computed if i == 0 else 0 for i in range(len(own))], pa.int64()),
                pa.array([sums[c].tolist() for c in own], pa.list_(pa.int64()))], schema.names)

    return table.mapInArrow(run, schema)


def cluster_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 64,
                    k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Centroids start as the k vectors of smallest SHA-256 of ``<seed>:<id>``; each round assigns
    every vector to its nearest centroid (the smaller number of equally near ones) and moves each
    centroid that has vectors to the floor of their exact mean; then vectors are assigned once more.
    """
    spark = table.sparkSession
    rows = integers(table, id_col, vector_col, dim, scale)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = rows.select(named.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    pivots = np.array([r.v for r in start], np.int64).reshape(-1, dim)
    centroids = pivots.copy()
    out = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()),
                        T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not start:
        none = spark.createDataFrame([], out)
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).join(none, "cluster").select(
            id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    held = _pivot_table(rows, pivots)
    for _ in range(rounds):
        partial = _assigned(held, pivots, centroids, True)
        total = lambda c: F.sum(c.cast("decimal(38,0)"))
        moved = partial.groupBy("cluster").agg(total(F.col("n")).alias("n"), F.array(*[total(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
        for r in moved.collect():  # k rows at most
            centroids[r.cluster] = [int(s) // int(r.n) for s in r.sums]
    placed = written(_assigned(held, pivots, centroids, False))
    inertia = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    of = spark.createDataFrame([(c, fits(d), fits(sum(inertia.values())), digest(centroids[c])) for c, d in sorted(inertia.items())], out)
    return placed.join(F.broadcast(of), "cluster").select(  # k rows at most
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
