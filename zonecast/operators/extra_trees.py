"""Extremely randomised trees on Spark (G5): a random threshold for each node and feature, the best feature's is taken.

All trees grow level by level together. The executors keep blocks of rows with each row's open node in each tree, moved
once a level. A level takes two Spark jobs over them:

1. the range of every feature (and of the label) in every open node;
2. after the driver drew a threshold within each range, rows and label sums on its left side.

Each task reduces its blocks to arrays of the nodes that it met, a tree of reductions merges them (min, max, sum), and
the driver picks a feature for each node: the largest drop in squared error, the first of equal ones. With few rows a
block is dealt out several times, each time for other trees, so that all cores have work. ``NODES_A_JOB`` nodes are
looked at together, the others in further jobs. Every ``SNAPSHOT`` levels the blocks are a checkpoint in the shared folder.

Thresholds come from a hash of seed, tree, node and feature, and label sums are exact (whole units below 2^53):
the trees don't depend on partitions. Every row is in every tree (no bootstrap). A node with equal labels, with fewer than
``2 * min_leaf`` rows or without a threshold that leaves ``min_leaf`` rows on both sides is a leaf.

Without a depth cap the model grows with the rows, as it does in the source, and it is held by the driver and
broadcast: ``max_depth`` bounds it where that is too much. A constant label or an empty frame gives single leaves.
"""

import json
import math
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonecast.session import ensure_checkpoint_dir

NODES_A_JOB = 50_000
TREES_AT_ONCE = 32
BLOCK_ROWS = 10_000
TASKS_A_CORE = 4
SNAPSHOT = 16
_BLOCK = "x binary, y binary"


@dataclass(frozen=True)
class ExtraTreesParams:
    trees: int = 220
    min_leaf: int = 2
    max_depth: int | None = None
    seed: int = 42


class Forest:
    """Nodes of all trees in parallel lists; the first ``trees`` nodes are the roots. Feature -1 marks a leaf."""

    def __init__(self, trees: int):
        self.trees = trees
        self.feature, self.cut = [-1] * trees, [0.0] * trees
        self.left, self.right = [-1] * trees, [-1] * trees
        self.value, self.gain = [0.0] * trees, [0.0] * trees


def walk(x: np.ndarray, roots: np.ndarray, arrays: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every row in every tree of ``roots``, tree by tree."""
    feature, cut, left, right = arrays
    row = np.tile(np.arange(len(x), dtype=np.int32), len(roots))
    at = np.repeat(roots.astype(np.int32), len(x))
    live = np.flatnonzero(feature[at] >= 0)
    while len(live):
        node = at[live]
        at[live] = np.where(x[row[live], feature[node]] <= cut[node], left[node], right[node])
        live = live[feature[at[live]] >= 0]
    return row, at


def _draws(seed: int, nodes: np.ndarray, k: int) -> np.ndarray:
    """A number in [0, 1) for each node and feature. Nodes of all trees are numbered through."""
    z = (nodes.astype(np.uint64)[:, None] * np.uint64(k) + np.arange(k, dtype=np.uint64)[None, :]
         + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _open_rows(part, lo: int, hi: int):
    """(values, label units, row, node) of the rows in open nodes lo to hi of the level, sorted by node, block by block."""
    for x, y, at in part:
        held = (at >= lo) & (at < hi)
        if held.any():
            row, node = np.nonzero(held)[0], at[held]
            order = np.argsort(node, kind="stable")
            yield x, y, row[order], node[order]


def _merged(a: tuple, b: tuple, op) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, numbers) of two tables of nodes; ``op`` joins those of a node in both."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    nodes, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    out = np.empty((len(nodes), *a[1].shape[1:]))
    out[where[len(a[0]) :]] = b[1]
    both = np.isin(a[0], b[0], assume_unique=True)
    at = where[: len(a[0])]
    out[at[~both]] = a[1][~both]
    out[at[both]] = op(out[at[both]], a[1][both])
    return nodes, out


def _by_node(state: RDD, lo: int, hi: int, shape: tuple[int, int], measured, op) -> np.ndarray:
    """Numbers of the open nodes lo to hi: ``measured`` has those of a block's rows, ``op`` joins them."""

    def partial(part):
        out = (np.empty(0, np.int32), np.empty((0, *shape)))
        for x, y, row, node in _open_rows(part, lo, hi):
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            out = _merged(out, (node[first], measured(x, y, row, node, first)), op)
        yield out

    # tasks of different trees have different nodes: merging them early saves nothing while there are few tasks
    depth = 1 if state.getNumPartitions() <= state.context.defaultParallelism else 2
    return state.mapPartitions(partial).treeReduce(lambda a, b: _merged(a, b, op), depth)[1]


def _ranges(state: RDD, k: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) of every feature and, last, of the label in the open nodes lo to hi."""

    def measured(x, y, row, node, first):
        out = np.empty((len(first), 2, k + 1))
        for j in range(k + 1):
            v = x[row, j] if j < k else y[row]
            out[:, 0, j], out[:, 1, j] = np.minimum.reduceat(v, first), -np.maximum.reduceat(v, first)
        return out

    found = _by_node(state, lo, hi, (2, k + 1), measured, np.minimum)
    return found[:, 0], -found[:, 1]


def _left_sums(state: RDD, k: int, lo: int, hi: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, label units) at or below each threshold of the open nodes lo to hi."""
    shared = state.context.broadcast(cuts)

    def measured(x, y, row, node, first):
        out, own = np.empty((len(first), 2, k)), shared.value[node - lo]
        for j in range(k):
            low = x[row, j] <= own[:, j]
            out[:, 0, j], out[:, 1, j] = np.add.reduceat(low.astype(np.float64), first), np.add.reduceat(np.where(low, y[row], 0.0), first)
        return out

    found = _by_node(state, lo, hi, (2, k), measured, np.add)
    shared.unpersist()
    return found[:, 0], found[:, 1]


def _moved(state: RDD, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> RDD:
    """The blocks with each row in its node of the next level (-1: in a leaf)."""
    shared = state.context.broadcast((feature, cut, left, right))

    def move(block):
        (x, y, at), (feature, cut, left, right) = block, shared.value
        row, tree = np.nonzero(at >= 0)
        node = at[row, tree]
        f = feature[node]
        out = np.full_like(at, -1)
        out[row, tree] = np.where(f < 0, -1, np.where(x[row, f] <= cut[node], left[node], right[node]))
        return x, y, out

    return state.map(move)


def choose(total: np.ndarray, units: np.ndarray, left_rows: np.ndarray, left_units: np.ndarray, differs: np.ndarray,
           min_leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature or -1, drop in squared error) of each node, from its totals and the left sums of its thresholds."""
    rows, s = total[:, None], units[:, None]
    right_rows, right_units = rows - left_rows, s - left_units
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_units**2 / left_rows + right_units**2 / right_rows - s**2 / rows
    valid = differs & (left_rows >= max(min_leaf, 1)) & (right_rows >= max(min_leaf, 1))
    gain = np.where(valid, gain, -np.inf)
    best = gain.argmax(axis=1)
    drop = gain[np.arange(len(gain)), best]
    return np.where(np.isfinite(drop), best, -1), drop


def fit_extra_trees(df: DataFrame, features: list[str], label: str, p: ExtraTreesParams) -> dict:
    """The fitted forest as lists (``Forest``)."""
    spark, k = df.sparkSession, len(features)
    y = F.col(label).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)],
                                                        y.alias("y"))
    st = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    forest = Forest(p.trees)
    base = float(np.float32(st["m"] or 0.0))
    out = {"features": k, "trees": p.trees, "base": base}
    if not st["n"] or st["lo"] == st["hi"]:
        return out | {"base": float(st["lo"] or 0.0)} | _lists(forest)
    # labels less the base, in whole units so small that sums stay below 2^53
    unit = 2.0 ** -math.floor(52 - math.log2(2.0 * st["n"] * max(st["hi"] - base, base - st["lo"])))

    def pack(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                cols = [part.column(i).to_numpy(zero_copy_only=False) for i in range(k + 1)]
                x = np.column_stack(cols[:k]).astype(np.float64)
                units = np.rint((cols[k] - base) / unit)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([units.tobytes()], pa.binary())],
                                                 ["x", "y"])

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extra_trees/{uuid.uuid4().hex}"
    most = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    rows.repartition(min(math.ceil(st["n"] / BLOCK_ROWS), most)).mapInArrow(pack, _BLOCK).write.parquet(path)
    blocks = spark.read.schema(_BLOCK).parquet(path).rdd.map(lambda r: (
        np.frombuffer(r.x, np.float64).reshape(-1, k), np.frombuffer(r.y, np.float64)))
    whole = blocks.map(lambda b: (float(len(b[1])), b[1].sum(), 1)).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
    # how often a block is dealt out, for other trees each time
    deals = max(1, min(p.trees, spark.sparkContext.defaultParallelism // whole[2]))
    groups = np.array_split(np.arange(p.trees, dtype=np.int32), deals)
    parts = min(most, whole[2] * deals)
    state = blocks.zipWithIndex().flatMap(lambda b: [
        (b[1] * deals + i, (*b[0], np.tile(g, (len(b[0][1]), 1)))) for i, g in enumerate(groups)]).partitionBy(parts, lambda i: i).values()
    forest.value = [float(whole[1] / whole[0] * unit)] * p.trees
    nodes = trees = np.arange(p.trees)  # the level's open nodes and their trees
    total, units = np.full(p.trees, whole[0]), np.full(p.trees, whole[1])
    before, depth = None, 0
    state = state.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while len(nodes) and total.max() >= 2 * max(p.min_leaf, 1) and (p.max_depth is None or depth < p.max_depth):
            feature, cut, left, right, *level = _split(state, k, forest, nodes, trees, total, units, p, unit)
            if before is not None:
                before.unpersist()
            before, state = state, _moved(state, feature, cut, left, right).persist(StorageLevel.MEMORY_AND_DISK)
            nodes, trees, total, units = level
            depth += 1
            if depth % SNAPSHOT == 0:
                state.checkpoint()
    finally:
        for held in (before, state):
            if held is not None:
                held.unpersist()
    return out | _lists(forest)


def _split(state: RDD, k: int, forest: Forest, nodes: np.ndarray, trees: np.ndarray, total: np.ndarray, units: np.ndarray,
           p: ExtraTreesParams, unit: float) -> list[np.ndarray]:
    """Splits a level's open nodes where that is possible.

    Returns feature (or -1), threshold and the children's places in the next level of each node, and
    (nodes, trees, rows, label units) of that level, which has the children that may be split.
    """
    found = []
    for lo in range(0, len(nodes), NODES_A_JOB):
        own = slice(lo, min(lo + NODES_A_JOB, len(nodes)))
        low, high = _ranges(state, k, own.start, own.stop)
        cuts = low[:, :k] + _draws(p.seed, nodes[own], k) * (high[:, :k] - low[:, :k])
        cuts = np.where(cuts >= high[:, :k], low[:, :k], cuts)  # rounding must not reach the largest value
        differs = (low[:, :k] < high[:, :k]) & (low[:, k:] < high[:, k:])
        left_rows, left_units = _left_sums(state, k, own.start, own.stop, cuts)
        feature, drop = choose(total[own], units[own], left_rows, left_units, differs, p.min_leaf)
        at = np.arange(len(feature)), np.maximum(feature, 0)
        found.append((feature, cuts[at], drop, left_rows[at], left_units[at]))
    feature, cut, drop, left_rows, left_units = (np.concatenate(c) for c in zip(*found))
    split = np.flatnonzero(feature >= 0)
    n, first = len(split), len(forest.feature)
    # a node's children follow each other, in the order of their parents
    rows = np.column_stack([left_rows[split], total[split] - left_rows[split]]).ravel()
    sums = np.column_stack([left_units[split], units[split] - left_units[split]]).ravel()
    children = first + np.arange(2 * n)
    for i, f, c, g, child in zip(nodes[split].tolist(), feature[split].tolist(), cut[split].tolist(),
                                 (np.maximum(drop[split], 0.0) * unit**2).tolist(), children[::2].tolist()):
        forest.feature[i], forest.cut[i], forest.gain[i], forest.left[i], forest.right[i] = f, c, g, child, child + 1
    forest.value += (sums / rows * unit).tolist()
    for column, empty in ((forest.feature, -1), (forest.cut, 0.0), (forest.left, -1), (forest.right, -1), (forest.gain, 0.0)):
        column += [empty] * (2 * n)
    goes_on = rows >= 2 * max(p.min_leaf, 1)
    place = np.where(goes_on, np.cumsum(goes_on) - 1, -1).astype(np.int32)
    left, right = np.full(len(nodes), -1, np.int32), np.full(len(nodes), -1, np.int32)
    left[split], right[split] = place[::2], place[1::2]
    return [feature, cut, left, right, children[goes_on], np.repeat(trees[split], 2)[goes_on], rows[goes_on], sums[goes_on]]


def _lists(forest: Forest) -> dict:
    return {c: getattr(forest, c) for c in ("feature", "cut", "left", "right", "value", "gain")}


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output column", TypeConverters.toString)


class ExtraTreesModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    forest = Param(Params._dummy(), "forest", "fitted trees as JSON", TypeConverters.toString)

    @property
    def content(self) -> dict:
        return json.loads(self.getOrDefault(self.forest))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (the name of Spark ML's trees)
        """Share of the drop in squared error by feature (zeros without splits)."""
        c = self.content
        feature, gain = np.asarray(c["feature"]), np.asarray(c["gain"])
        out = np.bincount(feature[feature >= 0], gain[feature >= 0], c["features"])
        return DenseVector(out / out.sum() if out.sum() > 0 else out)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c = self.content
        arrays = (np.asarray(c["feature"], np.int32), np.asarray(c["cut"]), np.asarray(c["left"], np.int32),
                  np.asarray(c["right"], np.int32), np.asarray(c["value"]))
        shared = dataset.sparkSession.sparkContext.broadcast(arrays)
        base, trees = c["base"], c["trees"]

        @F.pandas_udf("double")
        def scored(cols: pd.DataFrame) -> pd.Series:
            x, *nodes, value = cols.to_numpy(dtype=np.float64), *shared.value
            total = np.zeros(len(x))
            for lo in range(0, trees, TREES_AT_ONCE):
                row, at = walk(x, np.arange(lo, min(lo + TREES_AT_ONCE, trees)), nodes)
                total += np.bincount(row, value[at], len(x))
            return pd.Series(base + total / trees)

        cols = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.getOrDefault(self.inputCols))]
        return dataset.withColumn(self.getOrDefault(self.predictionCol), scored(F.struct(*cols)))


class ExtraTreesRegressor(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Extremely randomised trees as a ``pyspark.ml`` stage; ``settings`` is an ``ExtraTreesParams`` as JSON."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "parameters as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol=None, predictionCol="prediction", settings=None):
        super().__init__()
        self._setDefault(predictionCol="prediction", settings=json.dumps(asdict(ExtraTreesParams())))
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ExtraTreesModel:
        features = self.getOrDefault(self.inputCols)
        forest = fit_extra_trees(dataset, features, self.getOrDefault(self.labelCol),
                                 ExtraTreesParams(**json.loads(self.getOrDefault(self.settings))))
        return ExtraTreesModel()._set(inputCols=features, predictionCol=self.getOrDefault(self.predictionCol),
                                      forest=json.dumps(forest))
