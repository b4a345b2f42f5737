"""Histogram gradient boosting on Spark: second-order split search, L2 leaves, leaf-wise or level-wise growth.

Squared loss, so a row's gradient is its residual and its second derivative is 1:

    leaf value = G / (n + l2)        gain = GL^2/(nL + l2) + GR^2/(nR + l2) - G^2/(n + l2)

with G the residuals' sum and n the rows of a node.

* **Bins.** A feature with ``max_bins`` distinct values at most has a bin for each; others get the exact
  distributed quantiles as edges. Rows are binned once and stored in the shared folder as blocks of bytes.
* **A round** is one Spark job over arrays that the executors keep, without a query plan. Each task sums
  (residual, count) by (node, feature, bin) over its blocks; a tree of reductions adds the tasks' sums up. Of two
  siblings only the smaller one is summed: the other is the parent less it. Leaves that can't be split again need no
  sums but their parent's. The driver gets sums only: ``leaves x features x bins`` numbers, whatever the rows.
* **Leaf-wise growth** splits the open leaf of largest gain, up to ``max_leaves``. A round fetches the
  sums of as many open leaves as may still be split, so a tree takes about as many rounds as it is deep, not as it
  has leaves; the order of the splits is that of one split at a time. Without ``max_leaves`` every leaf with a gain is split (level-wise).
* **Sums are exact.** Residuals are rounded to a power of two so small that sums are integers below 2^53: the
  trees don't depend on partitions or the order of tasks.
* **State.** Each tree is added to the predictions in the executors' blocks once; every ``SNAPSHOT`` trees these
  are a checkpoint in the shared folder. A lost executor costs its blocks of the trees since then.

Equal rows have equal hashes, so row sampling takes or leaves them together. A constant target or an empty
frame gives a model without trees. Null and NaN features must be imputed first; rows without a label are left out.
"""

import heapq
import json
import math
import uuid
from dataclasses import asdict, dataclass, field

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

from zonecast.operators.quantiles import exact_quantiles
from zonecast.session import ensure_checkpoint_dir

BLOCK_ROWS = 65_536
SNAPSHOT = 8
TASKS_A_CORE = 4
_BLOCK = "bins binary, y binary, key binary, raw binary"


@dataclass(frozen=True)
class BoostParams:
    trees: int = 100
    rate: float = 0.05
    max_leaves: int | None = 31
    max_depth: int | None = None
    min_leaf: int = 20
    l2: float = 0.0
    subsample: float = 1.0
    colsample: float = 1.0
    max_bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """Nodes as parallel lists; feature -1 marks a leaf. Rows with ``bin <= cut`` go left."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float) -> int:
        for col, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value),
                       (self.gain, 0.0)):
            col.append(v)
        return len(self.feature) - 1

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


def route(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf of each row of ``bins`` (rows x features)."""
    feature, cut = np.asarray(tree.feature), np.asarray(tree.cut)
    left, right = np.asarray(tree.left), np.asarray(tree.right)
    at = np.zeros(len(bins), dtype=np.int64)
    open_rows = np.arange(len(bins)) if tree.feature[0] >= 0 else np.empty(0, dtype=np.int64)
    while len(open_rows):
        node = at[open_rows]
        goes_left = bins[open_rows, feature[node]] <= cut[node]
        at[open_rows] = np.where(goes_left, left[node], right[node])
        open_rows = open_rows[feature[at[open_rows]] >= 0]
    return at


def _sampled(key: np.ndarray, tree_no: int, seed: int, rate: float) -> np.ndarray:
    """Rows of one tree's sample, by a mixed 64-bit hash of the row's key."""
    start = (seed * 1_000_003 + tree_no + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    z = key.view(np.uint64) + np.uint64(start)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


# ---- bins --------------------------------------------------------------------
def bin_edges(df: DataFrame, features: list[str], max_bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins, the last bin left open.

    ``features x max_bins`` numbers reach the driver.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v"))
                                          for i, c in enumerate(features)])).alias("c")).select("c.f", "c.v")
    values = cells.where(F.col("v").isNotNull() & ~F.isnan("v")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        distinct = {r["f"]: r["n"] for r in values.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
        few = [f for f, n in distinct.items() if n <= max_bins]
        edges: list[list[float]] = [[] for _ in features]
        for r in values.where(F.col("f").isin(few)).collect() if few else ():
            edges[r["f"]].append(r["v"])
    finally:
        values.unpersist()
    many = [f for f in distinct if f not in set(few)]
    if many:
        probs = [i / max_bins for i in range(1, max_bins)]
        for r in exact_quantiles(cells.where(F.col("f").isin(many)), ["f"], "v", probs).collect():
            edges[r["f"]].append(r["value"])
    edges = [sorted(set(e)) for e in edges]
    return [e[:-1] if f in set(few) else e for f, e in enumerate(edges)]


def to_bins(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(columns[0]), len(columns)), dtype=np.uint8)
    for j, x in enumerate(columns):
        out[:, j] = np.searchsorted(edges[j], x, side="left")
    return out


def _read_blocks(spark, path: str, parts: int, k: int) -> RDD:
    """Stored blocks as arrays (bins, y, key, raw)."""
    shown = lambda r: (np.frombuffer(r.bins, np.uint8).reshape(-1, k), np.frombuffer(r.y, np.float64),
                       np.frombuffer(r.key, np.int64), np.frombuffer(r.raw, np.float64))
    return spark.read.schema(_BLOCK).parquet(path).coalesce(parts).rdd.map(shown)


def _write_blocks(rows: DataFrame, edges: list[list[float]], base: float, path: str) -> None:
    arrays = [np.asarray(e, dtype=np.float64) for e in edges]

    def pack(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                col = lambda i: part.column(i).to_numpy(zero_copy_only=False)
                bins = to_bins([col(i) for i in range(len(arrays))], arrays)
                y = col(len(arrays)).astype(np.float64)
                key = col(len(arrays) + 1).astype(np.int64)
                cells = [bins.tobytes(), y.tobytes(), key.tobytes(), np.full(len(y), base).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells],
                                                 ["bins", "y", "key", "raw"])

    rows.mapInArrow(pack, _BLOCK).write.parquet(path)


def _with_trees(raw: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    raw = raw.copy()
    for t in trees:
        raw += np.asarray(t.value)[route(t, bins)]
    return raw


# ---- one tree ------------------------------------------------------------------
@dataclass
class _Node:
    sums: np.ndarray | None  # (features, bins, 2): residual units and rows; None where no split can follow
    depth: int
    total: float
    rows: float
    gain: float = 0.0
    feature: int = -1
    cut: int = 0
    children: tuple[int, int] | None = None


def best_split(sums: np.ndarray, total: float, rows: float, p: BoostParams, unit: float,
               columns: list[int]) -> tuple[float, int, int]:
    """(gain, feature, cut) of a node's best split; gain 0 and feature -1 where none helps.

    Of equal gains the first feature, then the smallest cut, wins.
    """
    left = np.cumsum(sums, axis=1)
    gl, nl = left[..., 0], left[..., 1]
    gr, nr = total - gl, rows - nl
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda g, n: (g * unit) ** 2 / (n + p.l2)
        gain = score(gl, nl) + score(gr, nr) - score(total, rows)
    gain[(nl < max(p.min_leaf, 1)) | (nr < max(p.min_leaf, 1))] = 0.0
    mask = np.zeros(len(sums), dtype=bool)
    mask[columns] = True
    gain[~mask] = 0.0
    at = int(np.argmax(gain))
    f, cut = divmod(at, sums.shape[1])
    best = float(gain[f, cut])
    # a gain below the rounding of the scores is none
    return (best, f, cut) if best > 1e-9 * max(score(total, rows), 1e-300) else (0.0, -1, 0)


class _Grower:
    """Grows one tree; ``fetch(tree, wanted)`` returns the sums of the wanted leaves of a partial tree."""

    def __init__(self, p: BoostParams, unit: float, columns: list[int], fetch):
        self.p, self.unit, self.columns, self.fetch = p, unit, columns, fetch
        self.tree = Tree()  # every node that has been opened, wanted in the end or not
        self.nodes: list[_Node] = []

    def _can_split(self, depth: int, rows: float) -> bool:
        return (self.p.max_depth is None or depth < self.p.max_depth) and rows >= 2 * max(self.p.min_leaf, 1)

    def _node(self, sums: np.ndarray, depth: int) -> _Node:
        first = sums[self.columns[0]]
        node = _Node(sums, depth, float(first[:, 0].sum()), float(first[:, 1].sum()))
        if self._can_split(depth, node.rows):
            node.gain, node.feature, node.cut = best_split(sums, node.total, node.rows, self.p, self.unit, self.columns)
        return node

    def _queue(self) -> tuple[list[int], list[int], bool]:
        """(split nodes in order, leaves that wait for their children's sums, whether only one more may be split)."""
        left = (self.p.max_leaves or 2**62) - 1
        order, serial = [], 1
        heap = [(-self.nodes[0].gain, 0, 0)] if self.nodes[0].feature >= 0 else []
        while heap and left > 0:
            _, _, i = heap[0]
            node = self.nodes[i]
            if node.children is None:
                # further open leaves, below nodes of the queue too, may be split later: fetch them in the same round
                more = [j for j, n in enumerate(self.nodes) if n.feature >= 0 and n.children is None and j != i]
                more.sort(key=lambda j: -self.nodes[j].gain)
                return order, [i, *more][:left], left == 1
            heapq.heappop(heap)
            order.append(i)
            left -= 1
            for c in node.children:
                if self.nodes[c].feature >= 0:
                    heapq.heappush(heap, (-self.nodes[c].gain, serial, c))
                serial += 1
        return order, [], False

    def _open(self, waiting: list[int], last: bool) -> None:
        """Splits the waiting leaves; after the ``last`` split no child is split again."""
        wanted, halves = {}, {}
        for i in waiting:
            node, t = self.nodes[i], self.tree
            t.feature[i], t.cut[i] = node.feature, node.cut
            t.left[i], t.right[i] = t.add(0.0), t.add(0.0)
            self.nodes += [None, None]
            node.children = (t.left[i], t.right[i])
            low, rows_left = (float(x) for x in node.sums[node.feature, : node.cut + 1].sum(axis=0))
            halves[i] = ((low, rows_left), (node.total - low, node.rows - rows_left))
            if not last and any(self._can_split(node.depth + 1, rows) for _, rows in halves[i]):
                wanted[i] = node.children[0 if rows_left * 2 <= node.rows else 1]
        sums = self.fetch(self.tree, list(wanted.values())) if wanted else {}
        for i in waiting:
            node = self.nodes[i]
            for c, (total, rows) in zip(node.children, halves[i]):
                if i in wanted:
                    self.nodes[c] = self._node(sums[c] if c == wanted[i] else node.sums - sums[wanted[i]], node.depth + 1)
                else:
                    self.nodes[c] = _Node(None, node.depth + 1, total, rows)
            node.sums = None  # its children have their own

    def grow(self) -> Tree:
        self.tree.add(0.0)
        self.nodes.append(self._node(self.fetch(self.tree, [0])[0], 0))
        order, waiting, last = self._queue()
        while waiting:
            self._open(waiting, last)
            order, waiting, last = self._queue()
        return self._chosen(order)

    def _chosen(self, order: list[int]) -> Tree:
        """The tree of the split nodes; opened nodes that the queue didn't take are leaves again."""
        out, place = Tree(), {0: 0}
        value = lambda n: self.p.rate * n.total * self.unit / (n.rows + self.p.l2) if n.rows + self.p.l2 > 0 else 0.0
        out.add(value(self.nodes[0]))
        for i in order:
            node, at = self.nodes[i], place[i]
            out.feature[at], out.cut[at], out.gain[at] = node.feature, node.cut, node.gain
            for side, c in zip((out.left, out.right), node.children):
                place[c] = out.add(value(self.nodes[c]))
                side[at] = place[c]
        return out


# ---- all trees -------------------------------------------------------------------
def _sums(blocks: RDD, k: int, width: int, tree: Tree, wanted: list[int], tree_no: int, p: BoostParams, unit: float,
          columns: list[int]) -> dict[int, np.ndarray]:
    """{leaf: (features, bins, 2)} of the wanted leaves, from one Spark job."""
    slots = np.full(len(tree.feature), -1, dtype=np.int64)
    slots[wanted] = np.arange(len(wanted))
    m = len(wanted)

    def partial(part):
        out = np.zeros((2, len(columns), m, width))
        for bins, y, key, raw in part:
            slot = slots[route(tree, bins)]
            take = slot >= 0
            if p.subsample < 1:
                take &= _sampled(key, tree_no, p.seed, p.subsample)
            start, residual = slot[take] * width, np.rint((y[take] - raw[take]) / unit)
            for c, j in enumerate(columns):
                at = start + bins[take, j]
                out[0, c] += np.bincount(at, residual, m * width).reshape(m, width)
                out[1, c] += np.bincount(at, minlength=m * width).reshape(m, width)
        yield out

    out = np.zeros((m, k, width, 2))
    out[:, columns] = blocks.mapPartitions(partial).treeReduce(np.add).transpose(2, 1, 3, 0)
    return dict(zip(wanted, out))


def _advanced(blocks: RDD, tree: Tree) -> RDD:
    """The blocks with a tree added to their predictions."""
    return blocks.map(lambda b: (*b[:3], _with_trees(b[3], b[0], [tree])))


def fit_boosted(df: DataFrame, features: list[str], label: str, p: BoostParams) -> dict:
    """The fitted forest: ``base``, ``edges`` of the bins and ``trees``."""
    spark = df.sparkSession
    if not 2 <= p.max_bins <= 255:
        raise ValueError("max_bins must be 2 to 255")
    if p.max_leaves is None and p.max_depth is None:
        raise ValueError("max_leaves or max_depth must bound a tree: the driver holds sums for each open leaf")
    y = F.col(label).cast("double")
    rows = df.where(y.isNotNull() & ~F.isnan(y)).select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)],
                                                        y.alias("y"))
    names, k = [f"f{i}" for i in range(len(features))], len(features)
    st = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if not st["n"] or st["lo"] == st["hi"]:
        return {"base": float(st["lo"] or 0.0), "edges": [[] for _ in features], "trees": []}
    base = float(np.float32(st["m"]))  # free of the last digits, which depend on the order of the sum
    spread = 4.0 * st["n"] * max(st["hi"] - base, base - st["lo"])
    unit = 2.0 ** -math.floor(52 - math.log2(spread))
    edges = bin_edges(rows, names, p.max_bins)
    width = max(len(e) for e in edges) + 1

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosting/{uuid.uuid4().hex}"
    # a task has a block at least, and a core a few tasks at most
    parts = min(math.ceil(st["n"] / BLOCK_ROWS), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    _write_blocks(rows.withColumn("key", F.xxhash64(*names, "y")).repartition(parts), edges, base, f"{folder}/0")
    blocks = _read_blocks(spark, f"{folder}/0", parts, k).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    trees: list[Tree] = []
    try:
        for t in range(p.trees):
            columns = list(range(k))
            if p.colsample < 1:
                rng = np.random.default_rng([p.seed, t])
                columns = sorted(rng.choice(k, max(1, math.ceil(p.colsample * k)), replace=False).tolist())
            fetch = lambda tree, wanted, now=blocks, cols=columns, no=t: _sums(now, k, width, tree, wanted, no, p, unit, cols)
            trees.append(_Grower(p, unit, columns, fetch).grow())
            if before is not None:
                before.unpersist()
                before = None
            if t + 1 < p.trees:
                before, blocks = blocks, _advanced(blocks, trees[-1]).persist(StorageLevel.MEMORY_AND_DISK)
                if (t + 1) % SNAPSHOT == 0:
                    blocks.checkpoint()
    finally:
        for held in (before, blocks):
            if held is not None:
                held.unpersist()
    return {"base": base, "edges": edges, "trees": [asdict(t) for t in trees]}


# ---- stages ----------------------------------------------------------------------
class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output column", TypeConverters.toString)


class HistBoostedModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; the forest is one JSON parameter (trees x leaves numbers), so the stage saves as metadata."""

    forest = Param(Params._dummy(), "forest", "fitted trees as JSON", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    @property
    def content(self) -> dict:
        return json.loads(self.getOrDefault(self.forest))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (the name of Spark ML's trees)
        """Share of the gain by feature (zeros without trees)."""
        content = self.content
        out = np.zeros(len(content["edges"]))
        for t in content["trees"]:
            for f, g in zip(t["feature"], t["gain"]):
                if f >= 0:
                    out[f] += g
        return DenseVector(out / out.sum() if out.sum() > 0 else out)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        content = self.content
        edges = [np.asarray(e, dtype=np.float64) for e in content["edges"]]
        forest = dataset.sparkSession.sparkContext.broadcast([Tree(**t) for t in content["trees"]])
        base = content["base"]

        @F.pandas_udf("double")
        def scored(cols: pd.DataFrame) -> pd.Series:
            bins = to_bins([cols[c].to_numpy(dtype=np.float64) for c in cols.columns], edges)
            return pd.Series(_with_trees(np.full(len(cols), base), bins, forest.value))

        cols = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.getOrDefault(self.inputCols))]
        return dataset.withColumn(self.getOrDefault(self.predictionCol), scored(F.struct(*cols)))


class HistBoostedRegressor(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Histogram boosting as a ``pyspark.ml`` stage; ``boost`` is a ``BoostParams`` as JSON."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    boost = Param(Params._dummy(), "boost", "parameters as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, labelCol=None, predictionCol="prediction", boost=None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(predictionCol="prediction", boost=json.dumps(asdict(BoostParams())))
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> HistBoostedModel:
        features = self.getOrDefault(self.inputCols)
        forest = fit_boosted(dataset, features, self.getOrDefault(self.labelCol),
                             BoostParams(**json.loads(self.getOrDefault(self.boost))))
        return HistBoostedModel()._set(inputCols=features, predictionCol=self.getOrDefault(self.predictionCol),
                                       forest=json.dumps(forest))
