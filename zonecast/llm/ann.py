"""Nearest neighbours by inner product with multi-index hashing.

Vectors become binary codes: the signs of several learned rotations (iterative quantisation
on a bounded sample of ``fit_rows`` vectors). Vectors of unequal norms first get one more
component that makes the order of inner products an order of angles. A code is split into
16-bit substrings, and each of these has an index from its values to rows. By the pigeonhole
principle every code within a Hamming radius r agrees with the query to within about r / m
bits in one of m substrings, so probing all values that near, in every index, retrieves every
code within r. Those are compared whole, and the ones within r are ranked by their exact
inner products in double precision. Where a block has fewer than k codes within r, its radius
grows until there are k.

The radius is learned too: the smallest at which the sample finds ``aim`` of its own
neighbours. A whole table is denser than a sample and its neighbours nearer, so the recall
there is higher.

Queries (a stated set) meet all rows in blocks: a task holds one block of rows, indexes it
and answers one block of queries; a window keeps each query's best over the blocks. Copies
of a vector are spread over the blocks by their ids, so a hot vector is no hot key. Note the
limit of the method: where neighbours are far (an angle of 70 degrees, say), r / m is near
what unrelated codes have, so probing prunes little and the whole-code comparison does it.

Defined results for odd input: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do null ids; of rows with one id one
is used; ties go to the smaller id; with fewer than k candidates all are returned; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from zonecast.llm.batches import written

SUBSTRING = 16
BLOCK_ROWS = 8192
BLOCK_QUERIES = 8192
_BITS = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16)).astype(np.uint8)


@dataclass(frozen=True)
class Codes:
    """The learned code: rotations, the largest squared norm, and the Hamming radius of a search."""

    rotations: np.ndarray  # [dimension + 1, bits]
    most: float
    radius: int

    def words(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """[row, substring] 16-bit substrings of the codes."""
        gap = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))
        bits = np.column_stack([x, gap]) @ self.rotations > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)


def rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the rows nearest to corners of a cube."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return r


def learn(x: np.ndarray, most: float, bits: int = 256, k: int = 20, aim: float = 0.97) -> Codes:
    """Rotations and radius from a sample of vectors."""
    whole = np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])
    whole /= np.sqrt(most) if most else 1.0
    turns = np.hstack([rotation(whole, seed) for seed in range(-(-bits // whole.shape[1]))])[:, :bits]
    codes = Codes(turns, most, bits)
    queries = x[:: max(1, len(x) // 256)]
    scores = queries @ x.T
    scores[np.arange(len(queries)), np.arange(0, len(x), max(1, len(x) // 256))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return codes
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own, theirs = codes.words(queries, True), codes.words(x)
    apart = np.array([_BITS[theirs[n] ^ q].sum(axis=1, dtype=np.int64) for q, n in zip(own, nearest)])
    return Codes(turns, most, int(np.quantile(apart, aim, method="higher")))


class Index:
    """The multi-index of one block of rows."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray):
        self.codes, self.ids, self.x, self.words = codes, ids, x, codes.words(x)
        self.tables = []
        for column in self.words.T:
            order = np.argsort(column, kind="stable")
            values, counts = np.unique(column, return_counts=True)
            self.tables.append((values, counts, order))

    def within(self, word: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes are within the radius: probed by substring, then compared whole."""
        m = len(self.tables)
        least, more = divmod(radius, m)
        near = np.zeros(len(self.ids), bool)
        for k, (values, counts, order) in enumerate(self.tables):
            reach = least if k <= more else least - 1
            if reach >= 0:
                near[order[np.repeat(_BITS[values ^ word[k]] <= reach, counts)]] = True
        rows = np.flatnonzero(near)
        return rows[_BITS[self.words[rows] ^ word].sum(axis=1, dtype=np.int64) <= radius]

    def search(self, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, its best rows' ids, scores) for each query; a query's own id is no candidate."""
        bits = self.words.shape[1] * SUBSTRING
        for own, word, v in zip(ids.tolist(), self.codes.words(x, True), x):
            radius, enough = self.codes.radius, min(k, len(self.ids) - int((self.ids == own).any()))
            while True:
                rows = self.within(word, radius)
                rows = rows[self.ids[rows] != own]
                if len(rows) >= enough or radius >= bits:
                    break
                radius += max(1, bits // 32)
            scores = self.x[rows] @ v
            best = np.lexsort((self.ids[rows], -scores))[:k]
            yield own, self.ids[rows[best]], scores[best]


# ---------------------------------------------------------------- frames

def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0)


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, v in double precision."""
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL")
    return rows.where(_valid(F.col("v")))


def search(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           bits: int = 256, fit_rows: int = 8192, aim: float = 0.97) -> DataFrame:
    """(query_id, rank, id, score): the k best rows found for each row that is a query (a condition on the column ``id``)."""
    rows = vectors(table, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, id long, score double"
    if not lengths:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    rows = written(rows.where(F.size("v") == lengths[0].d).dropDuplicates(["id"]))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    said = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(norm).alias("most")).first()
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, said.n // fit_rows))) == 0).limit(2 * fit_rows).toArrow()
    if not sample.num_rows:
        sample = rows.limit(fit_rows).toArrow()
    x = np.array(sample.sort_by("id").column("v").to_pylist())
    codes = table.sparkSession.sparkContext.broadcast(learn(x, said.most, bits, k, aim))

    row_blocks, query_blocks = -(-said.n // BLOCK_ROWS), max(1, -(-said.q // BLOCK_QUERIES))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select(block(row_blocks).alias("rb"), every(query_blocks).alias("qb"), F.lit(False).alias("asks"), "id", "v")
    asking = rows.where(is_query).select(every(row_blocks).alias("rb"), block(query_blocks).alias("qb"), F.lit(True).alias("asks"), "id", "v")

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy()
        ids, v = part["id"].to_numpy(), np.array(part["v"].tolist())
        found = Index(codes.value, ids[~asks], v[~asks]).search(ids[asks], v[asks], k) if asks.any() and (~asks).any() else ()
        got = [(np.full(len(i), q), i, s) for q, i, s in found]
        columns = [np.concatenate(c) for c in zip(*got)] if got else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), columns)))

    found = candidates.unionByName(asking).groupBy("rb", "qb").applyInPandas(answer, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
