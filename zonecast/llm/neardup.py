"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Equal vectors become one class, named by a hash of their components; copies are never compared.
2. From a bounded sample, rotations are learned that bring the centred unit vectors nearest to
   corners of a cube (iterative quantisation), with the sample's medians as thresholds, so bits
   are balanced. A code is cut into substrings of log2(rows) bits, 16 at least, one Hamming table
   each. By the pigeonhole principle every two codes that differ in fewer bits than there are
   tables share a substring. Pairs at the wanted cosine differ in more, so the number of tables
   is learned too: as many as it takes for ``aim`` of pairs turned by just that angle from
   held-out vectors of the sample to share a substring. Nearer pairs are found more often.
3. Classes in one bucket of a table whose first 128 bits are near enough (a learned distance,
   that 1 in 10,000 pairs at the wanted cosine exceeds) are candidates; a bucket keeps a
   spanning forest of them, and components of these hold the candidates.
4. In a component the original vectors are compared, all in double precision: links, each
   member's number of links (copies included) and again a spanning forest.

In steps 3 and 4 a bucket or component that is large is cut by hash into blocks, and block
pairs meet in turns of their own as one matrix product each; no pair is a row and no key is
held whole. The codes only decide what is compared; a link always reaches the cosine.

Defined results for odd input: vectors that are null, empty, zero, or with a null or non-finite
component have no class, no links, and are components of their own; vectors of unlike lengths
never link, and those of another length than most have codes of random directions; repeated
rows, and rows of one id with unlike vectors, are vectors of their own, though a component is
named by an id; a null id names a component only if all its ids are null; components of any
magnitude are scaled by a power of two before products, so nothing overflows; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from zonecast.llm.ann import rotation
from zonecast.llm.batches import stored, written
from zonecast.llm.graph import component_table, connected_components
from zonecast.llm.jaccard import block_forests, block_pairs

CHECKED = 128
MOST_TABLES = 64
BLOCK_CODES = 2048
BLOCK_VECTORS = 1024


# ---------------------------------------------------------------- codes

def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is first scaled by a power of two, which loses nothing."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Tables:
    """Learned codes: directions and thresholds [tables * width bits], and the Hamming distance that candidates keep."""

    dim: int
    width: int
    count: int
    near: int
    directions: np.ndarray
    thresholds: np.ndarray
    others: dict[int, np.ndarray] = field(default_factory=dict)

    def bits(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, all of one length."""
        if x.shape[1] == self.dim:
            return x @ self.directions > self.thresholds
        turns = self.others.get(x.shape[1])
        if turns is None:  # unlearned; one length at a time is remembered
            self.others.clear()
            turns = self.others[x.shape[1]] = np.random.default_rng(x.shape[1]).normal(size=(x.shape[1], self.width * self.count))
        return x @ turns > 0

    def keys(self, code: np.ndarray, dim: int) -> np.ndarray:
        """[row, table] the code's substrings, numbered apart by table and length."""
        parts = code.reshape(len(code), self.count, self.width)
        values = parts @ (1 << np.arange(self.width, dtype=np.int64))
        with np.errstate(over="ignore"):
            return values + (np.arange(self.count, dtype=np.int64) << self.width) + np.int64(dim) * np.int64(1 << 37)


def learn(sample: np.ndarray, rows: int, cosine: float, aim: float = 0.995) -> Tables:
    """Rotations, thresholds, the number of tables and the candidates' distance from a sample of unit vectors."""
    dim = sample.shape[1]
    width = min(30, max(16, math.ceil(math.log2(max(rows, 2)))))
    total = max(width * MOST_TABLES, CHECKED)
    rng = np.random.default_rng(len(sample))
    sample = sample[rng.permutation(len(sample))]
    held = min(1024, len(sample) // 4)
    fitted = sample[held:]
    own = sample[:held] if held else sample  # rotations suit the vectors that they were fitted to, so others calibrate
    centre = fitted.mean(axis=0)
    turns = np.hstack([rotation(fitted - centre, seed) for seed in range(-(-total // dim))])[:, :total]
    thresholds = np.median(fitted @ turns, axis=0)
    aside = rng.normal(size=own.shape)
    aside -= (aside * own).sum(axis=1, keepdims=True) * own
    length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    turned = cosine * own + math.sqrt(1 - cosine * cosine) * aside / np.where(length > 1e-9, length, 1)
    differ = (own @ turns > thresholds) != (turned @ turns > thresholds)
    shared = ~differ[:, : width * MOST_TABLES].reshape(len(own), MOST_TABLES, width).any(axis=2)
    found = np.maximum.accumulate(shared, axis=1).mean(axis=0)
    count = int(np.argmax(found >= aim)) + 1 if (found >= aim).any() else MOST_TABLES
    count = max(count, -(-CHECKED // width))
    near = int(np.quantile(differ[:, :CHECKED].sum(axis=1), 0.9999, method="higher")) + 1
    return Tables(dim, width, count, near, turns[:, : width * count], thresholds[: width * count])


def codes_near(near: int):
    """The test of a block: which codes, of CHECKED bits, are at most ``near`` apart."""

    def test(codes: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
        signs = np.where(np.unpackbits(np.stack(codes), axis=1), np.float32(1), np.float32(-1))
        out = signs @ signs.T >= CHECKED - 2 * near
        np.fill_diagonal(out, False)
        return out

    return test


def vectors_near(cosine: float):
    """The test of a block: which vectors reach the cosine, in double precision."""

    def test(vectors: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
        x = np.stack(vectors)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        length = np.sqrt((x * x).sum(axis=1))
        out = (x @ x.T) / np.outer(length, length) >= cosine
        np.fill_diagonal(out, False)
        return out

    return test


# ---------------------------------------------------------------- frames

def _valid(vector):
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0)


def _coded(rows: DataFrame, tables) -> DataFrame:
    """(id, set_id, n, keys, code, v): the class of each vector, and its code; nulls where the vector takes no part."""
    schema = T.StructType([rows.schema["id"], T.StructField("set_id", T.BinaryType()), T.StructField("n", T.LongType()),
                           T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("code", T.BinaryType()), T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Tables = tables.value
        for batch in batches:
            ids, column, taking = batch.column("id"), batch.column("v"), batch.column("valid").to_numpy(zero_copy_only=False)
            starts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(starts)
            for dim in np.unique(np.where(taking, lengths, 0)).tolist():
                at = np.flatnonzero(taking & (lengths == dim) if dim else ~taking)
                for part in np.array_split(at, max(1, len(at) * dim >> 21)):
                    if not dim:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(part)), *[pa.nulls(len(part), t) for t in (
                            pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())]], schema.names)
                        continue
                    x = flat[starts[part][:, None] + np.arange(dim)] + 0.0  # one zero only
                    code = own.bits(unit(x))
                    keys = own.keys(code, dim)
                    packed = np.packbits(code[:, :CHECKED], axis=1)
                    offsets = np.arange(len(part) + 1, dtype=np.int32) * own.count
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(part)), pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in x], pa.binary()), pa.array(np.full(len(part), dim, np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())), pa.array([c.tobytes() for c in packed], pa.binary()),
                        pa.array([v.tobytes() for v in x], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def _sample(rows: DataFrame, fit_rows: int) -> tuple[np.ndarray, int]:
    """About fit_rows unit vectors of the most frequent length, and how many vectors there are."""
    taking = rows.where("valid")
    lengths = taking.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return np.empty((0, 1)), 0
    n = lengths[0].n
    taking = taking.where(F.size("v") == lengths[0].d)
    share = max(1, n // fit_rows)
    got = taking.where(F.pmod(F.xxhash64("id", "v"), F.lit(share)) == 0).select("v").limit(2 * fit_rows).toArrow()
    if not got.num_rows:
        got = taking.select("v").limit(fit_rows).toArrow()
    return unit(np.unique(np.array(got.column("v").to_pylist()), axis=0)), n


def vector_near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                           fit_rows: int = 8192, aim: float = 0.995) -> DataFrame:
    """(id, n_links, component_id, kept): one row for each vector.

    ``n_links`` counts the other vectors found at the cosine or above (copies included),
    ``component_id`` is the smallest id that links reach, its own included, and ``kept`` marks the
    vectors that bear this id. ``fit_rows`` bounds the sample that the codes are learned from.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be above 0 and at most 1")
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("valid", F.coalesce(_valid(F.col("v")), F.lit(False)))
    sample, n = _sample(rows, fit_rows)
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    tables = learn(sample, n, cosine, aim)
    near = tables.near
    coded = stored(_coded(rows, spark.sparkContext.broadcast(tables)))

    documents = coded.select("id", "set_id")
    having = coded.where(F.col("set_id").isNotNull())
    copies = having.groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    classes = having.select(F.col("set_id").alias("member"), "n", "keys", "code").dropDuplicates(["member"])
    entries = stored(classes.select("member", F.lit(1).cast("long").alias("n"), "code", F.explode("keys").alias("component")))
    pairs = block_pairs(entries, 1, 1, BLOCK_CODES).withColumn("copies", F.lit(1))
    edges = block_forests(pairs, "code", "u1", codes_near(near), 1, 1).select(F.col("member").alias("a"), F.col("to").alias("b"))
    found = written(connected_components(edges).select(F.col("node").alias("member"), F.col("label").alias("component")))

    vectors = having.select(F.col("set_id").alias("member"), "n", "v").join(found.select("member"), "member", "left_semi").dropDuplicates(["member"])
    members = found.join(copies.select(F.col("set_id").alias("member"), "copies"), "member").join(vectors, "member")
    blocks = block_pairs(stored(members), 1, 1, BLOCK_VECTORS)
    said = written(block_forests(blocks, "v", "<f8", vectors_near(cosine), 1, 1)).withColumnRenamed("member", "set_id")
    per_class = component_table(said, copies)
    return documents.join(per_class, "set_id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))
