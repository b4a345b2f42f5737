"""Near-duplicate join on word shingles: a grouped prefix join.

A document is the set of its shingles' 64-bit hashes. With a global order of shingles, two
sets of a Jaccard similarity of at least t share a shingle among the first
n - ceil(t n) + 1 of each, its prefix. The steps:

1. Equal sets become one class: copies are never compared.
2. Classes of equal size and prefix become one group; the group's prefix is posted once.
   Posting lists of the same groups (all those of two near copies, say) are kept once.
3. Group pairs that share a prefix shingle are filtered on what groups know: sizes, and how
   many shingles up to the shorter prefix's end only one of them has. Two sets of similarity t
   differ in few, so pairs that merely share a passage go. What remains is kept as a spanning
   forest, whose components hold every pair that can link.
4. A component's members are expanded and verified on their whole sets, which only its
   documents are read again for. Again a spanning forest of the links is kept, and each
   member's number of links, not its pairs.
5. Components of the verified links give each document its component.

In steps 3 and 4 the rows of a key (a shingle, a component) that fit are one block. More are
cut by size class and hash into blocks, and only block pairs whose sizes can reach t meet,
each in a task's turn of its own; so no key is held whole, and no pair is a row.

The order is rarest first for the ``FREQUENT`` most frequent shingles (which come last) and
by hash before them. Any order gives the same result; this one keeps common passages out of
prefixes. Shingle counts come from all documents; a task passes on those that it met twice.

Defined results for odd input: a text with fewer words than a shingle is one shingle, of all
its words; a null or empty text, or one without words, has no shingles and is a component of
its own; repeated rows are copies; a null id never names a component with other members; a
component of null ids only has a null id; an empty table gives an empty result. Only ASCII
letters are lower-cased; words are runs of other characters than space and \\t \\n \\v \\f \\r.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from zonecast.llm.batches import kept, pieces, stored, unused, utf8, written
from zonecast.llm.graph import component_table, connected_components

FREQUENT = 3_000_000
KNOWN_CODES = 1024
BLOCK_SETS = 512
BLOCK_SHINGLES = 1_000_000
REMEMBERED = 100_000
COUNTED = 1_000_000
LISTED = 200_000
WANTED_BITS = 1 << 24
LATE = 49_152


# ---------------------------------------------------------------- shingles

class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; word hashes are remembered, up to a bound."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}
        self.factors = np.array([xxhash.xxh3_64_intdigest(b"factor", seed=k) | 1 for k in range(words)], np.uint64)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: ASCII letters, and exactly the six white characters
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        w = self._hashes(words)
        n = len(w) - self.words + 1
        h = np.zeros(n, np.uint64)
        for k, f in enumerate(self.factors):
            h += w[k : k + n] * f
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_id(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _shingler(words: int) -> Shingler:
    return kept(("shingles", words), lambda: Shingler(words))


def _least_overlap(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


# ---------------------------------------------------------------- passes over the texts

def _classes(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents (id, row, n, set_id) and rows of shingles met twice in a task (shingle, met)."""
    schema = T.StructType([docs.schema["id"], T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()),
                           T.StructField("shingle", T.LongType()), T.StructField("met", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, seen, kind = _shingler(words), [], 0, set(), None

        def met() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            keys, n = keys[n > 1], n[n > 1]
            none = [pa.nulls(len(keys), t) for t in (kind, pa.int64(), pa.int64(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema.names)

        for batch in pieces(batches, "text"):
            kind, ns, ids = batch.schema.field("id").type, [], []
            for text in utf8(batch.column("text")):
                h = own.shingles(text)
                ns.append(len(h))
                ids.append(set_id(h) if len(h) else None)
                if len(h) and ids[-1] not in seen:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(ids[-1])
                    held.append(h)
                    size += len(h)
                if size > COUNTED:
                    yield met()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(ns, pa.int64()), pa.array(ids, pa.binary()),
                                              pa.nulls(len(ns), pa.int64()), pa.nulls(len(ns), pa.int64())], schema.names)
        if held:
            yield met()

    return docs.mapInArrow(run, schema)


def _prefixes(docs: DataFrame, words: int, num: int, den: int, frequent) -> DataFrame:
    """Rows of classes (row, n, set_id, group, codes, prefix, short), a class once in a task.

    ``codes`` are the places of the prefix's first KNOWN_CODES in the global order, in 16 bits:
    the filter needs no more than a known stretch of a set, and a row stays small. Places by hash
    go through a square root, as prefixes hold the smallest; LATE and above are frequent shingles. ``prefix``, the
    shingles to post, has a group once in a task; the first ``short`` of them are enough to meet
    sets of no smaller size. Sets too small to reach the similarity with any other have no row.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()),
                           T.StructField("group", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("prefix", T.BinaryType()), T.StructField("short", T.IntegerType())])
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (keys, ranks), groups, sets = _shingler(words), frequent.value, set(), set()
        for batch in pieces(batches, "text"):
            at, found = [], []
            for k, text in enumerate(utf8(batch.column("text"))):
                h = own.shingles(text)
                n = len(h)
                if not n or n * den < num * (n + 1):
                    continue
                s = set_id(h)
                if s in sets:
                    continue
                if len(sets) > REMEMBERED:
                    sets.clear()
                    groups.clear()
                sets.add(s)
                place = np.searchsorted(keys, h)
                place[place == len(keys)] = 0
                late = keys[place] == h if len(keys) else np.zeros(n, bool)
                size = n - _least_overlap(n, num, den) + 1
                prefix = h[~late][:size]
                codes = np.sqrt(prefix.astype(float) / 2.0**64) * LATE
                if len(prefix) < size:
                    common, place = h[late], ranks[place[late]]
                    order = np.argsort(place)[: size - len(prefix)]
                    prefix = np.concatenate([prefix, common[order]])
                    codes = np.concatenate([codes, LATE + (place[order].astype(float) + FREQUENT) * ((65_535 - LATE) / FREQUENT)])
                group = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=n)
                at.append(k)
                found.append((n, s, group - (1 << 64) if group >> 63 else group, codes[:KNOWN_CODES].astype("<u2").tobytes(),
                              None if group in groups else prefix.astype("<u8").tobytes(), n - _least_overlap(2 * n, num, num + den) + 1))
                groups.add(group)
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int32())), *[pa.array(c, k) for c, k in zip(zip(*found), kinds)]], schema.names)

    return docs.mapInArrow(run, schema)


def _postings(classes: DataFrame) -> DataFrame:
    """(shingle, group, n, short) of every posted shingle."""
    schema = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("group", T.LongType()), T.StructField("n", T.LongType()), T.StructField("short", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                prefixes = [np.frombuffer(x, "<i8") for x in part.column("prefix").to_pylist()]
                sizes = np.array([len(x) for x in prefixes])
                if not len(sizes):
                    continue
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                each = lambda c: np.repeat(part.column(c).to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), pa.array(each("group")), pa.array(each("n")), pa.array(place < each("short"))], schema.names)

    return classes.where(F.col("prefix").isNotNull()).select("group", "n", "prefix", "short").mapInArrow(run, schema)


def _shared(postings: DataFrame) -> DataFrame:
    """(component, member, n): the groups of every posting list of two or more, equal lists once in a task.

    A list is named by a hash of its groups, so equal lists of different shingles are one
    component (and lists of one name would be compared as one, which loses nothing). A list longer
    than LISTED is passed on under its shingle as it comes, not held.
    """
    schema = T.StructType([T.StructField("component", T.LongType()), T.StructField("member", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        seen: set[int] = set()
        streamed = None  # the shingle of a list that is being passed on

        def lists(columns: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch | None]:
            nonlocal streamed
            shingle, group, n, short = columns
            new = np.ones(len(shingle), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (group[1:] != group[:-1])  # a group that several tasks have posted
            at = np.flatnonzero(new)
            short = np.logical_or.reduceat(short, at) if len(at) else short
            shingle, group, n = shingle[at], group[at], n[at]
            starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.empty(0, int)
            ends = np.append(starts[1:], len(shingle))
            out = []
            keep = 0 if last or not len(starts) else ends[-1] - starts[-1]  # the last list may go on
            if keep and (keep > LISTED or shingle[-1] == streamed):
                keep = 1  # so that a group posted twice across the cut is seen
            for a, b in zip(starts.tolist(), ends.tolist()):
                if shingle[a] == streamed or b - a > LISTED:
                    streamed = shingle[a]
                    out.append((np.full(b - a, shingle[a]), group[a:b], n[a:b]))
                elif b - a > 1 and (last or b < len(shingle)) and short[a:b].any():
                    name = xxhash.xxh3_64_intdigest(group[a:b].tobytes())
                    if name not in seen:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.add(name)
                        out.append((np.full(b - a, np.uint64(name)).view(np.int64), group[a:b], n[a:b]))
            rest = [c[len(c) - keep :] for c in (shingle, group, n, short)] if keep else [c[:0] for c in columns]
            return rest, pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema.names) if out else None

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "group", "n", "short")]
            held, made = lists([np.concatenate([x, y]) for x, y in zip(held, own)], False)
            if made is not None:
                yield made
        _, made = lists(held, True)
        if made is not None:
            yield made

    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return postings.repartition(parts, "shingle").sortWithinPartitions("shingle", "group").mapInArrow(run, schema)


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(member, shingles) of the documents whose text hash is wanted, and of a few more.

    A bitmap of WANTED_BITS says which texts to read, so it is bounded; where it says yes by
    accident the later join says no. A task gives each set once.
    """
    bit = F.pmod(F.col("row"), F.lit(WANTED_BITS))
    maps = wanted.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    table = np.zeros(WANTED_BITS // 32768 + 2, "V4096")
    for r in maps:
        table[r.k] = bytes(r.bits)
    shared = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))
    schema = T.StructType([T.StructField("member", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bits, seen = _shingler(words), shared.value, set()
        for batch in batches:
            at = batch.column("row").to_numpy(zero_copy_only=False) % WANTED_BITS
            # Spark counts buckets from 1 for positive numbers (bit 0 of the first is 1), and 0 has the bucket 0
            bucket = np.where(at > 0, (at - 1) // 32768 + 1, 0)
            position = np.where(at > 0, (at - 1) % 32768, 0)
            hit = (bits[bucket * 4096 + position // 8] >> (position % 8)) & 1 == 1
            for part in pieces(iter([batch.filter(pa.array(hit))]), "text"):
                ids, sets = [], []
                for text in utf8(part.column("text")):
                    h = own.shingles(text)
                    if (s := set_id(h)) not in seen:
                        if len(seen) > REMEMBERED:
                            seen.clear()
                        seen.add(s)
                        ids.append(s)
                        sets.append(h.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], schema.names)

    return docs.select("row", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- verification

def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of how many elements two arrays of distinct elements share, exactly: products of 0/1 matrices."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= 4:
        for i in range(m):
            for j in range(i):
                both = np.concatenate([sets[i], sets[j]])
                both.sort()
                out[i, j] = out[j, i] = (both[1:] == both[:-1]).sum()
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(every)]]))
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    shared = np.repeat(counts > 1, counts)
    column, owner = column[shared], owner[shared]
    width = max(256, 4_000_000 // m)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((m, int(column[hi - 1]) - at + 1), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def linked(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which whole sets reach the similarity."""
    inter = shared_counts(sets)
    out = inter * den >= num * (sizes[:, None] + sizes[None, :] - inter)
    np.fill_diagonal(out, False)
    return out


def may_link(codes: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which groups may hold sets that reach the similarity.

    Below the last code of the list that ends first (in the global order) both sets are known, so
    distinct codes there that only one of them has are differences. At that code itself a list may
    be cut off. Equal codes of different shingles count once, which can only let a pair pass.
    """
    codes = [np.unique(c) for c in codes]
    last = np.array([c[-1] for c in codes])
    below = np.array([np.searchsorted(c, last) for c in codes])  # of each, how many below each last
    has = np.array([np.searchsorted(c, last, side="right") for c in codes]) - below
    at_end = np.where(last[None, :] <= last[:, None], has, has.T)  # 1 if both have the code where the first list ends
    below = np.minimum(below, below.diagonal()[:, None])
    differ = below + below.T - 2 * (shared_counts(codes) - at_end)
    both = sizes[:, None] + sizes[None, :]
    out = (differ <= both - 2 * -(-both * num // (num + den))) & (np.minimum.outer(sizes, sizes) * den >= num * np.maximum.outer(sizes, sizes))
    np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the first row that it is connected to."""
    label = np.arange(len(links))
    while True:
        best = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        now = np.minimum(label, best)
        now = now[now]
        if (now == label).all():
            return label
        label = now


_KEY = ("component", "c1", "b1", "c2", "b2")


def block_forests(rows: DataFrame, payload: str, unit: str, test, num: int, den: int) -> DataFrame:
    """(member, to, n_links) for rows sorted by block pair: a spanning edge, if any, and what a member links to, in copies.

    ``test`` makes the matrix of links of a block from the members' payloads, arrays of ``unit``.
    """
    schema = T.StructType([rows.schema["member"], T.StructField("to", rows.schema["member"].dataType), T.StructField("n_links", T.LongType())])
    kind = pa.binary() if isinstance(rows.schema["member"].dataType, T.BinaryType) else pa.int64()

    def block(key: list, held: list) -> tuple[list, list, list]:
        unique = {x[0]: x for x in held}  # a member once, though several tasks have met it
        if len(unique) < 2:
            return [], [], []
        ids, sides, copies, sizes, data = zip(*unique.values())
        links = test([np.frombuffer(x, unit) for x in data], np.array(sizes, np.int64), num, den)
        if key[1:3] != key[3:]:  # of two blocks, only pairs across them; pairs inside have their own turn
            side = np.array(sides)
            links &= side[:, None] != side[None, :]
        if not links.any():
            return [], [], []
        n, to = links @ np.array(copies, np.int64), forest(links)
        own = np.flatnonzero(n > 0).tolist()
        return [ids[i] for i in own], [ids[to[i]] for i in own], n[own].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], ([], [], [])

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], kind), pa.array(out[2], pa.int64())], schema.names)
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*_KEY, "member", "side", "copies", "n", payload)]
            for *now, member, side, copies, n, data in zip(*columns):
                if now != key:
                    for x, y in zip(out, block(key, held) if len(held) > 1 else ()):
                        x += y
                    key, held = now, []
                    if len(out[0]) > 10_000:
                        yield made()
                held.append((member, side, copies, n, data))
        for x, y in zip(out, block(key, held) if len(held) > 1 else ()):
            x += y
        yield made()

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, schema)


def block_pairs(members: DataFrame, num: int, den: int, most: int = BLOCK_SETS) -> DataFrame:
    """The members (component, member, n, ...) once for each block pair that they take part in."""
    size_class = F.floor(F.log("n") / math.log(den / num) + 1e-9).cast("int") if num < den else F.col("n").cast("int")
    members = members.withColumn("c", size_class)
    whole = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).where("m > 1")
    whole = whole.withColumn("fits", (F.col("m") <= most) & (F.col("w") <= BLOCK_SHINGLES))
    parts = members.groupBy("component", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).select(
        "component", "c", F.greatest(F.ceil(F.col("m") / most), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    parts = parts.join(whole.where("NOT fits").select("component"), "component", "left_semi")
    listed = parts.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("c", "blocks"))).alias("blocks"))  # bounded: a class is a factor of size
    rows = members.join(whole.select("component", "fits"), "component").join(listed, "component", "left")
    own = F.pmod(F.xxhash64("member"), F.element_at("blocks", F.col("c")).cast("long")).cast("int")
    one = F.struct(F.lit(0).alias("c1"), F.lit(0).alias("b1"), F.lit(0).alias("c2"), F.lit(0).alias("b2"), F.lit(0).alias("side"))

    def across(step: int):
        """Pairs with the blocks of the class below, the same class, or the class above."""
        other = F.col("c") + step
        n = F.coalesce(F.try_element_at("blocks", other), F.lit(0))
        js = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def pair(j):
            first = (j >= F.col("b")) if step == 0 else F.lit(step > 0)
            c, b = F.col("c"), F.col("b")
            return F.struct(F.when(first, c).otherwise(other).alias("c1"), F.when(first, b).otherwise(j).alias("b1"),
                            F.when(first, other).otherwise(c).alias("c2"), F.when(first, j).otherwise(b).alias("b2"),
                            F.when(first, 0).otherwise(1).alias("side"))

        return F.transform(js, pair)

    pairs = F.when(F.col("fits"), F.array(one)).otherwise(F.concat(across(-1), across(0), across(1)))
    return rows.withColumn("b", own).withColumn("pair", F.explode(pairs)).select("component", "pair.*", *[c for c in members.columns if c not in ("component", "c")])


# ---------------------------------------------------------------- the join

def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id, row, n_shingles, set_id, n_links, component_id): one row for each document.

    Documents link where their sets' Jaccard similarity is num / den or more. ``n_links``
    counts a document's links (copies included), ``component_id`` is the smallest id that
    links reach, its own included, ``row`` a hash of id and text, and ``set_id`` the class of
    equal sets (null without shingles).
    """
    spark = docs.sparkSession
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    first = stored(_classes(docs, words))
    documents = first.where(F.col("shingle").isNull()).select("id", "row", "n", "set_id")
    often = first.where(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("met").alias("met")).orderBy(F.desc("met"), "shingle").limit(FREQUENT).toArrow()
    keys = often.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], -order.astype(np.int32)))  # the rarer comes first; bounded by FREQUENT

    texts = docs.select("row", "text")
    classes = stored(_prefixes(texts, words, num, den, frequent))
    met = _shared(_postings(classes)).dropDuplicates(["component", "member"])
    codes = classes.groupBy(F.col("group").alias("member")).agg(F.min("codes").alias("codes"))
    pairs = block_pairs(written(met), num, den).join(codes, "member").withColumn("copies", F.lit(1))
    edges = block_forests(pairs, "codes", "<u2", may_link, num, den).select(F.col("member").alias("a"), F.col("to").alias("b"))
    found = connected_components(edges).withColumnsRenamed({"node": "group", "label": "component"})

    copies = documents.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
    members = classes.groupBy("set_id").agg(F.min("group").alias("group"), F.min("n").alias("n"), F.min("row").alias("row"))
    members = members.join(found, "group", "left").select(F.coalesce("component", "group").alias("component"), "set_id", "n", "row")
    several = members.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("component")
    members = written(members.join(several, "component", "left_semi").join(copies.select("set_id", "copies"), "set_id").withColumnRenamed("set_id", "member"))

    pairs = block_pairs(members.drop("row"), num, den).join(_sets_of(docs, members, words), "member")
    said = written(block_forests(pairs, "shingles", "<u8", linked, num, den)).withColumnRenamed("member", "set_id")

    per_set = component_table(said, copies)
    return documents.join(per_set, "set_id", "left").select(
        F.col("id").alias(id_col), "row", F.col("n").alias("n_shingles"), "set_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows, whole, of one document for each component: the one of smallest id.

    A row is recognised by a hash of its id and text. Equal rows are one document, of which one
    row stays. In a component of null ids one row stays too. Rows without shingles each stay.
    """
    found = jaccard_join(docs, id_col, text_col, words, num, den)
    # with one id on several texts of a component, the smallest hash decides
    keep = found.where(F.col("set_id").isNotNull() & F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(
        "component_id", F.when(F.col(id_col).isNull(), F.col("set_id"))).agg(F.min("row").alias("k")).select("k")
    row = unused(docs, "_row")
    own = docs.withColumn(row, F.xxhash64(id_col, text_col)).join(keep.withColumnRenamed("k", row), row, "left_semi")
    bare = docs.where(~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return own.dropDuplicates([row, id_col]).drop(row).unionByName(bare)
