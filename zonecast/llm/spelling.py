"""Spelling variants: words one code point apart, found with a bit-sliced position index.

The index of a block of words has, for each (position, letter), a bitset of the words that have
the letter there. A query word runs over its letters once, all words of the block at a time,
with three bitsets: E, the words that agree so far; S, those that agree but for one replaced
letter; and I, those that agree with all their letters after some place shifted by one.
With the bitsets b of the query's letter at its position and c of it one position later:

    I = (I | E) & c        S = (S & b) | (E & ~b)        E = E & b

At the end S holds the words of the same length that are one replacement away, and I | E those
one letter longer that are one insertion away. Deletions are the same pairs from the other side.

Two words one edit apart agree in their first or in their last h letters, h being half the
shorter length. So words are dealt by (shorter length, side, those letters), a shuffle of four
small rows for each word, and only words dealt alike have to meet. A task fills blocks with such
groups; bitsets of groups keep the pairs of one group, and a pair that agrees on both sides
counts on the first. A group too large for a block is cut by hash, and its block pairs go to
tasks of their own, so no hot beginning of words is held whole; pairs never become rows of
a join, a task sums them up by word.

Counts come from all occurrences in whole texts; a task adds up its own first. A word's form
(see ``variants``) is ten times as frequent, so chains of forms are short; roots come from
doubling steps, each a join of the words that have a form.

Defined results for odd input: a null or empty text has no words; a null id is the empty text in
the hashed key; repeated rows each count; letters are those of the pattern and only A-Z are
lower-cased (U+00D7 and U+00F7 lie in the range and count as letters); very long texts are read
whole, in slices that end between words; very long words are compared like any; ties take the
word first in code-point order; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from zonecast.llm.batches import pieces, stored, written

LETTERS = "A-Za-zÀ-ÿ"
COUNTED = 300_000
BLOCK_WORDS = 1024
BLOCK_LETTERS = 4 << 20
GROUP_WORDS = 4096
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


# ---------------------------------------------------------------- words

def word_counts(docs: DataFrame, id_col: str, text_col: str, drop_every: int | None, least: int) -> DataFrame:
    """(word, n): words of at least ``least`` letters and their occurrences in all texts.

    Where ``drop_every`` is given, it divides the CRC-32 of ``<id>:<run>``, h, for some runs; these
    lose their code point h % length.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(f"[{LETTERS}]{{{least},}}"), Counter()

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema.names)
            total.clear()
            return batch

        for batch in pieces(batches, "text"):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                text = text.lower() if text.isascii() else text.translate(_LOWER)
                key = zlib.crc32(f"{doc}:".encode())
                for own in _slices(text):
                    for word, n in Counter(runs.findall(own)).items():
                        if drop_every:
                            h = zlib.crc32(word.encode(), key)
                            if h % drop_every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least:
                                    continue
                        total[word] += n
                    if len(total) > COUNTED:
                        yield made()
        yield made()

    return docs.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def _slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end between words."""
    if len(text) <= size:
        yield text
        return
    at, gap = 0, re.compile(f"[^{LETTERS}]")
    while at < len(text):
        cut = gap.search(text, at + size) if at + size < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


# ---------------------------------------------------------------- the index

class PositionIndex:
    """Bitsets over the words of a block (rows of letters, 0 after the end) by position and letter."""

    def __init__(self, letters: np.ndarray):
        values, codes = np.unique(letters, return_inverse=True)
        self.codes = codes.reshape(letters.shape)
        self.values = len(values)
        self.ids = np.arange(self.values)[:, None]
        self.words = len(letters)

    def at(self, position: int) -> np.ndarray:
        """[letter, word] bits of one position, 64 words to an integer."""
        return bits(self.codes[:, position] == self.ids)


def bits(marks: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit integers."""
    packed = np.packbits(marks, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def one_apart(letters: np.ndarray, shorter: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows one edit apart, each pair once; one of the two has ``shorter`` letters.

    ``letters`` has shorter + 1 columns, 0 after a word's end; ``allowed`` [row, word] are bitsets
    of the words that a row may be paired with.
    """
    index = PositionIndex(letters)
    short = letters[:, shorter] == 0
    same, longer = bits(short[None, :]), bits(~short[None, :])
    found = []
    for rows in np.array_split(np.flatnonzero(short), max(1, int(short.sum()) * same.shape[1] >> 20)):
        own = index.codes[rows]
        equal = np.full((len(rows), same.shape[1]), ~np.uint64(0))
        replaced, shifted = np.zeros_like(equal), np.zeros_like(equal)
        here = index.at(0)
        for i in range(shorter):
            after = index.at(i + 1)
            letter = own[:, i]
            b = here[letter]
            shifted |= equal
            shifted &= after[letter]
            replaced &= b
            replaced |= equal & ~b
            equal &= b
            here = after
        near = ((replaced & same) | ((shifted | equal) & longer)) & allowed[rows]
        hit = near.any(axis=1)
        if hit.any():
            r, w = np.nonzero(np.unpackbits(near[hit].view(np.uint8), axis=1, bitorder="little"))
            found.append((rows[np.flatnonzero(hit)[r]], w))
    i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))
    once = ~short[j] | (i < j)  # two words of the shorter length find each other
    return i[once], j[once]


_GROUP = ("shorter", "side", "key", "b1", "b2")


def _near(rows: DataFrame) -> DataFrame:
    """(word, n_near, best) for rows sorted by group: how many near words a task found, and the most frequent (n, word)."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()),
                           T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType())])

    def block(shorter: int, side: int, groups: list, parts: list, words: list, ns: list, out: dict) -> None:
        text = "".join(w.ljust(shorter + 1, "\0") for w in words).encode("latin-1")
        letters = np.frombuffer(text, np.uint8).reshape(len(words), shorter + 1)
        group, part = np.array(groups), np.array(parts)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        allowed = bits(group[first][:, None] == group)[np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))]
        if part.any():  # a pair of blocks of a hot group stands alone: only pairs across them
            allowed &= bits(part[:, None] != part)
        i, j = one_apart(letters, shorter, allowed)
        h = shorter // 2
        agree = (letters[i, :h] == letters[j, :h]).all(axis=1)  # also rules out that unequal keys had one hash
        own = agree if side == 0 else ~agree
        for a, b in zip(i[own].tolist(), j[own].tolist()):
            for x, y in ((a, b), (b, a)):
                had = out.get(words[x])
                if had is None:
                    out[words[x]] = [1, ns[y], words[y]]
                else:
                    had[0] += 1
                    if ns[y] > had[1] or ns[y] == had[1] and words[y] < had[2]:
                        had[1:] = ns[y], words[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {}
        head, hot = None, False
        groups, parts, words, ns, last, g = [], [], [], [], None, 0

        def flush() -> None:
            if len(words) > 1:
                block(head[0], head[1], groups, parts, words, ns, out)
            for x in (groups, parts, words, ns):
                x.clear()

        def made() -> pa.RecordBatch:
            columns = [list(out)] + [[v[k] for v in out.values()] for k in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], schema.names)

        for batch in batches:
            for *now, word, n, part in zip(*[batch.column(c).to_pylist() for c in (*_GROUP, "word", "n", "part")]):
                if now != last:
                    if now[:2] != head or hot or now[4] >= 0 or len(words) >= BLOCK_WORDS or len(words) * now[0] >= BLOCK_LETTERS:
                        flush()
                        head, hot = now[:2], now[4] >= 0
                        if len(out) > COUNTED:
                            yield made()
                    last, g = now, g + 1
                groups.append(g)
                parts.append(part)
                words.append(word)
                ns.append(n)
        flush()
        yield made()

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(run, schema)


def _dealt(words: DataFrame, least: int) -> DataFrame:
    """The words once for each group that they take part in, or for each block pair of a hot group."""
    length = F.length("word")

    def sides(shorter):
        h = F.floor(shorter / 2).cast("int")
        return [F.struct(shorter.alias("shorter"), F.lit(s).alias("side"), F.xxhash64(k).alias("key"))
                for s, k in ((0, F.substr("word", F.lit(1), h)), (1, F.substr("word", length - h + 1, h)))]

    every = F.concat(F.array(*sides(length)), F.when(length > least, F.array(*sides(length - 1))).otherwise(F.array().cast("array<struct<shorter:int,side:int,key:bigint>>")))
    rows = words.select("word", "n", F.explode(every).alias("at")).select("at.*", "word", "n")
    sizes = rows.groupBy("shorter", "side", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = rows.join(sizes, ["shorter", "side", "key"])
    blocks = F.ceil(F.col("m") / GROUP_WORDS).cast("int")
    b = F.pmod(F.xxhash64("word"), blocks.cast("long")).cast("int")
    pair = lambda j: F.struct(F.least(b, j).alias("b1"), F.greatest(b, j).alias("b2"), (b > j).cast("int").alias("part"))
    whole = F.array(F.struct(F.lit(-1).alias("b1"), F.lit(-1).alias("b2"), F.lit(0).alias("part")))
    pairs = F.when(blocks > 1, F.transform(F.sequence(F.lit(0), blocks - 1), pair)).otherwise(whole)
    return rows.select("shorter", "side", "key", "word", "n", F.explode(pairs).alias("pair")).select("shorter", "side", "key", "pair.*", "word", "n")


# ---------------------------------------------------------------- variants

def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2,
             factor: int = 10, drop_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``least`` letters that occurs ``occurrences`` times.

    A word's near words differ by one inserted, deleted or replaced code point. Its form is the
    most frequent of them (of equal ones the first in code-point order) if that is ``factor`` times
    as frequent as the word, else null; its root is the last of the chain of forms, or itself.
    """
    if least < 2:
        raise ValueError("words of one letter agree on neither side")
    words = stored(word_counts(docs, id_col, text_col, drop_every, least).where(F.col("n") >= occurrences))
    found = _near(_dealt(words, least)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    joined = words.join(found, "word", "left")
    has = -F.col("best.n") >= factor * F.col("n")
    rows = stored(joined.select("word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(has, -F.col("best.n")).alias("form_n")))
    roots = _roots(rows.where(F.col("form").isNotNull()).select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: each step follows twice as many forms as the one before."""
    now = written(links.withColumnRenamed("form", "root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = written(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.select("word", "root")
        if not joined.where("moved").limit(1).count():
            return now
