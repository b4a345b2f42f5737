"""Quality rules as a bitmask ledger.

One pass over the texts evaluates every rule once and writes a ledger row: the measurements
and one bit for each rule that fails. Policies are versioned sets of rules. Applying one, and
finding what each of its rules decides alone (ablation), is arithmetic on the bits; no text
is read again.

Words are runs of other characters than space and \\t \\n \\v \\f \\r. Comparisons are in
integers, so a verdict doesn't depend on rounding.

Defined results for odd input: a null or empty text has no words, measurements of 0 and fails
``few_words``; repeated rows each keep their row; an empty table gives an empty ledger;
further columns are carried or ignored, never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from zonecast.llm.batches import pieces, utf8

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_latin", "n_echoes")
PREFIX = "_quality_"  # of the columns that keep() adds for a while


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``factor`` times one measure exceeds ``per`` times another plus ``least`` (or, with ``below``, falls under it)."""

    name: str
    measure: str
    factor: int
    per: int
    of: str | None
    least: int = 0
    below: bool = False

    def fails(self, prefix: str = "") -> Column:
        bound = F.lit(self.least) + (F.lit(self.per) * F.col(prefix + self.of) if self.of else F.lit(0))
        value = F.lit(self.factor) * F.col(prefix + self.measure)
        return value < bound if self.below else value > bound


# A rule's place is its bit: append only.
RULES = (
    Rule("few_words", "n_words", 1, 0, None, 20, below=True),
    Rule("repeated_words", "n_repeat_words", 100, 30, "n_words"),
    Rule("short_words", "word_chars", 1, 2, "n_words", below=True),
    Rule("long_words", "word_chars", 1, 20, "n_words"),
    Rule("symbols", "n_symbols", 100, 10, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", 100, 50, "n_lines"),
    Rule("shouting", "n_upper", 100, 60, "n_latin"),
    Rule("echoes", "n_echoes", 100, 30, "n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that it applies."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(r) for r in self.rules)


def bit(rule: str) -> int:
    return 1 << [r.name for r in RULES].index(rule)


BASE = Policy("base-1", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("web-1", tuple(r.name for r in RULES)),
)}
CURRENT = POLICIES["web-1"]


# ---------------------------------------------------------------- measurements

def measure(text: bytes) -> tuple[int, ...]:
    """The measures of one UTF-8 text, in the order of MEASURES."""
    words = text.split()  # of bytes: at exactly the six characters above
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    solid = text.translate(None, SPACE)
    upper = len(solid) - len(solid.translate(None, UPPER))
    return (len(words), len(solid) if solid.isascii() else len(solid.decode()), len(solid) - len(solid.translate(None, SYMBOLS)),
            len(lines), len(lines) - len(set(lines)), repeated_words(words), upper, upper + len(solid) - len(solid.translate(None, LOWER)),
            sum(map(eq, words, words[1:])))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside some window of that many words that occurs twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # Ranks of 1, 2, 4, ... words: two equal ranks make a rank of twice the length, without hashing.
    rank, width = ids, 1
    while width < window:
        step = min(width, window - width)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        width += step
        if width < window:
            rank = np.unique(pair, return_inverse=True)[1]
        else:
            rank = pair
    order = np.argsort(rank, kind="stable")
    same = np.flatnonzero(rank[order[1:]] == rank[order[:-1]])
    if not len(same):
        return 0
    found = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


# ---------------------------------------------------------------- ledger

def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures..., failed): one row for each document; ``failed`` has the bits of the rules that fail."""
    docs = docs.select(id_col, text_col)
    schema = T.StructType([docs.schema[id_col], *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *_measured(batch, text_col)], [id_col, *MEASURES])

    return docs.mapInArrow(run, schema).withColumn("failed", failed_bits())


def _measured(batch: pa.RecordBatch, text_col: str) -> list[pa.Array]:
    rows = [measure(t) for t in utf8(batch.column(text_col))]
    return [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]


def failed_bits(prefix: str = "") -> Column:
    """Every rule evaluated once, on the measures' columns."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rule.fails(prefix), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def verdict(policy: Policy = CURRENT, failed: str = "failed") -> Column:
    """Whether the policy keeps a ledger row."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy = CURRENT, failed: str = "failed") -> DataFrame:
    """(version, rule, n_failed, n_only, n_kept_without): what each rule of a policy decides, over a ledger.

    The ledger is first reduced to its distinct bit patterns (two to the number of rules at
    most), so the rules' counts are sums over a small table.
    """
    masked = F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = rows.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    each = patterns.select("bits", "n", names).select("bits", "n", "r.*")
    own = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").bitwiseOR(F.col("bit")) == F.col("bit"), F.col("n")).otherwise(0)).alias("n_kept_without"),
    ).select(F.lit(policy.version).alias("version"), "rule", "n_failed", "n_only", "n_kept_without")


def keep(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows, whole, that the policy keeps: measured and judged in one pass, without a shuffle."""
    prefix = PREFIX
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    own = [f"{prefix}{m}" for m in MEASURES]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, *_measured(batch, text_col)], [*batch.schema.names, *own])

    measured = docs.mapInArrow(run, schema)
    return measured.withColumn(f"{prefix}failed", failed_bits(prefix)).where(verdict(policy, f"{prefix}failed")).drop(*own, f"{prefix}failed")
