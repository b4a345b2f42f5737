"""Order-preserving packing of documents into training sequences.

Documents keep the order in which their partition holds them. Their ids form one stream,
which is cut into windows of at most ``size`` ids. Cuts may lie behind a document (free),
behind a sentence (a small truncation penalty), or, inside a stretch without sentence ends,
at every ``stride`` ids (a larger one). Dynamic programming over these places minimises
padding plus penalties. With p the place of a cut and cost(j) the least cost up to it,

    cost(j) = penalty(j) + min over i with p(j) - size <= p(i) < p(j) of cost(i) + size - (p(j) - p(i))

so g = cost + p obeys g(j) = penalty(j) + size + (least g in the window), which a monotone
queue yields in constant time for each place.

Every partition is a stream of its own and is packed in bounded memory: windows are settled
a few hundred thousand ids at a time, and only the last few, still open ones are carried on.
Nothing is shuffled, and a lost task is run again with the same result, since it depends
only on the partition's rows. Only the last window of a partition can be badly filled.

Defined results for odd input: a null or empty text is the end id alone; repeated rows and
null ids are documents of their own; an empty table gives no pieces; a text of any length
is encoded whole; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from zonecast.llm.batches import kept, pieces, utf8

SIZE = 1024
SENTENCE_PENALTY = 4
HARD_PENALTY = 24
STRIDE = 16
SETTLE = 1 << 19
OPEN_WINDOWS = 8


# ---------------------------------------------------------------- ids

def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte as one printable character: itself, or one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE from a tokenizers file: its ranks, special strings and split pattern."""

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        said = json.loads(text)
        self.digest = hashlib.sha256(text.encode()).hexdigest()
        alphabet = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.ranks = {bytes(alphabet[c] for c in token): n for token, n in said["model"]["vocab"].items() if token not in self.special}


class Encoder:
    """Whole texts to ids. What stands between single spaces is remembered when it comes again, up to a bound."""

    MOST_WORDS = 100_000
    LONG_WORD = 64
    MET = 1 << 20

    def __init__(self, bpe: ByteBpe):
        import tiktoken

        self.special = bpe.special
        self._bpe = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks, special_tokens=bpe.special)
        self._any_special = re.compile("|".join(map(re.escape, bpe.special)) or "(?!)")
        self._words: dict[str, bytes] = {}
        self._met = bytearray(self.MET)  # by hash, which words have been met; a word met once isn't worth its place
        self.ends_sentence = np.zeros(max([*bpe.ranks.values(), *bpe.special.values()]) + 1, bool)
        for token, n in bpe.ranks.items():
            self.ends_sentence[n] = token[-1:] in (b".", b"!", b"?", b"\n")

    def encode(self, text: str) -> np.ndarray:
        # A run of three or more white characters may be split across the places where words are cut.
        if re.search(r"\s{3}", text) or self._any_special.search(text):
            return self._bpe.encode_to_numpy(text, allowed_special="all").astype("<u4")
        words, known = text.split(" "), self._words
        words[1:] = [" " + w for w in words[1:]]
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), "<u4")
        except KeyError:
            pass
        out, new, encode = [], [], self._bpe.encode_ordinary
        for w in words:
            ids = known.get(w)
            if ids is None:
                if len(known) < self.MOST_WORDS and len(w) <= self.LONG_WORD:
                    place = hash(w) % self.MET
                    if self._met[place]:
                        ids = known[w] = np.array(encode(w), "<u4").tobytes()
                    self._met[place] = 1
                if ids is None:
                    new.append(w)  # a stretch of new words is encoded in one go
                    continue
            if new:
                out.append(np.array(encode("".join(new)), "<u4").tobytes())
                new.clear()
            out.append(ids)
        if new:
            out.append(np.array(encode("".join(new)), "<u4").tobytes())
        return np.frombuffer(b"".join(out), "<u4")


def _encoder(shared) -> Encoder:
    """The encoder of a broadcast vocabulary, with the words that it remembers, kept between a worker's tasks."""
    return kept(("packing", shared.value.digest), lambda: Encoder(shared.value))


# ---------------------------------------------------------------- cuts

def places(ids: np.ndarray, document_ends: np.ndarray, ends_sentence: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, in order, and the penalty there. The last place is the stream's end."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[np.flatnonzero(ends_sentence[ids]) + 1] = SENTENCE_PENALTY
    penalty[document_ends] = 0
    penalty[len(ids)] = max(0, int(penalty[len(ids)]))
    known = np.concatenate([[0], np.flatnonzero(penalty >= 0)])
    wide = np.flatnonzero(np.diff(known) > min(size, 2 * STRIDE))
    for a, b in zip(known[wide], known[wide + 1]):
        inside = np.arange(a + min(STRIDE, size), b, min(STRIDE, size))
        penalty[inside] = HARD_PENALTY
    at = np.flatnonzero(penalty >= 0)
    at = at[at > 0]
    return at, penalty[at]


def cuts(at: np.ndarray, penalty: np.ndarray, size: int = SIZE) -> list[int]:
    """The places of least padding plus penalties at which to cut; the last is the end."""
    where, queue = [0, *at.tolist()], deque([0])
    g, back = [0] * len(where), [0] * len(where)
    for j, p in enumerate(penalty.tolist(), 1):
        least = where[j] - size
        while where[queue[0]] < least:
            queue.popleft()
        back[j] = queue[0]
        g[j] = now = p + size + g[queue[0]]
        while queue and g[queue[-1]] >= now:
            queue.pop()
        queue.append(j)
    out, j = [], len(where) - 1
    while j:
        out.append(where[j])
        j = back[j]
    return out[::-1]


class _Stream:
    """Documents of one partition on their way into windows."""

    def __init__(self, size: int, ends_sentence: np.ndarray, partition: int):
        self.size, self.ends_sentence, self.sequence = size, ends_sentence, partition << 33
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []  # id, number of ids, place of the first (below 0: partly settled)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), self.held))
        self.ids.append(ids)
        self.held += len(ids)

    def settle(self, last: bool) -> dict[str, list]:
        """The pieces of all windows that later documents can't change (at the end: of all)."""
        if not self.held:
            return {}
        ids = np.concatenate(self.ids)
        first = np.array([p for _, _, p in self.docs])
        ends = first + np.array([n for _, n, _ in self.docs])
        windows = cuts(*places(ids, ends, self.ends_sentence, self.size), self.size)
        if not last:
            windows = windows[:-OPEN_WINDOWS]
            if not windows:
                return {}
        done = windows[-1]
        begins = np.array([0, *windows[:-1]])
        edges = np.unique(np.concatenate([[0], windows, ends[ends <= done]]))
        a, b = edges[:-1], edges[1:]
        doc, window = np.searchsorted(ends, a, side="right"), np.searchsorted(windows, a, side="right")
        raw = ids.astype("<u4", copy=False)
        out = {
            "doc": [self.docs[d][0] for d in doc.tolist()],
            "start": a - first[doc], "length": b - a,
            "ids_crc32": [zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), b.tolist())],
            "doc_tokens": (ends - first)[doc], "sequence_id": self.sequence + window, "offset": a - begins[window],
        }
        self.sequence += len(windows)
        self.docs = [(i, n, p - done) for i, n, p in self.docs if p + n > done]
        self.ids, self.held = [ids[done:].copy()], len(ids) - done
        return out


# ---------------------------------------------------------------- frames

_LONGS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   size: int = SIZE, end_id: int = 0) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    ``tokenizer`` is the path of a byte-level BPE in the tokenizers format, read by the
    driver and broadcast (its size doesn't depend on the data).
    """
    docs = docs.select(id_col, text_col)
    schema = T.StructType([docs.schema[id_col], *[T.StructField(c, T.LongType()) for c in _LONGS]])
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe(tokenizer))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(shared), np.array([end_id], "<u4")
        stream = _Stream(size, encoder.ends_sentence, TaskContext.get().partitionId())
        kind = None

        def batch_of(made: dict) -> Iterator[pa.RecordBatch]:
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(made["doc"], kind), *[pa.array(made[c], pa.int64()) for c in _LONGS]], [id_col, *_LONGS])

        for batch in pieces(batches, text_col):
            kind = batch.schema.field(id_col).type
            for doc_id, text in zip(batch.column(id_col).to_pylist(), utf8(batch.column(text_col))):
                stream.add(doc_id, np.concatenate([encoder.encode(text.decode()), end]))
                if stream.held >= SETTLE:
                    yield from batch_of(stream.settle(False))
        yield from batch_of(stream.settle(True))

    return docs.mapInArrow(pack, schema)
