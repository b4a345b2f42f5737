"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Spark counts the words of all texts. The most frequent ones (``words``, a parameter) go, with
their ids, into a minimal acyclic automaton over bytes, built from the sorted words so that
equal suffixes share their states. Its transitions carry outputs that sum up to a word's
number; the number leads to the word's ids. The automaton is a few flat arrays in one file
in the shared folder; executors fetch it once and map it into memory, so that all worker
processes of a machine share its pages. Words that it lacks are merged by the rules of the
vocabulary, exactly, with a heap. Ids therefore don't depend on which words were frequent.

The vocabulary is a file in the tokenizers format with word ends (normalisation to NFC and
lower case, white space dropped), whose path is a parameter; the driver reads it.

Defined results for odd input: a null or empty text, or one of white space, has no ids and
decodes to the empty string; strings of special tokens inside a text are those tokens, as in
the tokenizers library; texts and words of any length are encoded whole (the heap makes a
long word n log n); repeated rows each keep their row; with an empty table the automaton is
empty; other columns aren't read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from zonecast.llm.batches import pieces, shared_file, utf8
from zonecast.llm.packing import byte_alphabet

WORDS = 200_000
MOST_REMEMBERED = 150_000
BATCH_BYTES = 2 << 20
LONG_WORD = 64
NO_MERGE = (1 << 60, -1)
ODD_SPACE = regex.compile("[\x1c-\x1f]")  # white space to Python's split, but not to the vocabulary's pattern


# ---------------------------------------------------------------- vocabulary

class WordBpe:
    """A vocabulary with word ends: its words, normalisation and exact merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, split = said["model"], said["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = split["pattern"]["Regex"]
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.tokens = {n: t for t, n in (self.vocab | self.special).items()}
        letter = {b: c for c, b in byte_alphabet().items()}
        self.byte_ids = [self.vocab[letter[b]] for b in range(256)]
        self.last_ids = [self.vocab[letter[b] + self.end] for b in range(256)]
        self.ranks = {(self.vocab[a], self.vocab[b]): (n, self.vocab[a + b]) for n, (a, b) in enumerate(model["merges"])}
        self._words = regex.compile(self.pattern)
        self._newer_characters(path)
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(whether it is a special token, part) in order."""
        if self.find_special is None or not self.find_special.search(text):
            return [(False, text)]
        return [(k % 2 == 1, x) for k, x in enumerate(self.find_special.split(text)) if x]

    def chunks(self, text: str) -> list[str]:
        """The normalised text between white space; each chunk holds whole words."""
        text = unicodedata.normalize("NFC", text)
        if self._has(self.forms, text):
            text = text.translate(self.forms)
        # one character at a time, so that no letter's lower case depends on its neighbours
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        return self.find(text) if ODD_SPACE.search(text) else text.split()

    def _newer_characters(self, path: str) -> None:
        """Characters that Python's tables don't know yet, as the tokenizers library has them: which aren't
        parts of words, and whose normal form differs."""
        library = Tokenizer.from_file(path)
        known = regex.compile(r"\P{Cn}")
        newer = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and known.match(c)]
        split = library.pre_tokenizer.pre_tokenize_str
        self.not_in_words = {ord(c): "\u00a4" for c in newer if len(self._words.findall(f"a{c}b")) < len(split(f"a{c}b"))}
        self.forms = {ord(c): x for c in newer if (x := library.normalizer.normalize_str(c)) != c}
        lowest = min([*self.not_in_words, *self.forms], default=0x10FFFF)
        self._beyond = re.compile(f"[{chr(lowest)}-\U0010ffff]")  # most texts end the question here

    def _has(self, listed: dict, text: str) -> bool:
        return not text.isascii() and self._beyond.search(text) is not None and not listed.keys().isdisjoint(map(ord, set(text)))

    def find(self, chunk: str) -> list[str]:
        """The words of a normalised chunk."""
        if not self._has(self.not_in_words, chunk):
            return self._words.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self._words.finditer(chunk.translate(self.not_in_words))]

    def merge(self, word: str) -> list[int]:
        """The ids of one word by its merges: lowest rank first, leftmost among equals."""
        raw = word.encode()
        ids = [*map(self.byte_ids.__getitem__, raw[:-1]), self.last_ids[raw[-1]]]
        return self._merge_long(ids) if len(ids) > LONG_WORD else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        ranks = self.ranks
        pairs = [ranks.get(p, NO_MERGE) for p in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) is not NO_MERGE:
            k = pairs.index(best)
            ids[k : k + 2] = [best[1]]
            del pairs[k]
            if k:
                pairs[k - 1] = ranks.get((ids[k - 1], ids[k]), NO_MERGE)
            if k < len(pairs):
                pairs[k] = ranks.get((ids[k], ids[k + 1]), NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between what is left: n log n."""
        n, ranks = len(ids), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(found[0], k, ids[k], ids[k + 1], found[1]) for k in range(n - 1) if (found := ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, merged = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged since
            ids[k], ids[j], after[k] = merged, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (found := ranks.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        return [x for x in ids if x >= 0]

    def spell(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; an id outside the vocabulary spells nothing."""
        return " ".join([t for t in map(self.tokens.get, ids) if t is not None])


# ---------------------------------------------------------------- automaton

def compile_words(words: dict[str, list[int]]) -> bytes:
    """The minimal acyclic transducer of words with their ids, as the bytes of a file.

    Arrays: edge keys (state * 256 + byte, sorted), edge targets, edge outputs, final states,
    and the ids of the words in sorted order with their offsets.
    """
    ordered = sorted(words, key=str.encode)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # the last word's states: final, [(byte, target)]

    def close(down_to: int, last: bytes) -> None:
        while len(path) > down_to + 1:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            path[-1][1].append((last[len(path) - 1], register[key]))

    last = b""
    for word in ordered:
        raw, shared = word.encode(), 0
        while shared < min(len(raw), len(last)) and raw[shared] == last[shared]:
            shared += 1
        close(shared, last)
        path.extend([False, []] for _ in raw[shared:])
        path[-1][0] = True
        last = raw
    close(0, last)
    states.append((path[0][0], tuple(path[0][1])))
    below = []  # words from each state on; targets come before their sources
    for final, edges in states:
        below.append(final + sum(below[t] for _, t in edges))
    keys, targets, outputs = [], [], []
    for number, (final, edges) in enumerate(states):
        passed = int(final)
        for byte, target in edges:
            keys.append(number * 256 + byte)
            targets.append(target)
            outputs.append(passed)
            passed += below[target]
    ids = [words[w] for w in ordered]
    arrays = [np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64), np.array([f for f, _ in states], np.int64),
              np.cumsum([0, *map(len, ids)]).astype(np.int64), np.fromiter(chain.from_iterable(ids), np.int64)]
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *[a.tobytes() for a in arrays]])


class Automaton:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str):
        whole = np.asarray(np.memmap(path, np.int64, "r"))  # still the mapped pages
        sizes, at, arrays = whole[:6].tolist(), 6, []
        for n in sizes:
            arrays.append(whole[at : at + n])
            at += n
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = arrays

    def look_up(self, words: list[str]) -> list[bytes | None]:
        """The ids of many words, as 32-bit integers; all words go one byte further at each step. None if it lacks a word."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        n = np.array([len(r) for r in raw])
        order = np.argsort(-n, kind="stable")
        begins = (np.cumsum(n) - n)[order]
        buf, n = np.frombuffer(b"".join(raw), np.uint8), n[order]
        state, number = np.full(len(raw), len(self.final) - 1), np.zeros(len(raw), np.int64)
        lasting = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()  # words longer than t
        for t, many in enumerate(lasting):
            live = np.flatnonzero(state[:many] >= 0)
            if not len(live) or not len(self.keys):
                state[:many] = -1
                break
            key = state[live] * 256 + buf[begins[live] + t]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == key
            number[live] += np.where(known, self.outputs[at], 0)
            state[live] = np.where(known, self.targets[at], -1)
        found = np.flatnonzero((state >= 0) & (self.final[state] == 1))
        out: list[bytes | None] = [None] * len(raw)
        first, last = self.offsets[number[found]], self.offsets[number[found] + 1]
        ids = self.ids[np.repeat(first - np.cumsum(last - first) + (last - first), last - first) + np.arange(int((last - first).sum()))].astype("<i4").tobytes()
        at = 0
        for k, length in zip(order[found].tolist(), (last - first).tolist()):
            out[k] = ids[at : at + 4 * length]
            at += 4 * length
        return out


class Encoder:
    """Whole texts to ids, with a bounded memory of the chunks and merged words that came early."""

    def __init__(self, bpe: WordBpe, automaton: Automaton):
        self.bpe, self.automaton = bpe, automaton
        self.known: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """A word that the automaton lacks."""
        ids = self.merged.get(word)
        if ids is None:
            ids = array("i", self.bpe.merge(word)).tobytes()
            if len(self.merged) < MOST_REMEMBERED and len(word) <= LONG_WORD:
                self.merged[word] = ids
        return ids

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        words = {c: self.bpe.find(c) for c in new}
        distinct = list(set(chain.from_iterable(words.values())))
        ids = {w: self._word(w) if found is None else found for w, found in zip(distinct, self.automaton.look_up(distinct))}
        return {c: ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for c, ws in words.items()}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        split, known = [], self.known
        for text in texts:
            split.append([(special, x if special else self.bpe.chunks(x)) for special, x in self.bpe.parts(text)])
        new = set(chain.from_iterable(x for own in split for special, x in own if not special)).difference(known)
        made = self._learn(new) if new else {}
        if len(known) < MOST_REMEMBERED:
            known.update((c, ids) for c, ids in made.items() if len(c) <= LONG_WORD)
        out = []
        for own in split:
            parts = []
            for special, x in own:
                parts += [array("i", [self.bpe.special[x]]).tobytes()] if special else [known[c] if c in known else made[c] for c in x]
            out.append(b"".join(parts))
        return out


# ---------------------------------------------------------------- frames

def count_words(docs: DataFrame, bpe, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; each task sums what it reads before it is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = bpe.value, Counter()

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in held.items():
                for w in own.find(chunk):
                    words[w] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in pieces(batches, text_col, BATCH_BYTES):
            for raw in utf8(batch.column(text_col)):
                for special, x in own.parts(raw.decode()):
                    if not special:
                        held.update(own.chunks(x))
            if len(held) > 2 * MOST_REMEMBERED:
                yield out()
        yield out()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """A vocabulary and the automaton of a corpus's frequent words, ready for the executors."""

    def __init__(self, spark, path: str, file: str | None = None):
        self.bpe = spark.sparkContext.broadcast(WordBpe(path))
        self.file = file

    @classmethod
    def of(cls, docs: DataFrame, path: str, text_col: str = "text", words: int = WORDS) -> "Lexicon":
        """Count all words and compile the ``words`` most frequent ones (ties by word)."""
        spark = docs.sparkSession
        own = cls(spark, path)
        # a word beyond LONG_WORD isn't worth a place, so what the driver gets is bounded
        top = count_words(docs, own.bpe, text_col).where(F.octet_length("word") <= LONG_WORD).orderBy(F.desc("n"), "word").limit(words)
        merge = own.bpe.value.merge
        own.file = shared_file(spark, "lexicon", compile_words({w: merge(w) for w in top.toArrow().column("word").to_pylist()}))
        return own

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
        """(id, ids) of every whole text; with decoded_col also what decode() makes of the ids."""
        bpe, file = self.bpe, self.file
        docs = docs.select(id_col, text_col)
        fields = [docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]
        if decoded_col:
            fields.append(T.StructField(decoded_col, T.StringType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, spell = _encoder(bpe, file), bpe.value.spell
            for batch in pieces(batches, text_col, BATCH_BYTES):
                made = encoder.encode_all([t.decode() for t in utf8(batch.column(text_col))])
                offsets = np.cumsum([0, *[len(x) // 4 for x in made]]).astype(np.int32)
                columns = [batch.column(id_col), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))]
                if decoded_col:
                    columns.append(pa.array([spell(array("i", x)) for x in made], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

        return docs.mapInArrow(run, T.StructType(fields))

    def decode(self, encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
        """All columns and the text that the ids spell; a null list is empty, ids outside the vocabulary spell nothing."""
        bpe = self.bpe
        schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, ids_col, BATCH_BYTES):
                texts = [bpe.value.spell(ids or []) for ids in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

        return encoded.mapInArrow(run, schema)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(bpe, file: str) -> Encoder:
    """One encoder for each automaton in a worker process; an older one is let go."""
    if file not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[file] = Encoder(bpe.value, Automaton(SparkFiles.get(file)))
    return _ENCODERS[file]
