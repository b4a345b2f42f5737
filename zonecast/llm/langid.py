"""Language identification with interpolated Kneser-Ney character models.

Each language has a character model of order 4. Spark counts the 4-grams of all labelled
texts; every lower order follows from those by Kneser-Ney's continuation counts. The models
are kept in sorted arrays of n-gram hashes (four 16-bit characters packed in 64 bits, so
there are no collisions inside the basic plane) with the discounted shares of the languages
that have them beside them. A text gets the language of least cross-entropy for each character.

The models that name the language, the score and the verdict learn from every labelled row.
They keep every label and every 4-gram, so the discounts and the lower orders are those of the
whole counts; an entry is kept only for the languages that have the n-gram. Up to ``broadcast_entries`` 4-grams by language the
model is gathered on the driver and broadcast. A larger one is computed by Spark and written to
the shared folder as sorted files (``StoredModel``): every executor fetches them and maps the
same arrays from its disk, so neither the driver nor a worker's memory holds the model, and
predictions are the same to the bit. ``max_languages`` and ``max_ngrams`` cut the model, if they
are given, to the most frequent labels and 4-grams.

Rejection is calibrated on every labelled row: a hash of the id deals the rows to ``PARTS`` parts,
and each row is judged by models that learned from the other parts. A text is accepted up to the
``quantile`` of the cross-entropies of its language and length class (powers of two) found so, or
of all of them together if that is more, times a ``margin``. A text without letters is never accepted.

``fit`` returns the models that didn't learn from part 0, a tenth of the rows, with the whole ones as
``whole``. ``predict`` gives the predicted language's cross-entropy by both: ``entropy`` without that
tenth (by the whole models, if it holds all rows of that language), ``whole_entropy``, which the
verdict compares with the limit, with it.

The score is the share of the best language if each language's likelihood is taken over at most
``SCORE_CHARS`` characters of mean cost, so that long texts don't all score 1.

Defined results for odd input: null text, or one without a letter: ``und``, score 0, not
accepted; ties go to the first language by name; repeated rows each keep their row; with no
labelled row everything is ``und``; rows with a null id aren't learned from and aren't held
out; other columns aren't read by a prediction.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F, types as T

from zonecast.llm.batches import fetched_files, pieces, written

ORDER = 4
UNDETERMINED = "und"
BATCH_BYTES = 1 << 20
SCORE_CHARS = 40
CELLS = 8_000_000
BROADCAST_ENTRIES = 8_000_000
FILE_ENTRIES = 4_000_000
PARTS = 3


# ---------------------------------------------------------------- characters

@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """For each character of the basic plane itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4-gram behind each kept character, its text's number, letters in each text).

    Texts are lower-cased; what isn't a letter is a space, and spaces don't repeat.
    """
    joined = "".join(f"\0\0\0{t.replace('\0', ' ')}" for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    chars = _classes()[np.minimum(codes, 0xFFFF)]
    beyond = codes > 0xFFFF
    if beyond.any():  # one sign for all letters beyond the basic plane
        distinct, where = np.unique(codes[beyond], return_inverse=True)
        chars[beyond] = np.array([0xFFFF if chr(c).isalpha() else 32 for c in distinct.tolist()], np.uint64)[where]
    chars[codes == 0] = 0
    doc = np.cumsum((codes == 0)) // 3 - 1
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 32) | ((chars[:-1] != 32) & (chars[:-1] != 0))
    chars, doc = chars[keep], doc[keep]
    key = chars.copy()
    for back in range(1, ORDER):
        key[back:] |= chars[:-back] << np.uint64(16 * back)
    real = chars != 0
    letters = np.bincount(doc[real & (chars != 32)], minlength=len(texts))
    return key[real], doc[real], letters


# ---------------------------------------------------------------- models

@dataclass
class Model:
    """Sorted n-grams and contexts of each order, and for each the languages that have it with their shares and weights."""

    languages: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)       # order -> sorted n-grams
    key_rows: dict[int, np.ndarray] = field(default_factory=dict)   # order -> where each n-gram's entries start, and the end
    key_langs: dict[int, np.ndarray] = field(default_factory=dict)  # order -> the entries' languages
    probs: dict[int, np.ndarray] = field(default_factory=dict)      # order -> the entries' discounted shares
    contexts: dict[int, np.ndarray] = field(default_factory=dict)   # the same of contexts, whose entries are the lower order's weights
    context_rows: dict[int, np.ndarray] = field(default_factory=dict)
    context_langs: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    limits: dict[tuple[int, int], float] = field(default_factory=dict)  # (language of the whole models, length class) -> most nats
    limit: float = np.inf                                               # of all languages and lengths together
    whole: Model | None = None                                          # learned from every labelled row, if these models weren't

    def open(self) -> Model:
        """The model with its arrays at hand."""
        return self

    def lookup(self, n: int, keys: np.ndarray, first: int = 0, end: int | None = None) -> np.ndarray:
        """[language, key] interpolated probabilities of distinct n-grams, known or not, in the languages from first to end."""
        end = len(self.languages) if end is None else end
        if n == 0:
            return np.full((end - first, len(keys)), 1.0 / (1 << 16))
        distinct, where = np.unique(keys & np.uint64((1 << (16 * (n - 1))) - 1), return_inverse=True)
        out = self.lookup(n - 1, distinct, first, end)[:, where]
        for table, rows, langs, values, wanted, change in (
                (self.contexts[n], self.context_rows[n], self.context_langs[n], self.weights[n], keys >> np.uint64(16), np.multiply),
                (self.keys[n], self.key_rows[n], self.key_langs[n], self.probs[n], keys, np.add)):
            at, known = _find(table, wanted)
            known = np.flatnonzero(known)
            at = at[known]
            size = rows[at + 1] - rows[at]
            entry = np.arange(size.sum()) + np.repeat(rows[at] - (np.cumsum(size) - size), size)
            column, lang = np.repeat(known, size), langs[entry].astype(np.int64)
            if end - first < len(self.languages):
                own = (lang >= first) & (lang < end)
                column, lang, entry = column[own], lang[own], entry[own]
            out[lang - first, column] = change(out[lang - first, column], values[entry])
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """([language, text] nats for each character, characters, letters)."""
        keys, doc, letters = grams(texts)
        chars = np.bincount(doc, minlength=len(texts))
        distinct, where = np.unique(keys, return_inverse=True)
        sums = np.zeros((len(self.languages), len(texts)))
        block = max(1, CELLS // max(len(distinct), 1))  # languages at once
        for first in range(0, len(self.languages) if len(distinct) else 0, block):
            cost = -np.log(self.lookup(ORDER, distinct, first, min(first + block, len(self.languages))))
            for k, c in enumerate(cost):
                sums[first + k] = np.bincount(doc, weights=c[where], minlength=len(texts))
        return sums / np.maximum(chars, 1), chars, letters

    def entropies_in(self, texts: list[str], languages: list[str]) -> np.ndarray:
        """Nats for each character of each text in one language of its own; nan in a language that isn't known."""
        out = np.full(len(texts), np.nan)
        number = {x: k for k, x in enumerate(self.languages)}
        own: dict[str, list[int]] = {}
        for i, x in enumerate(languages):
            if x in number:
                own.setdefault(x, []).append(i)
        for x, at in own.items():
            keys, doc, _ = grams([texts[i] for i in at])
            distinct, where = np.unique(keys, return_inverse=True)
            cost = -np.log(self.lookup(ORDER, distinct, number[x], number[x] + 1)[0])
            out[at] = np.bincount(doc, weights=cost[where], minlength=len(at)) / np.maximum(np.bincount(doc, minlength=len(at)), 1)
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys if len(table) else np.zeros(len(keys), bool))


def _entries(own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted keys, where each one's entries start, languages, values) of each language's (keys, values)."""
    keys = np.concatenate([k for k, _ in own])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    langs = np.repeat(np.arange(len(own), dtype=np.int32), [len(k) for k, _ in own])[order]
    return keys[starts], np.append(starts, len(keys)), langs, np.concatenate([v for _, v in own])[order]


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from each language's (4-grams, counts)."""
    model = Model(sorted(counts))
    shares, weights = ({k: [] for k in range(1, ORDER + 1)} for _ in range(2))
    for lang in model.languages:
        keys, n = counts[lang]
        order = np.argsort(keys)
        keys, n = keys[order], n[order].astype(float)
        for k in range(ORDER, 0, -1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, where = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(where, weights=n), np.bincount(where)
            weights[k].append((context, discount * kinds / total))
            shares[k].append((keys, (n - discount) / total[where]))
            # in how many ways is the shorter one continued to the left
            keys, n = np.unique(keys & np.uint64((1 << (16 * (k - 1))) - 1), return_counts=True)
            n = n.astype(float)
    for k in range(1, ORDER + 1) if model.languages else ():
        model.keys[k], model.key_rows[k], model.key_langs[k], model.probs[k] = _entries(shares[k])
        model.contexts[k], model.context_rows[k], model.context_langs[k], model.weights[k] = _entries(weights[k])
    return model


@dataclass
class StoredModel(Model):
    """A model whose arrays are mapped from files that Spark wrote; what is broadcast are their names."""

    files: dict[tuple[str, int], list[str]] = field(default_factory=dict)  # (kind, order) -> the fetched files, in order of their keys

    def open(self) -> Model:
        if not self.keys:
            for (kind, k), names in self.files.items():
                keys, rows, langs, values = (self.keys, self.key_rows, self.key_langs, self.probs) if kind == "share" else (
                    self.contexts, self.context_rows, self.context_langs, self.weights)
                keys[k], rows[k], langs[k], values[k] = _mapped(names)
        return self

    def __getstate__(self) -> dict:
        return {**self.__dict__, **{x: {} for x in ("keys", "key_rows", "key_langs", "probs", "contexts", "context_rows", "context_langs", "weights")}}


def _mapped(names: list[str]) -> tuple[np.ndarray, ...]:
    """(keys, where each one's entries start and the end, languages, values) of sorted files, mapped from the executor's disk.

    The first worker to come flattens the files, one row group at a time; a rename shows the others whole arrays only.
    """
    types = {"keys": np.uint64, "rows": np.int64, "langs": np.int32, "values": np.float64}
    paths = {x: f"{SparkFiles.get(names[0])}.{x}" for x in types}
    if not all(map(os.path.exists, paths.values())):
        own = {x: f"{path}-{uuid.uuid4().hex}" for x, path in paths.items()}
        out = {x: open(path, "wb") for x, path in own.items()}
        last, entries = None, 0
        for name in names:
            file = pq.ParquetFile(SparkFiles.get(name))
            for group in range(file.num_row_groups):
                table = file.read_row_group(group)
                keys = table.column("key").to_numpy().view(np.uint64)
                if not len(keys):
                    continue
                starts = np.flatnonzero(np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]]))
                out["keys"].write(keys[starts].tobytes())
                out["rows"].write((starts + entries).astype(np.int64).tobytes())
                out["langs"].write(table.column("lang").to_numpy().astype(np.int32).tobytes())
                out["values"].write(table.column("value").to_numpy().tobytes())
                last, entries = keys[-1], entries + len(keys)
        out["rows"].write(np.int64(entries).tobytes())
        for x in types:
            out[x].close()
            os.replace(own[x], paths[x])
    return tuple(np.memmap(paths[x], t, "r") if os.path.getsize(paths[x]) else np.empty(0, t) for x, t in types.items())


def stored_kneser_ney(counts: DataFrame) -> StoredModel:
    """The models of ``kneser_ney``, from a table (lang, gram, n); only labels and discounts come to the driver."""
    spark = counts.sparkSession
    model = StoredModel(sorted(r.lang for r in counts.select("lang").distinct().collect()))
    level = counts.select("lang", F.col("gram").alias("key"), "n")
    for k in range(ORDER, 0, -1):
        level = written(level)
        labels, entries = [], 0
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"), F.count("n").alias("n")).collect():
            discount = r.ones / (r.ones + 2 * r.twos) if r.ones and r.twos else 0.5
            labels.append((r.lang, model.languages.index(r.lang), discount))
            entries += r.n
        labels = spark.createDataFrame(labels, "lang string, number int, discount double")
        rows = level.join(labels, "lang").select(
            F.col("number").alias("lang"), "discount", "key", F.shiftrightunsigned("key", 16).alias("context"), "n")
        totals = rows.groupBy("lang", "context", "discount").agg(F.sum("n").alias("total"), F.count("n").alias("kinds"))
        weights = totals.select(F.col("context").alias("key"), "lang", (F.col("discount") * F.col("kinds") / F.col("total")).alias("value"))
        shares = rows.join(totals.drop("discount"), ["lang", "context"]).select("key", "lang", ((F.col("n") - F.col("discount")) / F.col("total")).alias("value"))
        files = 1 + entries // FILE_ENTRIES
        for kind, table in (("share", shares), ("weight", weights)):
            unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
            model.files[kind, k] = fetched_files(table.repartitionByRange(files, unsigned).sortWithinPartitions(unsigned, "lang"))
        # in how many ways is the shorter one continued to the left
        shorter = F.col("key").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1)).alias("key")
        level = level.groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n"))
    return model


# ---------------------------------------------------------------- frames

def held_out(id_col: str = "doc_id") -> Column:
    """The rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def part(id_col: str = "doc_id") -> Column:
    """The part of a labelled row: 0 for a tenth of the ids, the rest evenly in the others."""
    return F.when(F.pmod(F.xxhash64(id_col), F.lit(10)) == 0, 0).otherwise(
        1 + F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(PARTS - 1))).cast("int")


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), part(id_col).alias("part"))


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n, n0, n1, ...) of all labelled texts and of each part's; each task sums what it reads before it is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(own: tuple[str, int]) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in held[own]]), return_inverse=True)
            return keys, np.bincount(where, weights=np.concatenate([n for _, n in held[own]])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, number in held:
                keys, n = merged((lang, number))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), number, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)],
                    ["lang", "part", "gram", "n"])
            held.clear()

        for batch in pieces(batches, "text", BATCH_BYTES):
            texts: dict[tuple[str, int], list[str]] = {}
            for lang, number, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "text"))):
                texts.setdefault((lang, number), []).append(text)
            for own, said in texts.items():
                held.setdefault(own, []).append(np.unique(grams(said)[0], return_counts=True))
                if len(held[own]) > 8:
                    held[own] = [merged(own)]
            if sum(len(k) for x in held.values() for k, _ in x) > 4_000_000:
                yield from out()
        yield from out()

    parts = [F.sum(F.when(F.col("part") == p, F.col("n")).otherwise(0)).alias(f"n{p}") for p in range(PARTS)]
    return labelled.select("lang", "part", "text").mapInArrow(count, "lang string, part int, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"), *parts)


def _most_frequent(counts: DataFrame, share: int) -> DataFrame:
    """The most frequent 4-grams of each language, at most a share of them unless one count alone has more."""
    # how often each count occurs; large counts by powers of two, so this table is small
    step = F.when(F.col("n") <= 1000, F.col("n")).otherwise(F.pow(2, F.floor(F.log2("n")))).cast("long")
    least = {}
    for r in counts.groupBy("lang", step.alias("n")).count().orderBy("lang", F.desc("n")).collect():
        kept, at = least.get(r.lang, (0, None))
        least[r.lang] = (kept + r["count"], r.n if kept + r["count"] <= share or at is None else at)
    wanted = F.lit(False)
    for lang, (_, n) in least.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("n") >= n))
    return counts.where(wanted)


def _gathered(counts: DataFrame) -> Model:
    """The models of a table (lang, gram, n), computed on the driver."""
    table = counts.toArrow()
    names = table.column("lang").dictionary_encode().combine_chunks()
    langs, keys, n = names.indices.to_numpy(), table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(langs, kind="stable")
    ends = np.cumsum(np.bincount(langs, minlength=len(names.dictionary)))
    return kneser_ney({x: (keys[own], n[own]) for x, own in zip(names.dictionary.to_pylist(), np.split(order, ends[:-1]))} if len(langs) else {})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_languages: int | None = None,
        max_ngrams: int | None = None, broadcast_entries: int = BROADCAST_ENTRIES, quantile: float = 0.999, margin: float = 1.5) -> Model:
    """Learn the models and rejection limits from all labelled rows that aren't held out."""
    labelled = _labelled(docs, id_col, text_col, lang_col)
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    rows = (sizes if max_languages is None else sizes.limit(max_languages)).collect()
    if not rows:
        return Model([])
    counts = count_grams(labelled)
    if max_languages is not None:
        counts = counts.where(F.col("lang").isin([r.lang for r in rows]))
    counts = written(counts)

    def learned(n: Column) -> Model:
        own = counts.select("lang", "gram", n.alias("n")).where(F.col("n") > 0)
        if max_ngrams is not None:
            own = _most_frequent(own, max_ngrams // len(rows))
        return stored_kneser_ney(own) if own.count() > broadcast_entries else _gathered(own)

    whole = learned(F.col("n"))
    others = [learned(F.col("n") - F.col(f"n{p}")) for p in range(PARTS)]  # apart from the rows that they judge
    judged = [predict(labelled.where(F.col("part") == p), model, "id", keep=("lang",)) for p, model in enumerate(others)]
    classes = reduce(DataFrame.unionByName, judged).where((F.col("lang") == F.col("lang_pred")) & (F.col("n_letters") > 0))
    most = F.percentile_approx("whole_entropy", quantile, 10_000).alias("most")
    for r in classes.cube("lang", "length_class").agg(most).where(F.col("lang").isNull() == F.col("length_class").isNull()).collect():
        if r.lang is None:
            whole.limit = r.most * margin if r.most is not None else np.inf
        else:
            whole.limits[whole.languages.index(r.lang), r.length_class] = r.most * margin
    model = others[0]
    model.limit, model.limits, model.whole = whole.limit, whole.limits, whole
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., lang_pred, score, entropy, whole_entropy, n_letters, length_class, accepted) for each row, from its text alone."""
    schema = T.StructType([docs.schema[c] for c in (id_col, *keep)] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()),
        T.StructField("whole_entropy", T.DoubleType()), T.StructField("n_letters", T.LongType()), T.StructField("length_class", T.IntegerType()), T.StructField("accepted", T.BooleanType())])
    return docs.select(id_col, *keep, text_col).mapInArrow(_predictor(docs, model, text_col, (id_col, *keep)), schema)


def accept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, whole, whose text is accepted as one of the model's languages."""
    judge = _predictor(docs, model.whole or model, text_col, ())

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:  # the judge cuts it into pieces, in order
                yield batch.filter(pa.concat_arrays([said.column("accepted") for said in judge(iter([batch]))]))

    return docs.mapInArrow(filtered, docs.schema)


def _predictor(docs: DataFrame, model: Model, text_col: str, keep: tuple[str, ...]):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = shared.value  # without part 0, only for what is reported
        m = (rest.whole or rest).open()
        for batch in pieces(batches, text_col, BATCH_BYTES):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            n = len(texts)
            if m.languages:
                entropy, chars, letters = m.entropies(texts)
            else:
                entropy, chars, letters = np.zeros((1, n)), np.zeros(n, np.int64), np.zeros(n, np.int64)
            best = entropy.argmin(axis=0)
            least = entropy[best, np.arange(n)]
            score = 1 / np.exp(-(entropy - least) * np.minimum(chars, SCORE_CHARS)).sum(axis=0)
            size = np.frexp(np.maximum(letters, 1))[1].astype(np.int32)
            limit = np.array([max(m.limit, m.limits.get(x, 0.0)) for x in zip(best.tolist(), size.tolist())])
            known = (letters > 0) & bool(m.languages)
            names = m.languages or [UNDETERMINED]
            named = [names[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
            part_entropy = least
            if rest is not m:
                said = np.flatnonzero(known)
                part_entropy = least.copy()
                part_entropy[said] = rest.open().entropies_in([texts[i] for i in said], [named[i] for i in said])
                part_entropy = np.where(np.isnan(part_entropy), least, part_entropy)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep],
                 pa.array(named, pa.string()), pa.array(np.where(known, score, 0.0)),
                 pa.array(np.where(known, part_entropy, 0.0)), pa.array(np.where(known, least, 0.0)), pa.array(letters.astype(np.int64)),
                 pa.array(size), pa.array(known & (least <= limit))],
                [*keep, "lang_pred", "score", "entropy", "whole_entropy", "n_letters", "length_class", "accepted"])

    return run
