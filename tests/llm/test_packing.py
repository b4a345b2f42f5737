import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from zonecast.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = K.Encoder(K.ByteBpe(PATH))

pieces = st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\t", "a", "The", "'s", "é", "12", "...", "日本", "　", "<|endoftext|>", "😀", "\r\n", "   ", "\x00", " ", "_", "\x1c", "\x85"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(pieces)
def test_ids_are_the_library_s(text):
    assert ENCODER.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def brute_cost(at, penalty, size):
    places, best = [0, *at], [0]
    for j in range(1, len(places)):
        best.append(min(best[i] + size - (places[j] - places[i]) + penalty[j - 1] for i in range(j) if places[j] - places[i] <= size))
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 4, 24])), min_size=1, max_size=30))
def test_cuts_are_optimal(steps):
    at = np.cumsum([n for n, _ in steps])
    penalty = np.array([p for _, p in steps])
    got = K.cuts(at, penalty, 10)
    known = dict(zip(at.tolist(), penalty.tolist()))
    cost = sum(10 - (b - a) + known[b] for a, b in zip([0, *got], got))
    assert all(b - a <= 10 for a, b in zip([0, *got], got)) and got[-1] == at[-1] and cost == brute_cost(at.tolist(), penalty.tolist(), 10)


def test_every_id_lies_in_one_piece(docs_of, no_docs, monkeypatch):
    rng = random.Random(1)
    words = ["the", "of", "Word.", "x\n", "longer", "é!", "😀"]
    texts = [None, "", "a", " ".join(rng.choice(words) for _ in range(30_000)), "b" * 20_000, *[" ".join(rng.choice(words) for _ in range(rng.randint(0, 900))) for _ in range(150)]]
    docs = docs_of([*texts, (2, "a")]).repartition(3)
    rows = K.pack_documents(docs, PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = sorted(by_doc[i], key=lambda r: r.start), 0
        if i == 2:  # came twice
            assert [(r.start, r.length) for r in own] == [(0, len(ids))] * 2
            continue
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    filled = []
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        filled.append(at)
    assert 1 - sum(filled) / (1024 * len(filled)) < 0.04
    assert K.pack_documents(no_docs, PATH).collect() == []


def test_settling_early_changes_nothing_but_cuts():
    rng = np.random.default_rng(0)
    stream = K._Stream(64, ENCODER.ends_sentence, 0)
    out = []
    for i in range(300):
        stream.add(i, rng.integers(0, 50_000, rng.integers(1, 90)).astype("<u4"))
        if stream.held > 700:
            out.append(stream.settle(False))
    out.append(stream.settle(True))
    sizes = {}
    for o in out:
        for s, n in zip(o.get("sequence_id", []), o.get("length", [])):
            sizes[s] = sizes.get(s, 0) + n
    assert max(sizes.values()) <= 64 and sorted(sizes) == list(range(len(sizes)))


def test_vocabularies_of_one_size_have_encoders_of_their_own():
    import json
    import tempfile

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        said = json.load(f)
    vocab = said["model"]["vocab"]
    vocab["a"], vocab["b"] = vocab["b"], vocab["a"]
    with tempfile.NamedTemporaryFile("w", suffix=".json", encoding="utf-8") as f:
        json.dump(said, f)
        f.flush()
        own, other = (K.ByteBpe(p) for p in (public_tokenizers.path("byte_bpe_50k.json"), f.name))

    class Shared:
        def __init__(self, value):
            self.value = value

    first, second, again = (K._encoder(Shared(b)).encode("a").tolist() for b in (own, other, own))
    assert first == again != second and second == K.Encoder(other).encode("a").tolist()


def test_words_are_remembered_when_they_come_again():
    own = K.Encoder(K.ByteBpe(PATH))
    text = "zyzzyva quokka  the\nokapi zyzzyva\n numbat"
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == want and not own._words  # what comes once takes no place
    assert own.encode(text).tolist() == want and " numbat" in own._words
    assert own.encode("ibex " + text + " ibis tapir").tolist() == LIBRARY.encode("ibex " + text + " ibis tapir", add_special_tokens=False).ids
