import random
import tempfile

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from zonecast.llm import lexicon as X

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
BPE = X.WordBpe(PATH)


def automaton(words):
    with tempfile.NamedTemporaryFile(suffix=".bin") as f:
        f.write(X.compile_words({w: BPE.merge(w) for w in words}))
        f.flush()
        return X.Automaton(f.name)


@pytest.fixture(scope="module")
def encoder():
    return X.Encoder(BPE, automaton(["the", "then", "hen", "a", "日本", "é", "."]))


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


parts = st.lists(st.sampled_from([" ", "\n", "a", "'s", "'LL", "é", "é", "12", "...", "日本", " ", "<|endoftext|>", "<|startoftext|>", "😀", "The", "\x00", "\x1c", "\x85", "İ", "Σ", "ΑΣ", "ﬁ", "한", "Ⅷ",
                                  "Ᲊ", "࢏", "<|"]), max_size=14).map("".join)


@settings(max_examples=500, deadline=None)
@given(parts)
def test_ids_and_text_are_the_library_s(encoder, text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(encoder.encode_all([text])[0]) == want
    assert BPE.spell(want) == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike():
    rng = random.Random(2)
    for n in (1, 2, 63, 64, 65, 300):
        word = "".join(rng.choice("aeinrst") for _ in range(n))
        raw = word.encode()
        start = [*map(BPE.byte_ids.__getitem__, raw[:-1]), BPE.last_ids[raw[-1]]]
        assert BPE._merge_long(list(start)) == BPE._merge_short(list(start)) == LIBRARY.encode(word, add_special_tokens=False).ids
    assert len(BPE.merge("ab" * 100_000)) > 1000


def test_automaton_holds_its_words_and_shares_suffixes():
    words = [a + b for a in ("re", "un", "de", "co", "") for b in ("nation", "mation", "ration", "ing", "s")]
    own = automaton(words)
    assert [ids(x) for x in own.look_up(words)] == [BPE.merge(w) for w in words]
    assert own.look_up(["renatio", "renations", "x", "natio", "ings"]) == [None] * 5
    assert len(own.final) < len({w[:k] for w in words for k in range(len(w) + 1)}) / 2
    empty = automaton([])
    assert empty.look_up(["a"]) == [None] and empty.look_up([]) == []


def test_frames(spark, docs_of, no_docs):
    texts = [None, "", " \n ", "The the THE <|endoftext|> thé", "x" * 5000, *["common words here"] * 20]
    docs = docs_of([*texts, (3, texts[3])])
    own = X.Lexicon.of(docs, PATH, words=3)
    rows = own.encode(docs, decoded_col="decoded").collect()
    for r in rows:
        want = LIBRARY.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == LIBRARY.decode(want, skip_special_tokens=False)
    assert len(rows) == len(texts) + 1
    given = spark.createDataFrame([(1, None), (2, []), (3, [320, -5, 49407])], "k int, ids array<int>")
    assert [r.decoded for r in own.decode(given).orderBy("k").collect()] == ["", "", LIBRARY.decode([320, 49407], skip_special_tokens=False)]
    empty = X.Lexicon.of(no_docs, PATH)
    assert empty.encode(no_docs).collect() == [] and [r.ids for r in empty.encode(docs.limit(0)).collect()] == []
