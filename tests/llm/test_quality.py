import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from zonecast.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    up, low = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(inside), up, up + low,
            sum(a == b for a, b in zip(words, words[1:])))


texts = st.lists(st.sampled_from(["a", "b", "Ab", "é", " ", "#x", "$", " ", "\n", "\t", "\x0b", "\x1c", "😀"] + ["p q r s t u v w "]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_measures_equal_a_plain_count(text):
    assert Q.measure(text.encode()) == brute(text)


def test_repeats_that_overlap_and_long_texts():
    assert Q.repeated_words([b"a"] * 9) == 9 and Q.repeated_words([b"a"] * 8) == 0
    long = [b"w%d" % i for i in range(200_000)]
    assert Q.repeated_words(long) == 0 and Q.repeated_words(long + long[:8]) == 16


CLEAN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
ODD = [None, "", CLEAN, "few words", "x y z w v u t s " * 20, "LOUD " + CLEAN.upper(), CLEAN.replace(" ", " # "), " ".join([w for w in CLEAN.split() for _ in range(3)])]


def test_ledger_policies_and_ablations(docs_of, no_docs):
    docs = docs_of([*ODD, (2, CLEAN)]).withColumn("failed", F.lit("clash")).withColumn("n_words", F.lit(0))
    rows = Q.ledger(docs)
    failed = sorted((r.doc_id, [x.name for k, x in enumerate(Q.RULES) if r.failed >> k & 1]) for r in rows.collect())
    assert failed == [(0, ["few_words"]), (1, ["few_words"]), (2, []), (2, []), (3, ["few_words"]), (4, ["repeated_words", "short_words"]),
                      (5, ["shouting"]), (6, ["symbols"]), (7, ["echoes"])]
    kept = sorted(r.doc_id for r in Q.keep(docs).collect())
    assert kept == [2, 2] == sorted(r.doc_id for r in rows.where(Q.verdict()).collect())
    assert Q.keep(docs).columns == docs.columns
    total = rows.count()
    for r in Q.ablations(rows).collect():
        without = Q.Policy("t", tuple(x for x in Q.CURRENT.rules if x != r.rule))
        own = Q.Policy("t", (r.rule,))
        assert r.n_kept_without == rows.where(Q.verdict(without)).count() and r.n_failed == total - rows.where(Q.verdict(own)).count()
        assert r.n_only == r.n_kept_without - rows.where(Q.verdict()).count()
    assert Q.ledger(no_docs).collect() == [] and Q.keep(no_docs).collect() == [] and Q.ablations(Q.ledger(no_docs)).collect() == []


def test_versions_differ():
    assert Q.POLICIES["base-1"].mask == 3 and Q.CURRENT.mask & 3 == 3
