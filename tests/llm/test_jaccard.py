import random
import re

import numpy as np
import pytest

from zonecast.llm import graph, jaccard as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(words)] if 0 < len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def brute(pairs, k, num, den):
    """[(id, shingles, component, links)] of all rows, by all pairs."""
    sets = [(i, shingles(t, k)) for i, t in pairs]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least.setdefault(find(a), []).append(i)
    return sorted((i, len(s), min(least[find(a)]), links[a]) for a, (i, s) in enumerate(sets))


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    base = [[word() for _ in range(rng.choice([2, 8, 9, 10, 11, 30, 120]))] for _ in range(12)]
    passage = [word() for _ in range(30)]
    texts = [None, "", " \n\t", "one", "One", "two words", "Two  WORDS"]
    while len(texts) < n:
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += passage
        if rng.random() < 0.3:
            words += [word() for _ in range(rng.choice([1, 3, 12]))]
        texts.append(rng.choice([" ", "\n"]).join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("k, num, den, small", [(3, 90, 100, False), (5, 4, 5, False), (3, 90, 100, True), (2, 1, 2, True)])
def test_components_and_links_equal_all_pairs(docs_of, monkeypatch, k, num, den, small):
    if small:  # so that components and posting lists are cut into blocks
        monkeypatch.setattr(J, "BLOCK_SETS", 3)
    pairs = corpus(k + den + small)
    pairs += [pairs[20], pairs[20], (500, pairs[30][1])]
    got = J.jaccard_join(docs_of(pairs).repartition(4), words=k, num=num, den=den)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == brute(pairs, k, num, den)


def test_a_chain_is_one_component(docs_of):
    words = [f"w{i}" for i in range(40)]
    chain, own = [], list(words)
    for step in range(25):
        chain.append(" ".join(own))
        own = own[1:] + [f"n{step}"]
    got = J.jaccard_join(docs_of(chain), words=3, num=90, den=100).collect()
    assert {r.component_id for r in got} == {0}


def test_one_document_of_each_group_stays(docs_of, no_docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = docs_of([(4, a), (2, a + " more"), (2, a + " more"), (9, b), (None, b), (None, "only null ids here"), (None, "only null ids here"), (7, None), (7, ""), (5, "x")])
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one(docs).collect()), key=str)
    assert kept == sorted([(2, a + " more"), (9, b), (None, "only null ids here"), (7, None), (7, ""), (5, "x")], key=str)
    assert J.keep_one(docs).columns == docs.columns
    assert J.keep_one(no_docs).collect() == [] and J.jaccard_join(no_docs).collect() == []


def test_filter_on_prefixes_lets_every_link_pass():
    rng = random.Random(8)
    for _ in range(300):
        num, den = rng.choice([(9, 10), (4, 5), (1, 2)])
        x = {rng.randrange(200) for _ in range(rng.randint(5, 60))}
        y = {v for v in x if rng.random() < 0.93} | {rng.randrange(200) for _ in range(rng.randint(0, 5))}
        if not y or len(x & y) * den < num * len(x | y):
            continue
        codes = [np.array(sorted(s)[: len(s) - -(-len(s) * num // den) + 1], "<u4") for s in (x, y)]
        assert J.may_link(codes, np.array([len(x), len(y)]), num, den)[0, 1]


def test_codes_that_collide_lose_no_link():
    x, y = [1, 1, *range(2, 20)], [1, 1, *range(2, 19), 20]  # 19 of 21 shingles shared, two of them with one code
    others = [list(range(100 * k, 100 * k + 20)) for k in range(1, 5)]
    for codes in ([x, y], [x, y, *others]):
        links = J.may_link([np.array(c, "<u4") for c in codes], np.full(len(codes), 20), 9, 10)
        assert links[0, 1] and links[1, 0] and links.sum() == 2
    ends = [np.array([1, 2, 3, 9], "<u4"), np.array([1, 2, 3, 10], "<u4")]  # one difference at the end of a list isn't counted
    assert J.may_link(ends, np.array([4, 4]), 1, 1)[0, 1]


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (5, 5)]
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {a: find(a) for a in root}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
