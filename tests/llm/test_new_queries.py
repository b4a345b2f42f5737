"""op11, op12 and op13: the operators and the registered queries against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.llm import centroids, neardup, spelling
from zonecast.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")
EMBEDDINGS = "vec_id long, embedding array<float>, set_id string, component int"  # with clashing names


@pytest.fixture
def folder(spark, tmp_path):
    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], EMBEDDINGS)


def components(rows, linked):
    """{row: smallest id} by plain walking."""
    least = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min((x for x in (least[a], least[b]) if x is not None), default=None)
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


# ---------------------------------------------------------------- op11

def near_by_brute_force(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    linked = []
    vs = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    for n, a in enumerate(ok):
        for b in ok[:n]:
            x, y = vs[a], vs[b]
            if len(x) == len(y) and (x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine or (x == y).all()):
                linked.append((a, b))
    return linked


def near_rows():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 64))
    x[100:160] = x[100] + 0.02 * rng.normal(size=(60, 64))  # a group of near copies
    x[200:260] = x[200]  # copies
    for i in range(300, 400, 2):  # pairs at the threshold, on both sides of it
        a = rng.normal(size=64)
        a -= a @ x[i] / (x[i] @ x[i]) * x[i]
        c = 0.94 + 0.0004 * (i - 300)
        x[i + 1] = 3 * (c * x[i] / np.linalg.norm(x[i]) + np.sqrt(1 - c * c) * a / np.linalg.norm(a))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    rng.shuffle(x)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [NAN] + [1.0] * 63), (1004, [INF] + [1.0] * 63), (1005, [None] + [1.0] * 63),
             (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [2.0, -1.0]), (1009, [-0.0, 1.0]), (1010, [0.0, 1.0]), (None, [0.0, 1.0]),
             (1011, [3e38] * 64), (1012, [1e-38] * 64), (1013, [1.0] * 64)]
    return rows


def test_neardup_query_equals_brute_force(spark, folder):
    rows = near_rows()
    linked = near_by_brute_force(rows)
    n = Counter(x for pair in linked for x in pair)
    least = components(rows, linked)
    got = {r.vec_id: r for r in QUERIES["op11_neardup"](spark, folder(embeddings=embeddings(spark, rows))).collect()}
    assert got[0].__fields__ == ["vec_id", "n_links", "component_id", "kept"]
    assert len(got) == len(rows)
    assert {i: got[i].n_links for i, _ in rows} == {i: n[k] for k, (i, _) in enumerate(rows)}
    assert {i: got[i].component_id for i, _ in rows} == {i: least[k] for k, (i, _) in enumerate(rows)}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_neardup_recall_at_the_threshold():
    """Of pairs turned by just the wanted angle from clustered vectors, the tables meet what the learning promises."""
    rng = np.random.default_rng(1)
    x = neardup.unit(rng.normal(size=(50, 64))[rng.integers(0, 50, 8000)] + 0.7 * rng.normal(size=(8000, 64)))
    tables = neardup.learn(x[:4000], 10**6, 0.95)
    a = x[4000:]
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * neardup.unit(g)
    keys, others = tables.keys(tables.bits(a), 64), tables.keys(tables.bits(b), 64)
    assert (keys == others).any(axis=1).mean() > 0.985
    apart = (tables.bits(a) != tables.bits(b))[:, : neardup.CHECKED].sum(axis=1)
    assert (apart <= tables.near).mean() > 0.995
    balance = tables.bits(x[:4000]).mean(axis=0)
    assert abs(balance - 0.5).max() < 0.03


def test_neardup_empty_and_all_invalid(spark):
    assert neardup.vector_near_duplicates(embeddings(spark, [])).collect() == []
    got = neardup.vector_near_duplicates(embeddings(spark, [(3, None), (4, [0.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_neardup_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_CODES", 16)
    monkeypatch.setattr(neardup, "BLOCK_VECTORS", 16)
    rows = near_rows()[:270]
    linked = near_by_brute_force(rows)
    n, least = Counter(x for pair in linked for x in pair), components(rows, linked)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.vector_near_duplicates(embeddings(spark, rows)).collect()}
    assert got == {i: (n[k], least[k]) for k, (i, _) in enumerate(rows)}


# ---------------------------------------------------------------- op12

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_brute_force(rows, least=7, drop_every=31):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]])
    return out


def spelling_rows():
    rng = np.random.default_rng(12)
    letters = list("abcdeéß÷")
    words = ["".join(rng.choice(letters, rng.integers(6, 12))) for _ in range(150)]
    for w in list(words):  # variants, and variants of these
        for _ in range(4):
            k = int(rng.integers(0, len(w)))
            w = [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :], "Z" + w][int(rng.integers(0, 4))]
            words.append(w)
    words += ["commonword", "commonwort", "comonwort", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "abababab", "babababa", "q" * 70_000, "q" * 70_001]
    weights = 1.0 / np.arange(1, len(words) + 1) ** 1.2
    rows = [(i, " ".join(rng.choice(words, 60, p=weights / weights.sum()))) for i in range(200)]
    rows += [(900, "commonword " * 20_000 + "commonwort " * 1_000 + "comonwort, comonwort"), (901, None), (902, ""), (None, "Commonword ÀÀÀÀÀÀÀ ààààààà ÀÀÀÀÀÀÀ. \U0001F600wordword"),
             (903, "1234567 --- ..."), (904, ("longtext " * 200_000) + "q" * 70_000 + " " + "q" * 70_001 + " " + "q" * 70_000 + "-" + "q" * 70_001), (905, rows[0][1]), (905, rows[0][1])]
    return rows


def test_spelling_query_equals_brute_force(spark, folder):
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = QUERIES["op12_spelling"](spark, folder(documents=docs.repartition(5))).collect()
    want = spelling_by_brute_force(rows)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert len(got) == len(want) and len(want) > 150
    assert any(f is not None and f != r for f, r, *_ in want.values())  # a chain of two forms


def test_spelling_hot_groups_are_cut(spark, monkeypatch, docs_of):
    """Words that share their beginning (or end) fill many blocks and block pairs."""
    monkeypatch.setattr(spelling, "GROUP_WORDS", 40)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 16)
    rng = np.random.default_rng(4)
    words = {"prefixed" + "".join(rng.choice(list("abc"), 5)) for _ in range(250)} | {"".join(rng.choice(list("abc"), 6)) + "suffixes" for _ in range(250)}
    words |= {w + "a" for w in list(words)[:60]}
    rows = [(i, f"{w} {w}" + " more" * (i % 3)) for i, w in enumerate(sorted(words))]
    got = spelling.variants(docs_of(rows)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == spelling_by_brute_force(rows, drop_every=None)


def test_spelling_empty(spark, no_docs, docs_of):
    assert spelling.variants(no_docs).collect() == []
    assert spelling.variants(docs_of([None, "", "once upon"])).collect() == []


# ---------------------------------------------------------------- op13

def centroids_by_brute_force(rows, dim=64, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is None or len(v) != dim or any(c is None or not np.isfinite(c) or abs(c) * 64 >= 2**27 for c in v):
            continue
        kept.append((i, [int(np.floor(64 * float(np.float32(c)))) for c in v]))
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        placed = [min((dist(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), (_, c) in zip(kept, placed) if c == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    total = Counter()
    for d, j in placed:
        total[j] += d
    return sorted((str(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, placed))


def as_rows(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_centroids_query_equals_brute_force(spark, folder):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x[50:120] = x[50]  # a hot vector
    x[120:200] = np.round(x[120:200])  # ties
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(7, rows[9][1]), (7, rows[7][1]), (None, rows[3][1]), (900, None), (901, []), (902, [1.0]), (903, [NAN] * 64), (904, [None] * 64), (905, [INF] * 64),
             (906, [3e38] * 64), (907, [0.0] * 64), (908, [2e6] * 64)]
    got = QUERIES["op13_centroids"](spark, folder(embeddings=embeddings(spark, rows).repartition(5)))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert as_rows(got) == centroids_by_brute_force(rows)


def test_centroids_of_few_or_equal_or_no_vectors(spark):
    for rows in ([(1, [1.0] * 64)] * 5 + [(2, [0.5] * 64)], [(i, [0.25] * 64) for i in range(40)]):
        assert as_rows(centroids.cluster_vectors(embeddings(spark, rows))) == centroids_by_brute_force(rows)
    empty = centroids.cluster_vectors(embeddings(spark, [(1, None)]))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and empty.collect() == []


def test_pivot_bounds_leave_out_no_winner():
    """Bounds cut most distances of clustered vectors, and the result is that of a whole comparison."""
    rng = np.random.default_rng(5)
    x = (rng.integers(-60, 60, (16, 64))[rng.integers(0, 16, 3000)] + rng.integers(-6, 7, (3000, 64))).astype(np.int64)
    c = x[:16].copy()
    moved = np.array([np.floor(x[i * 100 : i * 100 + 7].mean(axis=0)) for i in range(16)]).astype(np.int64)
    for centres in (c, moved):
        cluster, distance, computed = centroids.nearest(x, centroids.squared(x, c), centres, centroids.squared(c, centres))
        every = centroids.squared(x, centres)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
        assert computed < every.size / 2
