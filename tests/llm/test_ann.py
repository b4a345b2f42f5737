import numpy as np
from pyspark.sql import functions as F

from zonecast.llm import ann as A


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    return out


def exact(x, q, k):
    s = x.astype(float) @ x[q].astype(float)
    s[q] = -np.inf
    return sorted(((-v, i) for i, v in enumerate(s.tolist()) if i != q))[:k]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)  # unequal norms
    x[100:140] = x[100]  # a hot vector
    got = answers(A.search(frame(spark, [(i, v.tolist(), "clash") for i, v in enumerate(x)]), F.col("id") % 20 == 0, k=20))
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        want = exact(x, q, 20)
        hits += len({i for _, i in want} & {i for _, i, _ in found})
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        for _, i, s in found:
            assert abs(s - x[i].astype(float) @ x[q].astype(float)) < 1e-12
    assert hits / (20 * len(got)) >= 0.95
    # copies of the query tie: the smaller ids come first
    assert [i for _, i, _ in got[100]][:20] == [i for _, i in exact(x, 100, 20)]


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16))
    codes = A.learn(x, float((x * x).sum(axis=1).max()), bits=64)
    index = A.Index(codes, np.arange(2000), x)
    for q in range(0, 2000, 97):
        word = codes.words(x[q : q + 1], True)[0]
        apart = A._BITS[index.words ^ word].sum(axis=1)
        for radius in (0, 3, 4, 15, 16, 17, 30, 64):
            assert index.within(word, radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [0.5, 0.5], ""), (2, None, ""), (3, [0.0, 0.0], ""), (4, [float("nan"), 1.0], ""), (5, [float("inf"), 1.0], ""), (6, [None, 1.0], ""),
            (7, [1.0], ""), (None, [1.0, 1.0], ""), (20, [0.9, 0.1], ""), (20, [0.9, 0.1], ""), (40, [0.9, 0.1], ""), (60, [], "")]
    got = answers(A.search(frame(spark, rows), F.col("id") % 20 == 0, k=20))
    assert {q: [i for _, i, _ in f] for q, f in got.items()} == {0: [20, 40, 1], 20: [0, 40, 1], 40: [0, 20, 1]}
    assert A.search(frame(spark, []), F.col("id") % 20 == 0).collect() == []
    assert A.search(frame(spark, [(0, [1.0], "")]), F.col("id") % 20 == 0).collect() == []
