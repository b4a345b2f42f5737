"""Extremely randomised trees against a plain version with the same draws."""

import numpy as np
import pandas as pd
import pytest

from zonecast.operators import extra_trees as X

COLS = ["a", "b", "c"]


def frame(spark, n=200, parts=3):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, n).astype(float), "b": rng.normal(size=n), "c": np.ones(n)})
    pdf["y"] = np.round(pdf.a * 2 + np.sin(pdf.b) * 3 + rng.normal(0, 0.2, n), 2)
    return spark.createDataFrame(pdf).repartition(parts), pdf


def plain_forest(x, y, p):
    """{(rows of a leaf): its mean} of each tree: each node's thresholds drawn in its own range, all trees level by level."""
    count, level, leaves = p.trees, [(t, t, np.arange(len(y)), 0) for t in range(p.trees)], [{} for _ in range(p.trees)]
    splits = [[] for _ in range(p.trees)]
    while level:
        deeper = []
        for node, tree, rows, depth in level:
            u = X._draws(p.seed, np.array([node]), x.shape[1])[0]
            best = None
            open_node = len(rows) >= 2 * p.min_leaf and np.ptp(y[rows]) > 0 and (p.max_depth is None or depth < p.max_depth)
            for f in range(x.shape[1]) if open_node else ():
                v = x[rows, f]
                cut = v.min() + u[f] * (v.max() - v.min())
                low, high = rows[v <= cut], rows[v > cut]
                if min(len(low), len(high)) >= p.min_leaf:
                    error = sum(((y[s] - y[s].mean()) ** 2).sum() for s in (low, high))
                    if best is None or error < best[0] - 1e-9:
                        best = (error, f, cut, low, high)
            if best is None:
                leaves[tree][tuple(rows)] = y[rows].mean()
                continue
            splits[tree].append((best[1], best[2]))
            for side in best[3:]:
                deeper.append((count, tree, side, depth + 1))
                count += 1
        level = deeper
    return splits, leaves


@pytest.mark.parametrize("p", [X.ExtraTreesParams(trees=5, min_leaf=2), X.ExtraTreesParams(trees=3, min_leaf=6, max_depth=3, seed=5)])
def test_equals_a_plain_version(spark, p, monkeypatch):
    monkeypatch.setattr(X, "NODES_A_JOB", 40)  # levels of several jobs
    df, pdf = frame(spark)
    got = X.fit_extra_trees(df, COLS, "y", p)
    x, y = pdf[COLS].to_numpy(), pdf.y.to_numpy()
    splits, leaves = plain_forest(x, y, p)
    assert sum(f >= 0 for f in got["feature"]) == sum(map(len, splits))
    nodes = (np.asarray(got["feature"]), np.asarray(got["cut"]), np.asarray(got["left"]), np.asarray(got["right"]))
    want = np.zeros(len(y))
    for tree in range(p.trees):
        row, at = X.walk(x, np.array([tree]), nodes)
        for rows, mean in leaves[tree].items():
            assert len(set(at[list(rows)])) == 1  # the same leaf
            assert got["base"] + got["value"][at[rows[0]]] == pytest.approx(mean, abs=1e-6)
            want[list(rows)] += mean / p.trees
        assert len(set(at)) == len(leaves[tree])
    model = X.ExtraTreesModel()._set(inputCols=COLS, predictionCol="prediction", forest=X.json.dumps(got))
    scored = model.transform(spark.createDataFrame(pdf.assign(want=want))).toPandas()
    assert np.allclose(scored.prediction, scored.want, atol=1e-6)


def test_seeds_differ_and_partitions_do_not_matter(spark):
    fit = lambda parts, seed: X.fit_extra_trees(frame(spark, parts=parts)[0], COLS, "y", X.ExtraTreesParams(trees=4, seed=seed))
    first = fit(1, 42)
    assert fit(6, 42) == first and fit(1, 43) != first
    assert first["cut"][0] != first["cut"][1]  # trees differ though all see all rows


def test_a_level_is_two_jobs(spark):
    df, _ = frame(spark)
    sc, jobs = spark.sparkContext, {}
    for depth in (2, 7):
        sc.setJobGroup(f"extra-trees-{depth}", "jobs of a fit")
        X.fit_extra_trees(df, COLS, "y", X.ExtraTreesParams(trees=12, max_depth=depth))
        jobs[depth] = len(sc.statusTracker().getJobIdsForGroup(f"extra-trees-{depth}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[7] - jobs[2] == 5 * 2


def test_rows_of_many_blocks_and_merged_tables(spark, monkeypatch):
    df, _ = frame(spark)
    p = X.ExtraTreesParams(trees=9, min_leaf=2)
    one = X.fit_extra_trees(df, COLS, "y", p)
    monkeypatch.setattr(X, "BLOCK_ROWS", 7)  # many blocks: tasks share nodes
    monkeypatch.setattr(X, "SNAPSHOT", 2)
    assert X.fit_extra_trees(df, COLS, "y", p) == one
    a, b = (np.array([1, 4]), np.array([[1.0], [2.0]])), (np.array([2, 4, 5]), np.array([[3.0], [4.0], [5.0]]))
    nodes, sums = X._merged(a, b, np.add)
    assert nodes.tolist() == [1, 2, 4, 5] and sums.ravel().tolist() == [1, 3, 6, 5]


def test_thresholds_lie_within_the_node(spark):
    df, pdf = frame(spark)
    got = X.fit_extra_trees(df, COLS, "y", X.ExtraTreesParams(trees=3))
    for f, cut in zip(got["feature"], got["cut"]):
        assert f in (-1, 0, 1)  # the constant column never splits
        if f >= 0:
            assert pdf[COLS[f]].min() <= cut < pdf[COLS[f]].max()


def test_odd_frames(spark):
    schema = "a double, b double, c double, y double"
    p = X.ExtraTreesParams(trees=2, min_leaf=1)
    assert X.fit_extra_trees(spark.createDataFrame([], schema), COLS, "y", p)["feature"] == [-1, -1]
    same = X.fit_extra_trees(spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)] * 3, schema), COLS, "y", p)
    assert same["base"] == 5.0 and same["value"] == [0.0, 0.0]
    flat = X.fit_extra_trees(spark.createDataFrame([(1.0, 2.0, 3.0, float(i)) for i in range(4)], schema), COLS, "y", p)
    assert flat["feature"] == [-1, -1] and flat["base"] + flat["value"][0] == pytest.approx(1.5)
    df, _ = frame(spark)
    extra = df.unionByName(spark.createDataFrame([(1.0, 1.0, 1.0, None)], schema))
    assert X.fit_extra_trees(extra, COLS, "y", p) == X.fit_extra_trees(df, COLS, "y", p)
