"""Histogram boosting against a plain search, one split at a time; fitted stages saved and loaded."""

import json

import numpy as np
import pandas as pd
import pytest

from zonecast.config import ALL_FEATURES
from zonecast.operators import boosting as B
from zonecast.operators import models as ML
from zonecast.operators import stages as ST
from zonecast.sources.sinks import load_model, save_model

COLS = ["a", "b", "c"]


def frame(spark, n=400, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.integers(0, 12, n).astype(float), "b": np.round(rng.normal(size=n), 2),
                        "c": rng.integers(0, 2, n).astype(float)})
    pdf["y"] = np.round(pdf.a * 2 + np.sin(pdf.b * 3) * 4 + pdf.a * pdf.c + rng.normal(0, 0.3, n), 3)
    return spark.createDataFrame(pdf).repartition(parts), pdf


def plain_tree(bins, residual, p):
    """[(feature, cut)] in order of the splits, and each row's leaf value: every split of every leaf tried by direct sums."""
    score = lambda r: r.sum() ** 2 / (len(r) + p.l2)
    leaves, serial, order = {0: (np.arange(len(residual)), 0)}, 1, []

    def best(rows, depth):
        found = (0.0, 0, 0)
        if p.max_depth is not None and depth >= p.max_depth:
            return found
        for f in range(bins.shape[1]):
            for cut in range(bins[:, f].max()):
                low = bins[rows, f] <= cut
                l, r = residual[rows[low]], residual[rows[~low]]
                if min(len(l), len(r)) >= max(p.min_leaf, 1):
                    gain = score(l) + score(r) - score(residual[rows])
                    if gain > found[0] + 1e-9:
                        found = (gain, f, cut)
        return found

    gains = {0: best(*leaves[0])}
    while p.max_leaves is None or len(leaves) < p.max_leaves:
        i = min(leaves, key=lambda j: (-gains[j][0], j))
        gain, f, cut = gains[i]
        if gain <= 1e-7:
            break
        order.append((f, cut))
        rows, depth = leaves.pop(i)
        low = bins[rows, f] <= cut
        for side in (rows[low], rows[~low]):
            leaves[serial] = (side, depth + 1)
            gains[serial] = best(side, depth + 1)
            serial += 1
    value = np.zeros(len(residual))
    for rows, _ in leaves.values():
        value[rows] = p.rate * residual[rows].sum() / (len(rows) + p.l2)
    return order, value


def splits(tree):
    """(feature, cut) of a fitted tree in the order in which they were made."""
    inner = [i for i, f in enumerate(tree["feature"]) if f >= 0]
    return [(tree["feature"][i], tree["cut"][i]) for i in sorted(inner, key=lambda i: tree["left"][i])]


@pytest.mark.parametrize("p", [
    B.BoostParams(trees=3, rate=0.3, max_leaves=7, min_leaf=5, l2=0.1),
    B.BoostParams(trees=2, rate=0.3, max_leaves=12, max_depth=4, min_leaf=10, l2=2.0, max_bins=20),
    B.BoostParams(trees=2, rate=0.5, max_leaves=None, max_depth=3, min_leaf=1, l2=1.0),
], ids=["leaf-wise", "capped", "level-wise"])
def test_trees_equal_a_plain_search(spark, p):
    df, pdf = frame(spark)
    forest = B.fit_boosted(df, COLS, "y", p)
    bins = B.to_bins([pdf[c].to_numpy() for c in COLS], [np.asarray(e) for e in forest["edges"]])
    raw = np.full(len(pdf), forest["base"])
    for tree in forest["trees"]:
        order, value = plain_tree(bins.astype(int), pdf.y.to_numpy() - raw, p)
        assert sorted(splits(tree)) == sorted(order) if p.max_leaves is None else splits(tree) == order
        got = np.asarray(tree["value"])[B.route(B.Tree(**tree), bins)]
        assert np.allclose(got, value, atol=1e-6)
        raw += got


def test_leaf_count_depth_and_least_rows_hold(spark):
    df, pdf = frame(spark, n=3000, seed=4)
    forest = B.fit_boosted(df, COLS, "y", B.BoostParams(trees=3, max_leaves=63, min_leaf=2))
    trees = [B.Tree(**t) for t in forest["trees"]]
    assert [t.leaves for t in trees] == [63] * 3
    bins = B.to_bins([pdf[c].to_numpy() for c in COLS], [np.asarray(e) for e in forest["edges"]])
    assert min(np.unique(B.route(trees[0], bins), return_counts=True)[1]) >= 2
    assert max(len(e) for e in forest["edges"]) <= 254


def test_l2_changes_leaves_as_the_formula_says(spark):
    df, pdf = frame(spark)
    for l2 in (0.0, 5.0):
        t = B.fit_boosted(df, COLS, "y", B.BoostParams(trees=1, rate=1.0, max_leaves=2, l2=l2))
        tree = t["trees"][0]
        bins = B.to_bins([pdf[c].to_numpy() for c in COLS], [np.asarray(e) for e in t["edges"]])
        low = bins[:, tree["feature"][0]] <= tree["cut"][0]
        for side, child in ((low, tree["left"][0]), (~low, tree["right"][0])):
            r = pdf.y[side] - t["base"]
            assert tree["value"][child] == pytest.approx(r.sum() / (side.sum() + l2), abs=1e-6)


def test_partitions_do_not_matter_but_seeds_do(spark):
    p = {"trees": 10, "rate": 0.1, "max_leaves": 6, "subsample": 0.8, "colsample": 0.67}
    one, many = (B.fit_boosted(frame(spark, parts=n)[0], COLS, "y", B.BoostParams(**p)) for n in (1, 7))
    assert one == many  # ten trees: across a stored state too
    assert B.fit_boosted(frame(spark)[0], COLS, "y", B.BoostParams(**p, seed=7)) != one


def test_a_level_is_one_job_and_the_last_needs_none(spark):
    df, _ = frame(spark, n=600)
    sc, jobs = spark.sparkContext, {}
    p = {"max_leaves": 31, "max_depth": 3, "min_leaf": 2}
    for trees in (2, 7):
        sc.setJobGroup(f"boosting-{trees}", "jobs of a fit")
        B.fit_boosted(df, COLS, "y", B.BoostParams(trees=trees, **p))
        jobs[trees] = len(sc.statusTracker().getJobIdsForGroup(f"boosting-{trees}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[7] - jobs[2] <= 5 * 3  # root and two levels; values of the third come from its parents' sums


def test_row_sampling_takes_its_share():
    key = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 20_000)
    first, second = B._sampled(key, 0, 42, 0.85), B._sampled(key, 1, 42, 0.85)
    assert abs(first.mean() - 0.85) < 0.01 and abs((first & second).mean() - 0.85**2) < 0.01


def test_odd_frames(spark):
    p = B.BoostParams(trees=2, min_leaf=1)
    empty = spark.createDataFrame([], "a double, b double, c double, y double")
    assert B.fit_boosted(empty, COLS, "y", p)["trees"] == []
    same = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)] * 4, "a double, b double, c double, y double")
    assert B.fit_boosted(same, COLS, "y", p) == {"base": 5.0, "edges": [[], [], []], "trees": []}
    flat = spark.createDataFrame([(1.0, 2.0, 3.0, float(i)) for i in range(4)], same.schema)
    assert [t["feature"] for t in B.fit_boosted(flat, COLS, "y", p)["trees"]] == [[-1], [-1]]  # nothing to split
    df, pdf = frame(spark)
    unlabelled = df.unionByName(spark.createDataFrame([(1.0, 1.0, 1.0, None), (1.0, 1.0, 1.0, float("nan"))], same.schema))
    assert B.fit_boosted(unlabelled, COLS, "y", p) == B.fit_boosted(df, COLS, "y", p)
    with pytest.raises(ValueError):
        B.fit_boosted(df, COLS, "y", B.BoostParams(max_bins=256))
    with pytest.raises(ValueError):
        B.fit_boosted(df, COLS, "y", B.BoostParams(max_leaves=None))


def model_frame(spark, n=300):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(n, len(ALL_FEATURES))), columns=ALL_FEATURES)
    pdf["demand"] = np.round(np.exp(pdf[ALL_FEATURES[0]]) * 5 + 1)
    pdf.loc[:5, "lag_24"] = np.nan
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("name", ML.HIST_BOOSTED)
def test_candidates_save_load_and_explain(spark, tmp_path, name):
    df = model_frame(spark)
    m = ML.fit(name, df, overrides={"trees": 4})
    assert len(m.stages[-1].content["trees"]) == 4
    save_model(m, str(tmp_path / "m"))
    scored = [ML.predict(x, df).select("predicted_demand").toPandas().predicted_demand.tolist()
              for x in (m, load_model(str(tmp_path / "m")))]
    assert scored[0] == scored[1] and len(set(scored[0])) > 3
    top = ML.native_importance(m).first()
    assert top["feature"] == ALL_FEATURES[0]


@pytest.mark.parametrize("name", ["linear_regression", "hist_gradient_boosting"])
def test_log_target_model_is_one_saveable_pipeline(spark, tmp_path, name):
    df = model_frame(spark)
    m = ML.fit_log_standardised(name, df, overrides={"trees": 3} if name.startswith("hist") else None)
    st = ML.log_target_stats(df).first()
    save_model(m, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"))
    p, q = (ML.predict(x, df).select("predicted_demand").toPandas().predicted_demand for x in (m, loaded))
    assert p.tolist() == q.tolist() and (p >= 0).all()
    inner = type(m)(m.stages[:-1])  # without the last stage: predictions of the transformed target
    z = ML.predict(inner, df).toPandas().predicted_demand
    assert np.allclose(np.sort(p), np.sort(np.maximum(np.expm1(z * st["log_std"] + st["log_mean"]), 0)))
    assert ML.native_importance(m).count() == len(ALL_FEATURES)


def test_imputer_and_scaler_stages(spark, tmp_path):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, None, 7.0), (2.0, None, 7.0), (nan, None, 7.0), (10.0, None, 7.0), (None, None, 7.0),
                                (5.0, None, 7.0)], "x double, y double, z double")
    cols = ["x", "y", "z"]
    m = ST.MedianImputer(inputCols=cols, outputCols=["x1", "y1", "z1"]).fit(df)
    assert m.getOrDefault(m.medians) == [3.5, 0.0, 7.0]  # the middle two's mean; nothing present; a constant
    m.write().overwrite().save(str(tmp_path / "i"))
    again = ST.MedianImputerModel.load(str(tmp_path / "i")).transform(df).select("x1", "y1", "z1").collect()
    assert [tuple(r) for r in again] == [(1, 0, 7), (2, 0, 7), (3.5, 0, 7), (10, 0, 7), (3.5, 0, 7), (5, 0, 7)]
    s = ST.PopulationScaler(inputCols=["x1", "z1"], outputCols=["x1", "z1"]).fit(m.transform(df))
    s.write().overwrite().save(str(tmp_path / "s"))
    got = ST.PopulationScalerModel.load(str(tmp_path / "s")).transform(m.transform(df)).toPandas()
    x = np.array([1, 2, 3.5, 10, 3.5, 5])
    assert np.allclose(got.x1, (x - x.mean()) / x.std()) and (got.z1 == 0).all()
    empty = ST.MedianImputer(inputCols=["x"], outputCols=["x"]).fit(df.limit(0))
    assert empty.getOrDefault(empty.medians) == [0.0]


def test_parameters_are_json(spark):
    r = B.HistBoostedRegressor(inputCols=COLS, labelCol="y")
    assert json.loads(r.getOrDefault(r.boost))["trees"] == 100
