"""Panel aggregation and lag windows against pandas on small data."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from zonecast.operators import lags as L
from zonecast.operators import splits as S


def small_panel(spark):
    rng = np.random.default_rng(7)
    rows = []
    # zone sizes 1, 24, 26 and a zone with gaps in its hours
    for zone, n in (("a", 1), ("b", 24), ("c", 26), ("d", 40)):
        hours = list(range(n)) if zone != "d" else sorted(rng.choice(200, n, replace=False).tolist())
        for h in hours:
            d = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(h))
            rows.append((zone, d.date(), d.hour, int(rng.integers(1, 50))))
    return spark.createDataFrame(rows, "pickup_zone string, pickup_date date, hour int, demand bigint")


def test_lags_match_pandas(spark):
    p = small_panel(spark)
    got = L.add_lag_features(p).toPandas().sort_values(["pickup_zone", "pickup_date", "hour"]).reset_index(drop=True)
    pdf = p.toPandas().sort_values(["pickup_zone", "pickup_date", "hour"]).reset_index(drop=True)
    g = pdf.groupby("pickup_zone")["demand"]
    want = {
        "lag_1": g.transform(lambda s: s.shift(1)), "lag_2": g.transform(lambda s: s.shift(2)),
        "lag_24": g.transform(lambda s: s.shift(24)),
        "rolling_mean_3": g.transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean()),
        "rolling_mean_24": g.transform(lambda s: s.shift(1).rolling(24, min_periods=1).mean()),
        "rolling_std_24": g.transform(lambda s: s.shift(1).rolling(24, min_periods=2).std()),
        "expanding_mean_zone": g.transform(lambda s: s.shift(1).expanding(min_periods=1).mean()),
    }
    for c, w in want.items():
        a = got[c].astype(float).to_numpy()
        b = w.astype(float).to_numpy()
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        assert np.allclose(a[~np.isnan(a)], b[~np.isnan(b)]), c
    assert got["date_ordinal"].iloc[0] == pd.Timestamp("2024-01-01").toordinal()


def test_lag_plan_single_exchange(spark):
    plan = L.add_lag_features(small_panel(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_partition_count_invariance(spark):
    p = small_panel(spark)
    a = sorted(L.add_lag_features(p.repartition(1)).select("pickup_zone", "hour", "pickup_date", "rolling_std_24").collect())
    b = sorted(L.add_lag_features(p.repartition(7)).select("pickup_zone", "hour", "pickup_date", "rolling_std_24").collect())
    assert a == b


def test_split_disjoint_and_ordered(spark):
    p = small_panel(spark)
    s = S.time_split(p).groupBy("split").agg(F.min("pickup_date").alias("lo"), F.max("pickup_date").alias("hi"),
                                             F.count_distinct("pickup_date").alias("n")).collect()
    r = {x["split"]: x for x in s}
    assert r["train"]["hi"] < r["val"]["lo"] and r["val"]["hi"] < r["test"]["lo"]
    n = sum(x["n"] for x in s)
    assert r["train"]["n"] == int(n * 0.7) and r["val"]["n"] == int(n * 0.85) - int(n * 0.7)


def test_fold_sizes_follow_expanding_window(spark):
    p = small_panel(spark)
    n = p.select("pickup_date").distinct().count()
    fs = S.fold_dates(p).groupBy("fold", "role").count().collect()
    got = {(r["fold"], r["role"]): r["count"] for r in fs}
    size = n // 4
    for k in (1, 2, 3):
        start = n - (3 - k + 1) * size
        assert got[(k, "train")] == start and got[(k, "val")] == size
