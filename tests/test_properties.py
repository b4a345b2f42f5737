"""Property checks: price search vs a brute-force scan, skewed panel, partition invariance."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from zonecast.config import PriceConfig
from zonecast.operators import pricing as PR


def brute_force(d, ref, peak, weekend, vol, cfg=PriceConfig()):
    """Plain-Python scan of the grid, written from the rules."""
    e = cfg.elasticity
    if peak == 1:
        e *= cfg.peak_factor
    if weekend == 1:
        e *= cfg.weekend_factor
    if vol > cfg.high_volume_threshold:
        e *= cfg.high_volume_factor
    elif vol < cfg.low_volume_threshold:
        e *= cfg.low_volume_factor
    if d >= cfg.high_demand_threshold:
        e *= cfg.high_demand_factor
    elif d <= cfg.low_demand_threshold:
        e *= cfg.low_demand_factor
    e = max(e, cfg.min_elasticity)
    r = ref if ref > 0 else cfg.mid_price
    lo, hi = max(cfg.min_price, r * cfg.min_discount_multiplier), min(cfg.max_price, r * cfg.max_markup_multiplier)
    if hi <= lo:
        lo, hi = cfg.min_price, cfg.max_price
    n = math.ceil(((hi + cfg.price_step) - lo) / cfg.price_step)
    delta = (lo + cfg.price_step) - lo
    rd = ref if ref > 0 else 1.0

    def adj(p):
        return max(d * math.exp(-e * ((p - rd) / rd)), cfg.floor_demand_ratio * d)

    best = None
    for i in range(n):
        p = lo + i * delta
        a = adj(p)
        pct = 0.0 if ref <= 0 else (p - ref) / ref
        score = p * a - cfg.price_change_penalty * d * ref * (pct * pct)
        if best is None or score > best[0]:
            best = (score, p, a, p * a)
    static = ref * adj(ref)
    uplift = (best[3] - static) / static * 100 if static > 0 else 0.0
    return best[1], best[2], best[3], static, uplift, n


def test_price_search_matches_brute_force(spark):
    rng = np.random.default_rng(21)
    n = 300
    pdf = pd.DataFrame({
        "k": np.arange(n),
        "predicted_demand": np.round(rng.choice([0.0, 1.0, 20.0, 150.0, 700.0], n) * rng.random(n) * 2, 3),
        "avg_fare_amount": np.round(rng.choice([-1.0, 0.0, 3.0, 12.5, 38.25, 90.0, 200.0], n) * rng.random(n) * 1.5, 4),
        "is_peak_hour": rng.integers(0, 2, n), "is_weekend": rng.integers(0, 2, n),
        "zone_trip_volume": rng.choice([100.0, 200.0, 500.0, 700.0, 900.0], n)})
    got = PR.optimize_prices(spark.createDataFrame(pdf)).orderBy("k").toPandas()
    for row, g in zip(pdf.itertuples(), got.itertuples()):
        ref = row.avg_fare_amount if row.avg_fare_amount > 0 else PriceConfig().mid_price
        p, a, rev, static, uplift, _ = brute_force(row.predicted_demand, ref, row.is_peak_hour, row.is_weekend,
                                                   row.zone_trip_volume)
        assert math.isclose(g.optimal_price, p, rel_tol=1e-12), row
        assert math.isclose(g.expected_revenue, rev, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g.static_revenue, static, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(g.uplift_percent, uplift, rel_tol=1e-7, abs_tol=1e-7)


def test_optimum_score_dominates_curve(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.arange(50), "predicted_demand": rng.random(50) * 300,
                        "avg_fare_amount": rng.random(50) * 60 + 2})
    df = spark.createDataFrame(pdf)
    best = PR.optimize_prices(df, use_context=False).select("k", "optimal_price")
    curve = PR.revenue_curve(df, use_context=False, keep=("k",))
    top = curve.groupBy("k").agg(F.max("objective_score").alias("mx"))
    at_best = curve.join(best, on="k").where(F.col("price") == F.col("optimal_price")).select("k", "objective_score")
    bad = top.join(at_best, on="k").where(F.col("objective_score") < F.col("mx"))
    assert bad.count() == 0 and at_best.count() == 50


def skewed_trips(spark, n=3000):
    """Raw-trip rows where one zone holds a third of all trips."""
    from zonecast.config import RAW_COLUMNS

    rng = np.random.default_rng(3)
    hot = rng.random(n) < 1 / 3
    lat = np.where(hot, 40.75, 40.70 + rng.integers(0, 30, n) * 0.01)
    lon = np.where(hot, -73.99, -74.00 + rng.integers(0, 10, n) * 0.01)
    start = pd.Timestamp("2024-03-01") + pd.to_timedelta(rng.integers(0, 14 * 24 * 60, n), unit="m")
    pdf = pd.DataFrame({
        "VendorID": rng.integers(1, 3, n).astype(float), "tpep_pickup_datetime": start,
        "tpep_dropoff_datetime": start + pd.to_timedelta(15, unit="m"), "passenger_count": 1.0,
        "trip_distance": 2.0, "pickup_longitude": lon, "pickup_latitude": lat, "dropoff_longitude": -73.95,
        "dropoff_latitude": 40.72, "payment_type": 1.0, "fare_amount": 10.0, "extra": 0.5, "mta_tax": 0.5,
        "tip_amount": 1.0, "tolls_amount": 0.0, "improvement_surcharge": 0.3, "total_amount": 12.3,
        "store_and_fwd_flag": "N"})
    from zonecast.sources.trips import typed_raw_trips

    df = spark.createDataFrame(pdf[RAW_COLUMNS])
    return typed_raw_trips(df.withColumn("tpep_pickup_datetime", F.col("tpep_pickup_datetime").cast("timestamp_ntz"))
                           .withColumn("tpep_dropoff_datetime", F.col("tpep_dropoff_datetime").cast("timestamp_ntz"))), pdf


def test_skewed_panel_partial_aggregation_and_counts(spark):
    from zonecast.operators.clean import clean_trips
    from zonecast.operators.panel import aggregate_panel

    raw, pdf = skewed_trips(spark)
    core = aggregate_panel(clean_trips(raw))
    plan = core._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan  # map-side combine before the shuffle
    got = core.groupBy("pickup_zone").agg(F.sum("demand").alias("n")).toPandas().set_index("pickup_zone")["n"]
    assert got["40.75_-73.99"] == int(((pdf.pickup_latitude == 40.75) & (pdf.pickup_longitude == -73.99)).sum())
    assert got.sum() == len(pdf)


def test_panel_partition_invariance(spark):
    from zonecast.operators.clean import clean_trips
    from zonecast.operators.panel import build_panel

    raw, _ = skewed_trips(spark, 800)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(tuple(r) for r in build_panel(clean_trips(raw.repartition(1))).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        b = sorted(tuple(r) for r in build_panel(clean_trips(raw.repartition(5))).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all((u == v) or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-12)) for u, v in zip(x, y))
