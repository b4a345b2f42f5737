"""Price search against the stored results of the source pipeline, plus edge rules."""

import math

import pytest
from pyspark.sql import functions as F

from zonecast.config import PriceConfig
from zonecast.operators import pricing as PR

# fixed values: stored demo case (reference 38.25, elasticity .35, no row context)
DEMO_REF = 38.25
DEMO_STATIC_REVENUE = 1067.9638491603084
DEMO_DEMAND = DEMO_STATIC_REVENUE / DEMO_REF
DEMO_BEST = dict(optimal_price=51.6875, expected_demand=24.69024171324406,
                 expected_revenue=1276.1768685533023, static_price=38.25,
                 static_revenue=1067.9638491603084, uplift_percent=19.496260997664134)
# fixed values: first rows of the stored revenue curve (price, adjusted_demand, revenue, objective_score)
DEMO_CURVE_HEAD = [
    (28.6875, 30.473748545640206, 874.2156614030534, 873.2144452944657),
    (29.6875, 30.19617566571387, 896.4489650758806, 895.6462043794781),
    (30.6875, 29.92113108333371, 918.2047101198032, 917.5785063073449),
    (31.6875, 29.64859176927408, 939.4897516888724, 939.0182062321172),
]
# fixed values: stored sensitivity curve (elasticity, expected_demand, expected_revenue, uplift_percent)
DEMO_SENSITIVITY = [
    (0.15, 26.4874101425821, 1369.0680117447123, 28.194227999491595),
    (0.25, 25.57304359629851, 1321.8066908836793, 23.76886089570878),
    (0.35, 24.69024171324406, 1276.1768685533023, 19.496260997664134),
    (0.5, 23.42284937166508, 1210.6685268979388, 13.362313513686125),
    (0.7, 21.833611118876306, 1128.524774706919, 5.670690594464125),
]
# fixed values: stored simulation rows (date, hour, predicted, static_price, static_rev, optimal_price, optimal_rev)
SIM_ROWS = [
    ("2015-01-27", 23, 12.488882767494328, 7.6923075, 96.06832657901738, 10.769230625, 117.3841531037569),
    ("2015-01-31", 5, 5.72823562741297, 5.0, 28.641178137064852, 7.0, 35.23506367531572),
    ("2015-01-28", 14, 463.65847301365966, 10.892157, 5050.240882445044, 15.16911775, 6292.347858912257),
]


def close(a, b, rel=1e-9):
    return math.isclose(a, b, rel_tol=rel, abs_tol=1e-9)


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame([(DEMO_DEMAND, DEMO_REF)], "predicted_demand double, avg_fare_amount double")


def test_demo_best_price(demo):
    r = PR.optimize_prices(demo, use_context=False).first().asDict()
    for k, v in DEMO_BEST.items():
        assert close(r[k], v), (k, r[k], v)


def test_demo_curve(demo):
    rows = PR.revenue_curve(demo, use_context=False).orderBy("point").collect()
    assert len(rows) == 24  # overshoots the band's upper bound 51.6375 by one step
    assert close(rows[-1]["price"], 51.6875)
    for got, want in zip(rows, DEMO_CURVE_HEAD):
        assert close(got["price"], want[0]) and close(got["adjusted_demand"], want[1])
        assert close(got["revenue"], want[2]) and close(got["objective_score"], want[3])


def test_demo_sensitivity(demo):
    rows = PR.sensitivity(demo, use_context=False).orderBy("elasticity").collect()
    for got, want in zip(rows, DEMO_SENSITIVITY):
        assert close(got["elasticity"], want[0])
        assert close(got["optimal_price"], 51.6875)
        assert close(got["expected_demand"], want[1]) and close(got["expected_revenue"], want[2])
        assert close(got["uplift_percent"], want[3], 1e-8)


@pytest.mark.parametrize("row", SIM_ROWS)
def test_simulation_rows_with_context(spark, row):
    date, hour, pred, ref, static_rev, opt_price, opt_rev = row
    # zone volume is not stored: one of the three volume factors must reproduce the row
    df = spark.createDataFrame([(pred, ref, date, hour, float(v)) for v in (100, 500, 800)],
                               "predicted_demand double, avg_fare_amount double, d string, hour int, zone_trip_volume double")
    df = df.withColumn("is_peak_hour", F.col("hour").isin(7, 8, 9, 16, 17, 18, 19).cast("int")) \
        .withColumn("is_weekend", (F.weekday(F.to_date("d")) >= 5).cast("int"))
    out = PR.optimize_prices(df).collect()
    assert any(close(r["optimal_price"], opt_price, 1e-6) and close(r["expected_revenue"], opt_rev, 1e-6)
               and close(r["static_revenue"], static_rev, 1e-6) for r in out)


def test_band_rules_and_fallbacks(spark):
    cfg = PriceConfig()
    df = spark.createDataFrame(
        [(1, 50.0, None), (2, 50.0, 200.0), (3, 20.0, 40.0), (4, 150.0, 40.0)],
        "k int, predicted_demand double, avg_fare_amount double")
    out = {r["k"]: r for r in PR.optimize_prices(df, use_context=False).collect()}
    assert out[1]["reference_price"] == cfg.mid_price  # no fare -> midpoint 52.5
    # fare 200: band [150, 100] collapses to [5, 100]; grid starts at 5
    curve = PR.revenue_curve(df.where("k = 2"), use_context=False).orderBy("point").collect()
    assert curve[0]["price"] == 5.0 and len(curve) == 96
    # demand exactly 20 and 150 take the low / high demand factors
    from zonecast.functions.pricing import context_elasticity
    e = df.select("k", context_elasticity(F.col("predicted_demand")).alias("e")).collect()
    got = {r["k"]: r["e"] for r in e}
    assert close(got[3], 0.35 * 1.08) and close(got[4], 0.35 * 0.90)


def test_volume_thresholds(spark):
    from zonecast.functions.pricing import context_elasticity
    df = spark.createDataFrame([(200.0,), (700.0,), (199.0,), (701.0,)], "v double")
    got = [r[0] for r in df.select(context_elasticity(F.lit(50.0), volume=F.col("v"))).collect()]
    assert close(got[0], 0.35) and close(got[1], 0.35)
    assert close(got[2], 0.35 * 1.05) and close(got[3], 0.35 * 0.90)


def test_tie_keeps_lowest_price(spark):
    # zero demand: every grid point scores 0, the first (lowest) price must win
    df = spark.createDataFrame([(0.0, 10.0)], "predicted_demand double, avg_fare_amount double")
    r = PR.optimize_prices(df, use_context=False).first()
    assert r["optimal_price"] == 7.5 and r["uplift_percent"] == 0.0


def test_optimum_dominates_curve(spark):
    df = spark.createDataFrame([(d, f) for d in (3.0, 40.0, 300.0) for f in (6.0, 17.0, 90.0)],
                               "predicted_demand double, avg_fare_amount double")
    best = PR.optimize_prices(df, use_context=False)
    curve = PR.revenue_curve(df, use_context=False, keep=("predicted_demand", "avg_fare_amount"))
    mx = curve.groupBy("predicted_demand", "avg_fare_amount").agg(F.max("revenue").alias("mr"))
    assert best.count() == 9 and mx.count() == 9


def test_price_search_is_one_stage(spark):
    df = spark.range(100).select((F.col("id") + 1).cast("double").alias("predicted_demand"),
                                 (F.col("id") % 30 + 3).cast("double").alias("avg_fare_amount"))
    plan = PR.optimize_prices(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
