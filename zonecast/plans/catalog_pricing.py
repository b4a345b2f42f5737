"""Registered pricing queries (I1-I14, K4) with the rule forecast as predicted demand."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonecast.config import PriceConfig, SENSITIVITY_ELASTICITIES
from zonecast.operators import pricing as PR
from zonecast.operators import splits as S
from zonecast.plans import oracle as O
from zonecast.plans.catalog import present, register, scored

CFG = PriceConfig()
KEYS = ["pickup_zone", "pickup_date", "hour"]
KEY_SQL = "pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour"
RESULT = "optimal_price, expected_demand, expected_revenue, static_price, static_revenue, uplift_percent"
REF_SQL = O.ref_price_sql(["avg_fare_amount", "avg_total_amount"])
CTX = dict(peak="is_peak_hour", weekend="is_weekend", volume="zone_trip_volume")


def _priced_sql(src: str, context: bool = True, extra_keys: str = "") -> str:
    keys = "pickup_zone, pickup_date, hour, demand, predicted_demand" + extra_keys
    pts = O.price_points_sql(src, "predicted_demand", REF_SQL, CFG, keys=keys + ", " + REF_SQL + " AS reference_price",
                             **(CTX if context else {}))
    return O.price_best_sql(pts, ["pickup_zone", "pickup_date", "hour"] + ([extra_keys.strip(", ")] if extra_keys else []), CFG)


# ---- every model-frame row -------------------------------------------------
def q_panel_prices(spark, sf):
    s = scored(spark, sf)
    p = PR.optimize_prices(s, "predicted_demand", CFG)
    return present(p.select(*KEYS, "predicted_demand", "reference_price", *RESULT.split(", ")))


register("panel_prices", O.with_ctes("scored") + f"""
SELECT {KEY_SQL}, predicted_demand, reference_price, {RESULT}
FROM ({_priced_sql('scored')})""")(q_panel_prices)


# ---- batch simulation over every test row (I12, I13) -----------------------
def _test_priced(spark, sf):
    s = scored(spark, sf).where(F.col("split") == "test")
    return PR.optimize_prices(s, "predicted_demand", CFG)


_SIM_SQL = f"""
sim AS (
  SELECT strftime(pickup_date, '%Y-%m-%dT%H:%M:%S') AS pickup_date, hour, pickup_zone,
    CAST(demand AS DOUBLE) AS actual_demand, predicted_demand, static_price, static_revenue, optimal_price,
    expected_revenue AS optimal_revenue, uplift_percent
  FROM ({_priced_sql("(SELECT * FROM scored WHERE split = 'test')")}))"""
_SIM_WITH = O.with_ctes("scored")[:-1] + ",\n" + _SIM_SQL + "\n"


@register("pricing_simulation", _SIM_WITH + "SELECT * FROM sim")
def q_pricing_simulation(spark, sf):
    return PR.simulation_table(_test_priced(spark, sf))


@register("simulation_summary", _SIM_WITH + """
SELECT CAST(count(*) AS BIGINT) AS sample_size, avg(predicted_demand) AS average_predicted_demand,
  avg(static_revenue) AS average_static_revenue, avg(optimal_revenue) AS average_optimal_revenue,
  avg(uplift_percent) AS average_uplift_percent FROM sim""")
def q_simulation_summary(spark, sf):
    return PR.simulation_summary(PR.simulation_table(_test_priced(spark, sf)))


@register("top_uplift_cases", _SIM_WITH + """
SELECT * FROM sim ORDER BY uplift_percent DESC, pickup_zone, pickup_date, hour LIMIT 5""")
def q_top_uplift_cases(spark, sf):
    return PR.top_uplift(PR.simulation_table(_test_priced(spark, sf)), 5)


@register("sampled_simulation", _SIM_WITH.replace(
    "(SELECT * FROM scored WHERE split = 'test')",
    "(SELECT * FROM scored WHERE split = 'test' ORDER BY md5(concat_ws('#', '42', pickup_zone, "
    "strftime(pickup_date, '%Y-%m-%d'), CAST(hour AS VARCHAR))), pickup_zone, pickup_date, hour LIMIT 100)") +
    "SELECT * FROM sim")
def q_sampled_simulation(spark, sf):
    """The source's batch shape: a seeded sample of 100 test rows (F3 + I12)."""
    s = S.seeded_sample(scored(spark, sf).where(F.col("split") == "test"), 100, seed=42)
    return PR.simulation_table(PR.optimize_prices(s, "predicted_demand", CFG))


# ---- demo case: representative test row, no row context (I7-I10, I14) -----
_DEMO_SQL = """
demo AS (
  SELECT * FROM scored WHERE split = 'test'
  ORDER BY abs(CAST(demand AS DOUBLE) - (SELECT median(CAST(demand AS DOUBLE)) FROM scored WHERE split = 'test')),
    pickup_zone, pickup_date, hour LIMIT 1)"""
_DEMO_WITH = O.with_ctes("scored")[:-1] + ",\n" + _DEMO_SQL + "\n"


def _demo_row(spark, sf):
    return S.representative_row(scored(spark, sf).where(F.col("split") == "test"))


def _demo_priced(spark, sf):
    return PR.optimize_prices(_demo_row(spark, sf), "predicted_demand", CFG, use_context=False)


@register("demo_pricing", _DEMO_WITH + f"""
SELECT {KEY_SQL}, CAST(demand AS DOUBLE) AS actual_demand, predicted_demand, reference_price, {RESULT}
FROM ({_priced_sql('demo', context=False)})""")
def q_demo_pricing(spark, sf):
    p = _demo_priced(spark, sf)
    return present(p.select(*KEYS, F.col("demand").cast("double").alias("actual_demand"), "predicted_demand",
                            "reference_price", *RESULT.split(", ")))


@register("demo_explanation", _DEMO_WITH + f"""
SELECT printf('Optimal price = %.2f, expected demand = %.2f, expected revenue = %.2f, uplift over static pricing = %.2f%%',
  optimal_price, expected_demand, expected_revenue, uplift_percent) AS explanation
FROM ({_priced_sql('demo', context=False)})""")
def q_demo_explanation(spark, sf):
    return PR.explain(_demo_priced(spark, sf)).select("explanation")


@register("scenario_comparison", _DEMO_WITH + f"""
SELECT 'Static pricing' AS scenario, static_price AS price, static_revenue AS revenue FROM ({_priced_sql('demo', context=False)})
UNION ALL
SELECT 'Dynamic pricing', optimal_price, expected_revenue FROM ({_priced_sql('demo', context=False)})""")
def q_scenario_comparison(spark, sf):
    return PR.scenario_table(_demo_priced(spark, sf))


@register("demo_revenue_curve", _DEMO_WITH + f"""
SELECT CAST(_i AS INTEGER) AS point, _price AS price, _adj AS adjusted_demand, _revenue AS revenue, _score AS objective_score
FROM ({O.price_points_sql('demo', 'predicted_demand', REF_SQL, CFG, keys='pickup_zone')})""")
def q_demo_revenue_curve(spark, sf):
    return PR.revenue_curve(_demo_row(spark, sf), "predicted_demand", CFG, use_context=False)


_ELAST = ", ".join(O.d(e) for e in SENSITIVITY_ELASTICITIES)


def _sens_sql(src: str, context: bool, keys: str) -> str:
    pts = O.price_points_sql(f"(SELECT *, unnest([{_ELAST}]) AS elasticity FROM {src})", "predicted_demand", REF_SQL,
                             CFG, elasticity="elasticity", keys=keys + ", elasticity", **(CTX if context else {}))
    return O.price_best_sql(pts, keys.split(", ") + ["elasticity"], CFG)


@register("demo_sensitivity", _DEMO_WITH + f"""
SELECT elasticity, {RESULT} FROM ({_sens_sql('demo', False, 'pickup_zone')})""")
def q_demo_sensitivity(spark, sf):
    return PR.sensitivity(_demo_row(spark, sf), "predicted_demand", CFG, use_context=False)


# ---- whole-table curves and sensitivity (I8, I9 over every test row) -------
@register("revenue_curves_test", O.with_ctes("scored") + f"""
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, CAST(_i AS INTEGER) AS point,
  _price AS price, _adj AS adjusted_demand, _revenue AS revenue, _score AS objective_score
FROM ({O.price_points_sql("(SELECT * FROM scored WHERE split = 'test')", 'predicted_demand', REF_SQL, CFG,
                          keys='pickup_zone, pickup_date, hour', **CTX)})""")
def q_revenue_curves_test(spark, sf):
    s = scored(spark, sf).where(F.col("split") == "test")
    return present(PR.revenue_curve(s, "predicted_demand", CFG, keep=tuple(KEYS)))


@register("sensitivity_test", O.with_ctes("scored") + f"""
SELECT pickup_zone, strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, elasticity, {RESULT}
FROM ({_sens_sql("(SELECT * FROM scored WHERE split = 'test')", True, 'pickup_zone, pickup_date, hour')})""")
def q_sensitivity_test(spark, sf):
    s = scored(spark, sf).where(F.col("split") == "test")
    return present(PR.sensitivity(s, "predicted_demand", CFG, keep=tuple(KEYS)))
