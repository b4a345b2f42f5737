"""Registered EDA and dashboard queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from zonecast.config import ALL_FEATURES, PANEL_COLUMNS, TRAIN_RATIO, PriceConfig
from zonecast.operators import clean as C
from zonecast.operators import eda as EDA
from zonecast.operators import gram as GR
from zonecast.operators import pricing as PR
from zonecast.operators import scenario as SC
from zonecast.operators.forecast import rule_forecast
from zonecast.plans import oracle as O
from zonecast.plans.catalog import bounds, model_rows, panel, present, register, test_predictions

# ---- D8 mean demand by each key (one GROUPING SETS pass) ------------------
_KEYS = EDA.MEAN_DEMAND_KEYS
_DIM = "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN '{k}'" for k in _KEYS) + " END"
_VAL = "CASE " + " ".join(f"WHEN grouping({k}) = 0 THEN CAST({k} AS INTEGER)" for k in _KEYS) + " END"


@register("mean_demand_by_key", O.with_ctes("panel") + f"""
SELECT {_DIM} AS dimension, {_VAL} AS key_value, avg(demand) AS mean_demand, CAST(count(*) AS BIGINT) AS rows
FROM panel GROUP BY GROUPING SETS ({", ".join(f"({k})" for k in _KEYS)})""")
def q_mean_demand_by_key(spark, sf):
    return EDA.mean_by_keys(panel(spark, sf))


@register("weekday_hour_pivot", O.with_ctes("panel") + "SELECT day_of_week, " + ", ".join(
    f"avg(CASE WHEN hour = {h} THEN demand END) AS hour_{h}" for h in range(24)) + " FROM panel GROUP BY day_of_week")
def q_weekday_hour_pivot(spark, sf):
    return EDA.weekday_hour_pivot(panel(spark, sf))


# ---- D11 correlation of the 29 numeric panel columns ----------------------
_NUMERIC = [c for c in PANEL_COLUMNS if c not in ("pickup_date", "pickup_zone")]


def _corr_sql() -> str:
    n = len(_NUMERIC)
    aggs = [f"var_pop(CAST({c} AS DOUBLE)) AS v{i}" for i, c in enumerate(_NUMERIC)]
    aggs += [f"covar_pop(CAST({_NUMERIC[i]} AS DOUBLE), CAST({_NUMERIC[j]} AS DOUBLE)) AS c{i}_{j}"
             for i in range(n) for j in range(i + 1, n)]
    items = []
    for i, a in enumerate(_NUMERIC):
        for j, b in enumerate(_NUMERIC):
            if i == j:
                r = f"v{i} / nullif(v{i}, 0)"
            else:
                lo, hi = min(i, j), max(i, j)
                r = f"c{lo}_{hi} / nullif(sqrt(v{lo} * v{hi}), 0)"
            items.append(f"{{'col_a': '{a}', 'col_b': '{b}', 'r': {r}}}")
    return (O.with_ctes("panel") + f"SELECT s.col_a, s.col_b, s.r FROM (SELECT unnest([{', '.join(items)}]) AS s "
            f"FROM (SELECT {', '.join(aggs)} FROM panel))")


@register("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf):
    return EDA.correlation_long(panel(spark, sf), _NUMERIC)


@register("describe_demand", O.with_ctes("panel") + """
SELECT CAST(count(demand) AS BIGINT) AS count, avg(CAST(demand AS DOUBLE)) AS mean,
  stddev_samp(CAST(demand AS DOUBLE)) AS std, min(CAST(demand AS DOUBLE)) AS min,
  quantile_cont(CAST(demand AS DOUBLE), 0.25) AS p25, median(CAST(demand AS DOUBLE)) AS p50,
  quantile_cont(CAST(demand AS DOUBLE), 0.75) AS p75, max(CAST(demand AS DOUBLE)) AS max
FROM panel""")
def q_describe_demand(spark, sf):
    return EDA.describe(panel(spark, sf), "demand")


def _hist_sql(src_cte: str, col: str, bins: int = 50) -> str:
    return O.with_ctes(src_cte)[:-1] + f""",
xs AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src_cte} WHERE {col} IS NOT NULL),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM xs),
edges AS (SELECT list_transform(range(0, {bins + 1}), lambda i: CASE WHEN i = {bins} THEN hi
          ELSE lo + CAST(i AS DOUBLE) * ((hi - lo) / {O.d(bins)}) END) AS e FROM rng),
counts AS (SELECT len(list_filter(e[2:{bins}], lambda t: t <= x)) AS bin, count(*) AS n FROM xs, edges GROUP BY 1),
all_bins AS (SELECT CAST(b AS INTEGER) AS bin, e[b + 1] AS bin_lo, e[b + 2] AS bin_hi FROM edges, range(0, {bins}) r(b))
SELECT a.bin, a.bin_lo, a.bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM all_bins a LEFT JOIN counts c USING (bin)"""


@register("demand_histogram", _hist_sql("panel", "demand"))
def q_demand_histogram(spark, sf):
    return EDA.histogram(panel(spark, sf), "demand", 50)


@register("residual_histogram", _hist_sql("pred_test", "error"))
def q_residual_histogram(spark, sf):
    return EDA.histogram(test_predictions(spark, sf), "error", 50)


@register("demand_kde", O.with_ctes("panel") + f"""
, stats AS (SELECT count(demand) AS n, stddev_samp(CAST(demand AS DOUBLE)) AS sd,
    min(CAST(demand AS DOUBLE)) AS lo, max(CAST(demand AS DOUBLE)) AS hi FROM panel),
vals AS (SELECT CAST(demand AS DOUBLE) AS v, count(*) AS w FROM panel WHERE demand IS NOT NULL GROUP BY 1),
pts AS (SELECT g, lo + CAST(g AS DOUBLE) * ((hi - lo) / {O.d(199)}) AS x, v, w, n,
           sd * pow(CAST(n AS DOUBLE), {O.d(-0.2)}) AS bw
        FROM vals, stats, range(0, 200) r(g))
SELECT CAST(g AS INTEGER) AS g, x,
  sum(CAST(w AS DOUBLE) * exp({O.d(-0.5)} * ((x - v) / bw) * ((x - v) / bw))) * {O.d(1 / math.sqrt(2 * math.pi))}
    / (CAST(n AS DOUBLE) * bw) AS density
FROM pts GROUP BY g, x, n, bw""".replace("\n, stats", ", stats", 1))
def q_demand_kde(spark, sf):
    return EDA.kde_curve(panel(spark, sf), "demand", 200)


@register("residual_density", O.with_ctes("pred_test")[:-1] + f""",
stats AS (SELECT count(error) AS n, stddev_samp(error) * pow(CAST(count(error) AS DOUBLE), {O.d(-0.2)}) AS bw,
    min(error) AS lo, max(error) AS hi, (max(error) - min(error)) / {O.d(199)} AS step FROM pred_test),
placed AS (SELECT (error - lo) / step AS place, least(CAST(floor((error - lo) / step) AS INTEGER), 198) AS b
    FROM pred_test, stats WHERE hi > lo),
weights AS (SELECT b, 1 - (place - b) AS w FROM placed UNION ALL SELECT b + 1, place - b FROM placed)
SELECT CAST(g AS INTEGER) AS g, lo + g * step AS x,
  sum(w * exp({O.d(-0.5)} * ((g - b) * step / bw) * ((g - b) * step / bw))) * {O.d(1 / math.sqrt(2 * math.pi))}
    / (n * bw) AS density
FROM weights, stats, range(0, 200) r(g) GROUP BY g, lo, step, n, bw""")
def q_residual_density(spark, sf):
    """Density of the test residuals over their histogram."""
    return EDA.binned_density(test_predictions(spark, sf), "error", 200)


# ---- K1-K5 dashboard ------------------------------------------------------
_FLOAT_SQL = SC.FLOAT_MEDIAN
_INT_SQL = SC.INT_MEDIAN


_ZONE_HOURS = "SELECT pickup_zone, CAST(hour AS INTEGER) AS hour FROM (SELECT DISTINCT pickup_zone FROM mf), range(0, 24) t(hour)"


def _ctx_sql(requests: str = _ZONE_HOURS) -> str:
    cols = _INT_SQL + _FLOAT_SQL

    def meds(prefix):
        return ", ".join(f"median(CAST({c} AS DOUBLE)) AS {prefix}{c}" for c in cols)

    def pick(c):
        return (f"(CASE WHEN zh.pickup_zone IS NOT NULL THEN zh.zh_{c} WHEN z.pickup_zone IS NOT NULL THEN z.z_{c} "
                f"WHEN h.hour IS NOT NULL THEN h.h_{c} ELSE a.a_{c} END)")

    dow = f"coalesce(CAST(trunc({pick('day_of_week')}) AS INTEGER), 0)"
    two_pi = repr(2 * math.pi)
    feats = {
        "hour": "CAST(r.hour AS INTEGER)",
        "day_of_week": dow,
        "month": f"coalesce(CAST(trunc({pick('month')}) AS INTEGER), 0)",
        "week_of_year": f"coalesce(CAST(trunc({pick('week_of_year')}) AS INTEGER), 0)",
        "is_weekend": f"coalesce(CAST(trunc({pick('is_weekend')}) AS INTEGER), 0)",
        "is_peak_hour": f"CAST(r.hour IN ({O.PEAK}) AS INTEGER)",
        "hour_sin": f"sin({two_pi} * r.hour / {O.d(24)})",
        "hour_cos": f"cos({two_pi} * r.hour / {O.d(24)})",
        "dow_sin": f"sin({two_pi} * {dow} / {O.d(7)})",
        "dow_cos": f"cos({two_pi} * {dow} / {O.d(7)})",
    }
    for c in _FLOAT_SQL:
        feats[c] = f"coalesce(CASE WHEN NOT isnan({pick(c)}) THEN {pick(c)} END, {O.d(0.0)})"
    level = ("CASE WHEN zh.pickup_zone IS NOT NULL THEN 'zone_hour' WHEN z.pickup_zone IS NOT NULL THEN 'zone' "
             "WHEN h.hour IS NOT NULL THEN 'hour' ELSE 'all' END")
    return O.with_ctes("mf")[:-1] + f""",
req AS ({requests}),
zh AS (SELECT pickup_zone, hour, {meds('zh_')} FROM mf GROUP BY pickup_zone, hour),
z AS (SELECT pickup_zone, {meds('z_')} FROM mf GROUP BY pickup_zone),
h AS (SELECT hour, {meds('h_')} FROM mf GROUP BY hour),
a AS (SELECT {meds('a_')} FROM mf),
ctx AS (
  SELECT r.pickup_zone, {level} AS context_level, {", ".join(f"{feats[c]} AS {c}" for c in ALL_FEATURES)}
  FROM req r LEFT JOIN zh ON zh.pickup_zone = r.pickup_zone AND zh.hour = r.hour
  LEFT JOIN z ON z.pickup_zone = r.pickup_zone LEFT JOIN h ON h.hour = r.hour CROSS JOIN a)
"""


def _context(spark, sf):
    mf = model_rows(spark, sf)
    return SC.context_rows(mf, SC.zone_hour_requests(mf))


@register("context_rows", _ctx_sql() + "SELECT * FROM ctx")
def q_context_rows(spark, sf):
    return _context(spark, sf)


_UNSEEN = "unseen zone"


@register("context_levels", _ctx_sql(f"""SELECT pickup_zone, CAST(hour AS INTEGER) AS hour
  FROM (SELECT DISTINCT pickup_zone FROM mf UNION ALL SELECT '{_UNSEEN}'), range(0, 25) t(hour)""") + "SELECT * FROM ctx")
def q_context_levels(spark, sf):
    """Context rows of requests that reach every fallback level.

    Known zones and an unseen one, each with the hours of the day and one that no row has: zone and hour, zone
    alone, hour alone and all rows.
    """
    mf = model_rows(spark, sf)
    zones = mf.select("pickup_zone").distinct().unionByName(spark.range(1).select(F.lit(_UNSEEN).alias("pickup_zone")))
    return SC.context_rows(mf, zones.select("pickup_zone", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("hour")))


_KPI_CFG = PriceConfig()


_KPI_PRICES = f"""
SELECT pickup_zone, hour, predicted_demand, reference_price, optimal_price, uplift_percent
FROM ({O.price_best_sql(O.price_points_sql('fc', 'predicted_demand', 'reference_price', _KPI_CFG,
                                           peak='is_peak_hour', weekend='is_weekend', volume='zone_trip_volume',
                                           keys='pickup_zone, hour, predicted_demand, reference_price'),
                        ['pickup_zone', 'hour'], _KPI_CFG)})"""
_KPI_SQL = (_ctx_sql() + f""",
base AS (SELECT median(CAST(demand AS DOUBLE)) AS rule_base FROM mf),
fc AS (SELECT ctx.*, {O.rule_forecast_sql('base.rule_base')} AS predicted_demand, {O.d(_KPI_CFG.mid_price)} AS reference_price
       FROM ctx CROSS JOIN base)""").replace("\n,\nbase AS", ",\nbase AS", 1) + _KPI_PRICES


@register("dashboard_kpis", _KPI_SQL)
def q_dashboard_kpis(spark, sf):
    """Predicted demand, reference, optimal price and uplift for every (zone, hour) scenario (K4).

    The context row carries only model features, so the reference price is
    the mid price, as on the dashboard.
    """
    mf = model_rows(spark, sf)
    ctx = _context(spark, sf)
    fc = rule_forecast(ctx, mf)
    priced = PR.optimize_prices(fc, "predicted_demand", _KPI_CFG)
    return priced.select("pickup_zone", "hour", "predicted_demand", "reference_price", "optimal_price", "uplift_percent")


# the fitted model of the scenario: demand on lag_1 and rolling_mean_24, least squares over the training part
_KPI_MODEL = {"two_features": (["lag_1", "rolling_mean_24"], 0.0)}
_KPI_FITTED_SQL = _ctx_sql().rstrip() + f""",
parts AS (SELECT *, dense_rank() OVER (ORDER BY pickup_date) - 1 AS date_idx FROM mf),
train AS (SELECT CAST(lag_1 AS DOUBLE) AS x1, rolling_mean_24 AS x2, CAST(demand AS DOUBLE) AS y
          FROM parts WHERE date_idx < (SELECT floor(count(DISTINCT pickup_date) * {O.d(TRAIN_RATIO)}) FROM mf)),
sums AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2,
           covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM train),
slopes AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM sums),
fc AS (SELECT ctx.*, my - b1 * m1 - b2 * m2 + b1 * lag_1 + b2 * rolling_mean_24 AS predicted_demand,
         {O.d(_KPI_CFG.mid_price)} AS reference_price
       FROM ctx CROSS JOIN slopes)""" + _KPI_PRICES


@register("dashboard_kpis_fitted", _KPI_FITTED_SQL)
def q_dashboard_kpis_fitted(spark, sf):
    """The dashboard's scenarios priced on the demand of a fitted model (K4, G17), not of the rule forecaster."""
    mf = model_rows(spark, sf)
    fit = GR.fit_linear(mf.where(bounds(spark, sf).in_part("train")), _KPI_MODEL)["two_features"]
    fc = _context(spark, sf).withColumn("predicted_demand", fit.column())
    priced = PR.optimize_prices(fc, "predicted_demand", _KPI_CFG)
    return priced.select("pickup_zone", "hour", "predicted_demand", "reference_price", "optimal_price", "uplift_percent")


@register("dashboard_kpi_cards", _KPI_SQL.replace(
    "SELECT pickup_zone, hour, predicted_demand, reference_price, optimal_price, uplift_percent\nFROM (",
    "SELECT pickup_zone, hour, format('{:,.2f}', predicted_demand) AS predicted_demand_text, "
    "format('{:,.2f}', reference_price) AS reference_price_text, format('{:,.2f}', optimal_price) AS optimal_price_text, "
    "format('{:,.2f}', uplift_percent) || '%' AS uplift_text\nFROM (", 1))
def q_dashboard_kpi_cards(spark, sf):
    """KPI card texts for every (zone, hour) scenario (K4, C20)."""
    from zonecast.functions.text import number_text

    k = q_dashboard_kpis(spark, sf)
    return k.select("pickup_zone", "hour", number_text(F.col("predicted_demand")).alias("predicted_demand_text"),
                    number_text(F.col("reference_price")).alias("reference_price_text"),
                    number_text(F.col("optimal_price")).alias("optimal_price_text"),
                    F.concat(number_text(F.col("uplift_percent")), F.lit("%")).alias("uplift_text"))


@register("zone_list", O.with_ctes("mf") + "SELECT DISTINCT pickup_zone FROM mf")
def q_zone_list(spark, sf):
    return SC.zone_list(model_rows(spark, sf))


_HIST_COLS = ["pickup_date", "hour", "day_of_week", "pickup_zone", "demand", "avg_fare_amount",
              "avg_trip_distance", "avg_duration_min", "avg_speed_kph"]


@register("zone_history", O.with_ctes("mf") + "SELECT " + ", ".join(
    "strftime(pickup_date, '%Y-%m-%d') AS pickup_date" if c == "pickup_date" else c for c in _HIST_COLS) + """
FROM mf QUALIFY row_number() OVER (PARTITION BY pickup_zone ORDER BY hour, pickup_date) <= 10""")
def q_zone_history(spark, sf):
    return present(SC.zone_history(model_rows(spark, sf), 10).select(*_HIST_COLS))


@register("zone_hour_drilldown", O.with_ctes("mf") + "SELECT " + ", ".join(
    "strftime(pickup_date, '%Y-%m-%d') AS pickup_date" if c == "pickup_date" else c for c in _HIST_COLS) + """
FROM mf JOIN (SELECT pickup_zone, hour FROM mf GROUP BY pickup_zone, hour ORDER BY sum(demand) DESC, pickup_zone, hour LIMIT 1)
USING (pickup_zone, hour)""")
def q_zone_hour_drilldown(spark, sf):
    """Every day of the busiest zone at its busiest hour (B9): both are literals that reach the scan."""
    mf = model_rows(spark, sf)
    busiest = mf.groupBy("pickup_zone", "hour").agg(F.sum("demand").alias("n")).orderBy(F.desc("n"), "pickup_zone", "hour").first()
    chosen = C.select_zone_hour(mf, busiest.pickup_zone, busiest.hour) if busiest else mf
    return present(chosen.select(*_HIST_COLS))


# ---- S1, S2 streaming -----------------------------------------------------
def _events_glob(sf: str) -> str:
    return f"{sf.rstrip('/')}/events.parque[t]"


_STREAM_COLS = ["pickup_date", "hour", "day_of_week", "month", "week_of_year", "is_weekend", "is_peak_hour",
                "is_month_start", "is_month_end", "is_high_travel_period", "hour_sin", "hour_cos", "dow_sin",
                "dow_cos", "pickup_zone", "pickup_lat_bin", "pickup_lon_bin", "demand", "avg_trip_distance",
                "avg_duration_min", "avg_passenger_count", "avg_fare_amount", "avg_total_amount", "avg_tip_amount",
                "avg_tolls_amount", "avg_speed_kph", "vendor_diversity", "payment_mode"]


@register("streaming_panel", O.with_ctes("panel") + "SELECT " + ", ".join(
    "strftime(pickup_date, '%Y-%m-%d') AS pickup_date" if c == "pickup_date" else c for c in _STREAM_COLS) + " FROM panel")
def q_streaming_panel(spark, sf):
    from zonecast.streaming.panel_stream import streamed_panel

    return present(streamed_panel(spark, _events_glob(sf)))


_FINISHED_SQL = """
finished AS (
  SELECT * EXCLUDE zone_trip_volume, CAST(count(*) OVER (PARTITION BY pickup_zone ORDER BY pickup_date, hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS zone_trip_volume
  FROM panel
  WHERE CAST(pickup_date AS TIMESTAMP) + to_hours(hour + 1) <= (SELECT max(tpep_pickup_datetime) FROM clean) - INTERVAL 2 HOUR
),
finished_scored AS (
  SELECT *, """ + O.rule_forecast_sql("(SELECT median(CAST(demand AS DOUBLE)) FROM panel)") + """ AS predicted_demand FROM finished
)
"""


def _finished_prices_sql() -> str:
    from zonecast.plans.catalog_pricing import _priced_sql
    from zonecast.streaming.finished_hours import PRICE_COLUMNS

    return O.with_ctes("panel")[:-1] + "," + _FINISHED_SQL + (
        "SELECT strftime(pickup_date, '%Y-%m-%d') AS pickup_date, hour, pickup_zone, demand, zone_trip_volume, predicted_demand, "
        + ", ".join(PRICE_COLUMNS) + f" FROM ({_priced_sql('finished_scored', extra_keys=', zone_trip_volume')})")


@register("streaming_prices", _finished_prices_sql())
def q_streaming_prices(spark, sf):
    """Every finished hour priced once; hours that the watermark hasn't passed are left open."""
    from zonecast.streaming.finished_hours import finished_prices, run_finished_hours

    base = panel(spark, sf).agg(F.median(F.col("demand").cast("double"))).first()[0]
    return present(finished_prices(spark, run_finished_hours(spark, _events_glob(sf), float(base or 0.0))))


# ---- A10 EDA summary report lines -------------------------------------------
_STAT_LINES = [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "p25"),
               ("50%", "p50"), ("75%", "p75"), ("max", "max")]


def _eda_summary_sql() -> str:
    n_cols = len(PANEL_COLUMNS)
    stat_rows = ",\n".join(f"({6 + i}, printf('{label.replace('%', '%%')} %.6f', CAST(s.{col} AS DOUBLE)))"
                           for i, (label, col) in enumerate(_STAT_LINES))
    return O.with_ctes("panel")[:-1] + f""",
s AS (SELECT count(demand) AS count, avg(CAST(demand AS DOUBLE)) AS mean, stddev_samp(CAST(demand AS DOUBLE)) AS std,
        min(CAST(demand AS DOUBLE)) AS min, quantile_cont(CAST(demand AS DOUBLE), 0.25) AS p25,
        median(CAST(demand AS DOUBLE)) AS p50, quantile_cont(CAST(demand AS DOUBLE), 0.75) AS p75,
        max(CAST(demand AS DOUBLE)) AS max FROM panel),
tz AS (SELECT pickup_zone, sum(demand) AS demand FROM panel GROUP BY pickup_zone
       ORDER BY demand DESC, pickup_zone LIMIT 5),
tzn AS (SELECT row_number() OVER (ORDER BY demand DESC, pickup_zone) + 15 AS line_no,
        printf('%s  %d', pickup_zone, demand) AS value FROM tz)
SELECT CAST(line_no AS INTEGER) AS line_no, value FROM (
  SELECT * FROM (VALUES (0, 'EDA SUMMARY'), (1, '{"=" * 50}'), (3, 'Columns: {n_cols}'), (4, ''),
                        (5, 'Demand Statistics:'), (14, ''), (15, 'Top 5 Zones by Total Demand:')) t(line_no, value)
  UNION ALL SELECT 2, printf('Rows: %d', (SELECT count(*) FROM panel))
  UNION ALL SELECT * FROM (SELECT t.line_no, t.value FROM s, (VALUES {stat_rows}) t(line_no, value))
  UNION ALL SELECT line_no, value FROM tzn)"""


@register("eda_summary", _eda_summary_sql())
def q_eda_summary(spark, sf):
    from zonecast.plans.eda_run import eda_summary_lines

    return eda_summary_lines(panel(spark, sf)).select(F.col("line_no").cast("int").alias("line_no"), "value")
