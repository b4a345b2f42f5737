"""Price search as row-local Column expressions.

Every row carries its own grid as ``sequence(0, n-1)``; the per-row
constants are bound once (``_let``), the grid is an array of scores and the
best point is the first position of its maximum, so the search is a
projection: no shuffle, no explode, no Python. The grid size is bounded by
``PriceConfig.max_grid_size``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonecast.config import PriceConfig


def _lit(x) -> Column:
    return F.lit(float(x))


def reference_price(df_columns, cfg: PriceConfig = PriceConfig(),
                    candidates=("avg_fare_amount", "avg_total_amount", "fare_amount", "total_amount")) -> Column:
    """First positive, non-null value among the candidate columns present; else the mid price."""
    present = [c for c in candidates if c in df_columns]
    # NaN compares as larger than any number, so it is excluded by name
    picks = [F.when((F.col(c).cast("double") > 0) & ~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in present]
    return F.coalesce(*picks, _lit(cfg.mid_price)) if picks else _lit(cfg.mid_price)


def price_band(ref: Column, cfg: PriceConfig = PriceConfig()) -> tuple[Column, Column]:
    """Search band around the reference price; an empty band falls back to [min, max]."""
    r = F.when(ref > 0, ref).otherwise(_lit(cfg.mid_price))
    lower0 = F.greatest(_lit(cfg.min_price), r * _lit(cfg.min_discount_multiplier))
    upper0 = F.least(_lit(cfg.max_price), r * _lit(cfg.max_markup_multiplier))
    collapsed = upper0 <= lower0
    lower = F.when(collapsed, _lit(cfg.min_price)).otherwise(lower0)
    upper = F.when(collapsed, _lit(cfg.max_price)).otherwise(upper0)
    return lower, upper


def context_elasticity(base_demand: Column, cfg: PriceConfig = PriceConfig(), *,
                       elasticity: Column | None = None, peak: Column | None = None,
                       weekend: Column | None = None, volume: Column | None = None) -> Column:
    """Elasticity after the context rules, floored.

    Factors multiply in rule order (peak, weekend, zone volume, demand); a
    missing or NULL context column leaves its factor at 1.
    """
    e = elasticity if elasticity is not None else _lit(cfg.elasticity)
    one = _lit(1.0)
    if peak is not None:
        e = e * F.when(peak.cast("int") == 1, _lit(cfg.peak_factor)).otherwise(one)
    if weekend is not None:
        e = e * F.when(weekend.cast("int") == 1, _lit(cfg.weekend_factor)).otherwise(one)
    if volume is not None:
        v = volume.cast("double")
        e = e * (F.when(v > cfg.high_volume_threshold, _lit(cfg.high_volume_factor))
                 .when(v < cfg.low_volume_threshold, _lit(cfg.low_volume_factor))
                 .otherwise(one))
    e = e * (F.when(base_demand >= cfg.high_demand_threshold, _lit(cfg.high_demand_factor))
             .when(base_demand <= cfg.low_demand_threshold, _lit(cfg.low_demand_factor))
             .otherwise(one))
    return F.greatest(e, _lit(cfg.min_elasticity))


def adjusted_demand(base_demand: Column, ref: Column, price: Column, e: Column,
                    cfg: PriceConfig = PriceConfig()) -> Column:
    """``max(d * exp(-e * pct), floor * d)``; a non-positive reference counts as 1 (I4)."""
    r = F.when(ref > 0, ref).otherwise(_lit(1.0))
    pct = (price - r) / r
    return F.greatest(base_demand * F.exp(-e * pct), _lit(cfg.floor_demand_ratio) * base_demand)


def objective(base_demand: Column, ref: Column, price: Column, adj: Column,
              cfg: PriceConfig = PriceConfig()) -> Column:
    """Revenue minus a quadratic price-move penalty."""
    pct = F.when(ref <= 0, _lit(0.0)).otherwise((price - ref) / ref)
    penalty = _lit(cfg.price_change_penalty) * base_demand * ref * (pct * pct)
    return price * adj - penalty


def grid_size(lower: Column, upper: Column, cfg: PriceConfig = PriceConfig()) -> Column:
    """Number of grid points of ``arange(lower, upper + step, step)``."""
    step = _lit(cfg.price_step)
    return F.ceil(((upper + step) - lower) / step).cast("int")


def _let(values: dict[str, Column], body) -> Column:
    """Evaluate ``values`` once per row and hand them to ``body`` as one struct lambda variable.

    A one-element ``transform`` binds the struct, so expressions the body
    uses repeatedly, or inside a per-grid-point lambda, are read from the
    lambda variable instead of re-evaluating their expression trees.
    """
    bound = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.element_at(F.transform(F.array(bound), body), 1)


def _row_constants(base_demand: Column, ref: Column, cfg: PriceConfig, **ctx) -> dict[str, Column]:
    """Per-row search constants: demand, reference, band, grid step and size, context elasticity."""
    lower, upper = price_band(ref, cfg)
    return {
        "d": base_demand, "ref": ref, "lo": lower, "up": upper,
        "dl": (lower + _lit(cfg.price_step)) - lower,
        "n": grid_size(lower, upper, cfg),
        "e": context_elasticity(base_demand, cfg, **ctx),
    }


def _grid_price(k: Column, i: Column) -> Column:
    return k["lo"] + i.cast("double") * k["dl"]


def grid_points(base_demand: Column, ref: Column, cfg: PriceConfig = PriceConfig(), *,
                elasticity: Column | None = None, peak: Column | None = None,
                weekend: Column | None = None, volume: Column | None = None) -> Column:
    """``array<struct<score, neg_index, price, adjusted_demand, revenue>>`` over the grid.

    Grid values are ``lower + i * delta`` with ``delta = (lower + step) - lower``,
    the same arithmetic as an arange fill; the grid overshoots ``upper`` by up
    to one step unless ``cfg.clamp``.
    """
    consts = _row_constants(base_demand, ref, cfg, elasticity=elasticity, peak=peak, weekend=weekend, volume=volume)

    def points(k: Column) -> Column:
        def point(i: Column) -> Column:
            price = _grid_price(k, i)
            adj = adjusted_demand(k["d"], k["ref"], price, k["e"], cfg)
            return F.struct(
                objective(k["d"], k["ref"], price, adj, cfg).alias("score"),
                (-i).alias("neg_index"),
                price.alias("price"),
                adj.alias("adjusted_demand"),
                (price * adj).alias("revenue"),
            )

        pts = F.transform(F.sequence(F.lit(0), k["n"] - 1), point)
        if cfg.clamp:
            pts = F.filter(pts, lambda p: p["price"] <= k["up"])
        return pts

    return _let(consts, points)


def price_search(base_demand: Column, ref: Column, cfg: PriceConfig = PriceConfig(), *,
                 elasticity: Column | None = None, peak: Column | None = None,
                 weekend: Column | None = None, volume: Column | None = None) -> Column:
    """Best grid price as a struct of the six result fields.

    Per row: the constants are bound once, the grid becomes an array of
    scores only, and the best index is the first position of the maximum
    (``array_position(s, array_max(s))``), so equal scores keep the lowest
    price, as a strict ``>`` scan would. Price, demand and revenue are then
    computed once, at that index.
    """
    consts = _row_constants(base_demand, ref, cfg, elasticity=elasticity, peak=peak, weekend=weekend, volume=volume)

    def search(k: Column) -> Column:
        def score(i: Column) -> Column:
            price = _grid_price(k, i)
            s = objective(k["d"], k["ref"], price, adjusted_demand(k["d"], k["ref"], price, k["e"], cfg), cfg)
            return F.when(price <= k["up"], s) if cfg.clamp else s

        scores = F.transform(F.sequence(F.lit(0), k["n"] - 1), score)
        return _let({"s": scores}, lambda m: result(k, m["s"]))

    def result(k: Column, s: Column) -> Column:
        price = _grid_price(k, F.coalesce(F.array_position(s, F.array_max(s)), F.lit(1)) - 1)
        return _let({"p": price, "a": adjusted_demand(k["d"], k["ref"], price, k["e"], cfg)},
                    lambda b: fields(k, b["p"], b["a"]))

    def fields(k: Column, price: Column, adj: Column) -> Column:
        revenue = price * adj
        static_revenue = k["ref"] * adjusted_demand(k["d"], k["ref"], k["ref"], k["e"], cfg)
        uplift = F.when(static_revenue > 0,
                        (revenue - static_revenue) / static_revenue * _lit(100.0)).otherwise(_lit(0.0))
        return F.struct(
            price.alias("optimal_price"),
            adj.alias("expected_demand"),
            revenue.alias("expected_revenue"),
            k["ref"].alias("static_price"),
            static_revenue.alias("static_revenue"),
            uplift.alias("uplift_percent"),
        )

    return _let(consts, search)


PRICING_FIELDS = ["optimal_price", "expected_demand", "expected_revenue",
                  "static_price", "static_revenue", "uplift_percent"]
