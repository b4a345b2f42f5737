"""String and formatting helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_suffix_title(c: Column, suffix: str) -> Column:
    """Drop a literal suffix and title-case the rest: ``train_mae`` -> ``Train``."""
    return F.initcap(F.regexp_replace(c, F.lit(_regex_escape(suffix) + "$"), F.lit("")))


def _regex_escape(s: str) -> str:
    import re

    return re.escape(s)


def normalise_flag(c: Column) -> Column:
    """NULL -> 'N', upper case, strip surrounding whitespace (B1)."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit("N"))), r"^\s+|\s+$", "")


def price_explanation(price: Column, demand: Column, revenue: Column, uplift: Column) -> Column:
    """One-line explanation of a price choice."""
    return F.format_string(
        "Optimal price = %.2f, expected demand = %.2f, expected revenue = %.2f, "
        "uplift over static pricing = %.2f%%",
        price,
        demand,
        revenue,
        uplift,
    )


def number_text(c: Column, decimals: int = 2) -> Column:
    """Thousands-separated number text (C20)."""
    return F.format_number(c, decimals)
