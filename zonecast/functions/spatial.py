"""Spatial bins and zone keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Round to ``digits`` decimals half-to-even on ``x * 10**digits``.

    ``F.round`` is HALF_UP and ``F.bround`` works on the decimal value; the
    source rounds the binary product, which ``rint`` reproduces.
    """
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def zone_key(lat_bin: Column, lon_bin: Column) -> Column:
    """``"<lat>_<lon>"`` with the shortest decimal text of each bin."""
    return F.concat_ws("_", lat_bin.cast("string"), lon_bin.cast("string"))
