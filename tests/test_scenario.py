"""K1 context rows: every fallback level against pandas medians."""

import numpy as np
import pandas as pd

from zonecast.config import ALL_FEATURES
from zonecast.operators.scenario import FLOAT_MEDIAN, context_rows


def prepared(spark):
    rng = np.random.default_rng(9)
    n = 200
    pdf = pd.DataFrame({
        "pickup_zone": rng.choice(["a", "b"], n), "hour": rng.choice([1, 2, 3], n).astype("int32"),
        "day_of_week": rng.integers(0, 7, n), "month": 1, "week_of_year": rng.integers(1, 5, n),
        "is_weekend": rng.integers(0, 2, n)})
    for c in FLOAT_MEDIAN:
        pdf[c] = rng.normal(10, 3, n)
    pdf.loc[:20, "lag_24"] = np.nan
    pdf = pdf[~((pdf.pickup_zone == "b") & (pdf.hour == 3))]
    return pdf, spark.createDataFrame(pdf)


def test_fallback_levels(spark):
    pdf, df = prepared(spark)
    req = spark.createDataFrame([("a", 1), ("b", 3), ("zz", 2), ("zz", 9)], "pickup_zone string, hour int")
    got = {(r["pickup_zone"], r["hour"]): r for r in context_rows(df, req).collect()}
    cases = {("a", 1): ("zone_hour", pdf[(pdf.pickup_zone == "a") & (pdf.hour == 1)]),
             ("b", 3): ("zone", pdf[pdf.pickup_zone == "b"]),
             ("zz", 2): ("hour", pdf[pdf.hour == 2]),
             ("zz", 9): ("all", pdf)}
    for key, (level, sub) in cases.items():
        r = got[key]
        assert r["context_level"] == level
        for c in FLOAT_MEDIAN:
            assert np.isclose(r[c], sub[c].median()), (key, c)
        assert r["day_of_week"] == int(sub["day_of_week"].median())
        assert np.isclose(r["dow_sin"], np.sin(2 * np.pi * int(sub["day_of_week"].median()) / 7))
        assert r["is_peak_hour"] == int(key[1] in (7, 8, 9, 16, 17, 18, 19))
    assert list(context_rows(df, req).columns) == ["pickup_zone", "context_level"] + ALL_FEATURES


def test_empty_table_gives_empty_features(spark):
    pdf, df = prepared(spark)
    req = spark.createDataFrame([("a", 1)], "pickup_zone string, hour int")
    r = context_rows(df.limit(0), req).collect()
    assert len(r) == 1 and r[0]["context_level"] == "all" and r[0]["lag_24"] == 0.0 and r[0]["day_of_week"] == 0
