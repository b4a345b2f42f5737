"""Binned density against the exact kernel sum."""

import numpy as np
import pandas as pd

from zonecast.operators.eda import binned_density, kde_curve


def test_near_the_exact_density(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(6, 0.5, 1000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).unionByName(
        spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    got = binned_density(df, "x", 200).orderBy("g").toPandas()
    want = kde_curve(df.where("x is not null and not isnan(x)"), "x", 200).orderBy("g").toPandas()
    assert len(got) == 200 and np.allclose(got.x, want.x)
    assert np.abs(got.density - want.density).max() < 0.01 * want.density.max()
    width = got.x[1] - got.x[0]
    assert abs(got.density.sum() * width - 1) < 0.02


def test_without_spread_no_density(spark):
    one = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert binned_density(one, "x").count() == 0 and binned_density(one.limit(0), "x").count() == 0


def test_no_row_is_multiplied_by_the_grid(spark):
    plan = binned_density(spark.range(10).selectExpr("id * 0.5 as x"), "x")._jdf.queryExecution().optimizedPlan().toString()
    # the grid is generated over the aggregated weights: above the aggregate, so before it in the plan's text
    assert plan.index("sequence") < plan.index("Aggregate [b") if "sequence" in plan else plan.index("Generate") < plan.rindex("Aggregate")
