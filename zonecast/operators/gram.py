"""Linear and ridge fits of every walk-forward fold from one pass over the rows.

A least-squares fit needs the rows only through their count, means and centred cross products,
and these add up. One pass reduces the rows to such moments per date; tasks merge their own first,
so the shuffle is tasks x dates small rows, whatever the number of rows. Every expanding fold is
a prefix of the dates: the moments between fold bounds are merged by Spark, at most
2 x folds + 1 of them reach the driver, and a fold's fit is the merge of its prefix and a small solve.

Moments are centred (merged by the pairwise update of means and cross products), not raw sums:
a date ordinal near 735,000 would lose all digits of its variance in a plain X'X.

Rows with a null or NaN in any used column take no part, as in training. A constant feature
gets the coefficient 0; of collinear features the smallest standardised solution is taken; a fold
without rows has no fit; an empty frame has no folds.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.config import ALL_FEATURES, CV_SPLITS, TARGET
from zonecast.operators.splits import DateBounds

_FIELDS = "n long, mean array<double>, co array<double>"


@dataclass(frozen=True)
class Moments:
    """Count, means and centred cross products of some columns over some rows."""

    n: int
    mean: np.ndarray
    co: np.ndarray  # [column, column] sums of products of deviations

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        z = x - mean
        return cls(len(x), mean, z.T @ z)

    def merged(self, other: Moments) -> Moments:
        """The moments of both sets of rows."""
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.co + other.co + np.outer(gap, gap) * (self.n * other.n / n))


def date_moments(df: DataFrame, columns: list[str], date_col: str = "pickup_date") -> DataFrame:
    """(date, n, mean, co) of the columns over the rows of each date."""
    x = [F.col(c).cast("double").alias(c) for c in columns]
    used = df.select(F.col(date_col).alias("date"), *x).dropna()  # NaN counts as missing here
    k = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            days, at = np.unique(batch.column("date").cast(pa.int32()).to_numpy(), return_inverse=True)
            rows = np.column_stack([batch.column(c).to_numpy() for c in columns])
            for i, day in enumerate(days.tolist()):
                own = Moments.of(rows[at == i])
                held[day] = held[day].merged(own) if day in held else own
        if held:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(held), pa.int32()).cast(pa.date32()), pa.array([m.n for m in held.values()], pa.int64()),
                pa.array([m.mean.tolist() for m in held.values()], pa.list_(pa.float64())),
                pa.array([m.co.ravel().tolist() for m in held.values()], pa.list_(pa.float64()))], ["date", "n", "mean", "co"])

    return _merged(used.mapInArrow(partial, f"date date, {_FIELDS}"), "date", "date date", k)


def _merged(moments: DataFrame, key: str, key_type: str, k: int) -> DataFrame:
    """Moments merged by a key, in the order of their dates and counts."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        out = None
        for r in part.sort_values([c for c in ("date", "n") if c in part]).itertuples():
            own = Moments(int(r.n), np.asarray(r.mean), np.asarray(r.co).reshape(k, k))
            out = own if out is None else out.merged(own)
        return pd.DataFrame({key: [part[key].iloc[0]], "n": [out.n], "mean": [out.mean.tolist()], "co": [out.co.ravel().tolist()]})

    return moments.groupBy(key).applyInPandas(merge, f"{key_type}, {_FIELDS}")


def solve(m: Moments, alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of the last column on the others; ``alpha`` penalises coefficients, not the intercept."""
    xx, xy = m.co[:-1, :-1], m.co[:-1, -1]
    scale = np.sqrt(np.diagonal(xx))
    varies = scale > 1e-12 * np.maximum(1.0, np.abs(m.mean[:-1])) * np.sqrt(m.n)
    b = np.zeros(len(xy))
    if varies.any():
        s = scale[varies]
        a = xx[np.ix_(varies, varies)] / np.outer(s, s) + np.diag(alpha / (s * s))
        b[varies] = np.linalg.lstsq(a, xy[varies] / s, rcond=1e-12)[0] / s
    return float(m.mean[-1] - b @ m.mean[:-1]), b


@dataclass(frozen=True)
class LinearFit:
    """A fitted linear model, scored as a plain sum of columns."""

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.features, self.coefficients):
            out = out + F.col(c).cast("double") * F.lit(b)
        return out


# fixed values: the linear candidates and their ridge penalties
ALPHAS = {"linear_regression": 0.0, "ridge_regression": 1.0}


def fold_fits(df: DataFrame, models: dict[str, tuple[list[str], float]], n_splits: int = CV_SPLITS,
              label: str = TARGET, date_col: str = "pickup_date") -> tuple[list[tuple[int, dt.date, dt.date | None]], dict[tuple[int, str], LinearFit]]:
    """The folds over the dates of ``df``, and the fit of every (fold, model); rows are read once for all.

    ``models`` maps a name to its features and ridge penalty.
    """
    columns = sorted({c for features, _ in models.values() for c in features}) + [label]
    by_date = date_moments(df, columns, date_col).persist()
    try:
        dates = [r[0] for r in by_date.select("date").collect()]  # one row per calendar day
        folds = DateBounds.folds_of(sorted(dates), n_splits)
        starts = sorted({start for _, start, _ in folds})
        segment = sum((F.when(F.col("date") >= F.lit(s), 1).otherwise(0) for s in starts), F.lit(0))
        merged = _merged(by_date.withColumn("segment", segment), "segment", "segment int", len(columns)).collect() if folds else []
    finally:
        by_date.unpersist()
    segments = {r.segment: Moments(r.n, np.array(r.mean), np.array(r.co).reshape(len(columns), -1)) for r in merged}
    fits, prefix = {}, None
    for i, start in enumerate(starts):
        if i in segments:
            prefix = segments[i] if prefix is None else prefix.merged(segments[i])
        for fold in [f for f, s, _ in folds if s == start]:
            for name, (features, alpha) in models.items():
                if prefix is not None:
                    at = [columns.index(c) for c in features] + [len(columns) - 1]
                    intercept, b = solve(Moments(prefix.n, prefix.mean[at], prefix.co[np.ix_(at, at)]), alpha)
                    fits[fold, name] = LinearFit(tuple(features), intercept, tuple(b.tolist()))
    return folds, fits


def fit_linear(df: DataFrame, models: dict[str, tuple[list[str], float]], label: str = TARGET, date_col: str = "pickup_date") -> dict[str, LinearFit]:
    """The fits of all models on all rows of ``df``, from one pass."""
    columns = sorted({c for features, _ in models.values() for c in features}) + [label]
    k = len(columns)
    whole = _merged(date_moments(df, columns, date_col).withColumn("whole", F.lit(0)), "whole", "whole int", k).collect()
    fits = {}
    for r in whole:
        m = Moments(r.n, np.array(r.mean), np.array(r.co).reshape(k, k))
        for name, (features, alpha) in models.items():
            at = [columns.index(c) for c in features] + [k - 1]
            intercept, b = solve(Moments(m.n, m.mean[at], m.co[np.ix_(at, at)]), alpha)
            fits[name] = LinearFit(tuple(features), intercept, tuple(b.tolist()))
    return fits


def predictions(df: DataFrame, fits: dict[str, LinearFit], keep: list[str], label: str = TARGET) -> DataFrame:
    """(kept columns, model_name, actual_demand, predicted_demand): all models scored in one pass."""
    said = [F.struct(F.lit(n).alias("model_name"), f.column().alias("predicted_demand")) for n, f in fits.items()]
    rows = df.select(*keep, F.col(label).cast("double").alias("actual_demand"), F.explode(F.array(*said)).alias("p"))
    return rows.select(*keep, "p.model_name", "actual_demand", "p.predicted_demand")


def fold_predictions(df: DataFrame, models: dict[str, tuple[list[str], float]], n_splits: int = CV_SPLITS,
                     label: str = TARGET, date_col: str = "pickup_date") -> DataFrame:
    """(model_name, fold, role, actual_demand, predicted_demand): all folds scored in one more pass, row by row."""
    folds, fits = fold_fits(df, models, n_splits, label, date_col)
    d, said = F.col(date_col), []
    for fold, start, end in folds:
        role = F.when(d < F.lit(start), "train")
        role = role.otherwise(F.lit("val")) if end is None else role.when(d < F.lit(end), "val")
        said += [F.struct(F.lit(name).alias("model_name"), F.lit(fold).alias("fold"), role.alias("role"), fits[fold, name].column().alias("predicted_demand"))
                 for name in models if (fold, name) in fits]
    none = F.array().cast("array<struct<model_name:string,fold:int,role:string,predicted_demand:double>>")
    rows = df.select(F.col(label).cast("double").alias("actual_demand"), F.explode(F.array(*said) if said else none).alias("p"))
    return rows.where("p.role IS NOT NULL").select("p.model_name", "p.fold", "p.role", "actual_demand", "p.predicted_demand")


def coefficient_rows(spark, fits: dict[tuple[int, str], LinearFit]) -> DataFrame:
    """(fold, model_name, feature, coefficient), the intercept as a feature of that name; folds x models x features rows."""
    rows = [(fold, name, f, c) for (fold, name), fit in sorted(fits.items())
            for f, c in [("intercept", fit.intercept), *zip(fit.features, fit.coefficients)]]
    return spark.createDataFrame(rows, "fold int, model_name string, feature string, coefficient double")


def linear_candidates(names: list[str], features: list[str] = ALL_FEATURES) -> dict[str, tuple[list[str], float]]:
    """The linear ones of some candidate names, as ``models`` of the functions above."""
    return {n: (features, ALPHAS[n]) for n in names if n in ALPHAS}
