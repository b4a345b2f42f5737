"""Time splits, walk-forward folds, sampling.

Split boundaries come from the distinct dates, a table bounded by the
calendar (one row per day). It is numbered with a window over that small
table and joined back by broadcast, so the plan stays lazy and no date list
passes through the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecast.config import CV_SPLITS, TRAIN_RATIO, VAL_RATIO


@dataclass(frozen=True)
class DateBounds:
    """The time split and the folds as date literals: what a store partitioned by date prunes on.

    ``val_start`` and ``test_start`` are the first dates of their parts (None without any dates).
    """

    dates: tuple[dt.date, ...]
    val_start: dt.date | None
    test_start: dt.date | None

    @classmethod
    def of(cls, dates: list, train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO) -> DateBounds:
        """Bounds from distinct dates: 70/15/15 by count, truncated like ``int()`` (F1)."""
        d = tuple(sorted(dates))
        at = lambda i: d[i] if i < len(d) else None
        return cls(d, at(int(len(d) * float(train_ratio))), at(int(len(d) * float(train_ratio + val_ratio))))

    def label(self, date_col: str = "pickup_date") -> Column:
        """'train' | 'val' | 'test' of a row, by its date alone (F1)."""
        if not self.dates:
            return F.lit(None).cast("string")
        d = F.col(date_col)
        return F.when(d >= F.lit(self.test_start), "test").when(d >= F.lit(self.val_start), "val").otherwise("train")

    def in_part(self, part: str, date_col: str = "pickup_date") -> Column:
        """The condition of one part: a date range."""
        starts = {"train": (None, self.val_start), "val": (self.val_start, self.test_start), "test": (self.test_start, None)}
        low, high = starts[part]
        d = F.col(date_col)
        out = d.isNotNull() if self.dates else F.lit(False)
        out = out if low is None else out & (d >= F.lit(low))
        return out if high is None else out & (d < F.lit(high))

    def part_dates(self, part: str) -> list:
        """The dates of one part."""
        label = lambda x: "test" if x >= self.test_start else "val" if x >= self.val_start else "train"
        return [x for x in self.dates if label(x) == part]

    def folds(self, n_splits: int = CV_SPLITS) -> list[tuple[int, dt.date, dt.date | None]]:
        """(fold, first validation date, first date after it or None) over the train part's dates (F2)."""
        return self.folds_of(self.part_dates("train"), n_splits)

    @staticmethod
    def folds_of(d: list, n_splits: int = CV_SPLITS) -> list[tuple[int, dt.date, dt.date | None]]:
        """The same over any sorted dates."""
        size = len(d) // (n_splits + 1)
        starts = [(fold, len(d) - (n_splits - fold + 1) * size) for fold in range(1, n_splits + 1)] if size else []
        return [(fold, d[i], d[i + size] if i + size < len(d) else None) for fold, i in starts]


def numbered_dates(df: DataFrame, date_col: str = "pickup_date") -> DataFrame:
    """Distinct non-null dates with 0-based rank ``date_idx`` and total ``n_dates``.

    Bounded by the number of calendar days; the un-partitioned window runs
    on that tiny table only.
    """
    d = df.select(F.col(date_col).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    w_all = Window.partitionBy()
    return d.select(
        F.col("_d").alias(date_col),
        (F.row_number().over(Window.orderBy("_d")) - 1).alias("date_idx"),
        F.count(F.lit(1)).over(w_all).alias("n_dates"),
    )


def split_labels(df: DataFrame, date_col: str = "pickup_date",
                 train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO) -> DataFrame:
    """Date -> 'train' | 'val' | 'test' by 70/15/15 of distinct dates, truncating like ``int()`` (F1)."""
    dates = numbered_dates(df, date_col)
    n = F.col("n_dates").cast("double")
    train_end = F.floor(n * F.lit(float(train_ratio)))
    val_end = F.floor(n * F.lit(float(train_ratio + val_ratio)))
    i = F.col("date_idx")
    return dates.select(
        date_col,
        F.when(i < train_end, "train").when(i < val_end, "val").otherwise("test").alias("split"),
    )


def time_split(df: DataFrame, date_col: str = "pickup_date") -> DataFrame:
    """``df`` plus a ``split`` column; filter on it to get the three parts (F1)."""
    return df.join(F.broadcast(split_labels(df, date_col)), on=date_col, how="inner")


def split_part(df: DataFrame, part: str, date_col: str = "pickup_date") -> DataFrame:
    return time_split(df, date_col).where(F.col("split") == part).drop("split")


def fold_dates(df: DataFrame, n_splits: int = CV_SPLITS, date_col: str = "pickup_date") -> DataFrame:
    """Walk-forward folds over distinct dates: (date, fold, role) (F2).

    Validation blocks have ``n // (n_splits + 1)`` dates and end at the last
    date; training is every earlier date (expanding window).
    """
    dates = numbered_dates(df, date_col)
    folds = F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold")
    size = F.floor(F.col("n_dates") / F.lit(n_splits + 1))
    start = F.col("n_dates") - (F.lit(n_splits) - F.col("fold") + F.lit(1)) * F.col("_size")
    return (dates.select(date_col, "date_idx", "n_dates", folds)
            .withColumn("_size", size)
            .withColumn("_start", start)
            .withColumn("role", F.when(F.col("date_idx") < F.col("_start"), "train")
                        .when(F.col("date_idx") < F.col("_start") + F.col("_size"), "val"))
            .where(F.col("role").isNotNull())
            .select(date_col, "fold", "role"))


def fold_frame(df: DataFrame, n_splits: int = CV_SPLITS, date_col: str = "pickup_date") -> DataFrame:
    """Rows tagged with (fold, role); a row appears once per fold it belongs to."""
    return df.join(F.broadcast(fold_dates(df, n_splits, date_col)), on=date_col, how="inner")


def fold_summary(df: DataFrame, n_splits: int = CV_SPLITS, date_col: str = "pickup_date") -> DataFrame:
    """Rows and date range per (fold, role)."""
    return fold_frame(df, n_splits, date_col).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(date_col).alias("dates"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
    )


def sample_key(seed: int, cols: list[str]) -> Column:
    """Deterministic per-row sort key: md5 of the seed and the row key."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_sample(df: DataFrame, n: int, seed: int = 42,
                  key_cols: tuple[str, ...] = ("pickup_zone", "pickup_date", "hour")) -> DataFrame:
    """``n`` rows chosen by a seeded hash order.

    The choice does not depend on partitioning; the plan is a
    TakeOrderedAndProject (per-partition top-n, then a merge of n rows each).
    """
    k = sample_key(seed, list(key_cols))
    return df.withColumn("_sample_key", k).orderBy("_sample_key", *key_cols).limit(int(n)).drop("_sample_key")


def representative_row(df: DataFrame, col: str = "demand",
                       tie_cols: tuple[str, ...] = ("pickup_zone", "pickup_date", "hour")) -> DataFrame:
    """The row whose ``col`` is closest to the median, first by key on ties."""
    med = df.agg(F.median(col)).scalar()
    return (df.withColumn("_dist", F.abs(F.col(col) - med))
            .orderBy("_dist", *tie_cols).limit(1).drop("_dist"))


def in_dates(df: DataFrame, dates: DataFrame, date_col: str = "pickup_date") -> DataFrame:
    """Membership filter by a date table (F5): a left-semi join, broadcast or not by the size that Spark measures."""
    return df.join(dates.select(date_col).distinct(), on=date_col, how="left_semi")
