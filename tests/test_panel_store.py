"""The date-partitioned store: pruned reads, the split and folds as literals, no stale answers."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from zonecast.operators import splits as S
from zonecast.plans import catalog as C
from zonecast.sources import panel_store as PS
from zonecast.sources.sinks import shared_dir
from tests.conftest import SF_SMOKE


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_part_prunes_dates_and_columns(spark):
    for rows in (C.split_rows(spark, SF_SMOKE).where(F.col("split") == "test"),
                 C.model_rows(spark, SF_SMOKE).where(C.bounds(spark, SF_SMOKE).in_part("test"))):
        two = rows.select("pickup_zone", "demand")
        plan = plan_text(two)
        filters = re.search(r"PartitionFilters: \[(.*?)\], ", plan).group(1)
        assert "pickup_date" in filters
        assert "ReadSchema: struct<pickup_zone:string,demand:bigint>" in plan
        assert "Join" not in plan and "Exchange" not in plan and "ExistingRDD" not in plan
        # only the part's folders are read
        dates = {r[0] for r in rows.select("pickup_date").distinct().collect()}
        read = {re.search(r"pickup_date=([^/]+)/", f).group(1) for f in two.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
        assert read == {str(d) for d in dates} and 0 < len(dates) < len(C.bounds(spark, SF_SMOKE).dates)


def test_labels_parts_and_folds_equal_the_joined_ones(spark):
    rows, b = C.model_rows(spark, SF_SMOKE), C.bounds(spark, SF_SMOKE)
    keys = ["pickup_zone", "pickup_date", "hour"]
    joined = {tuple(r) for r in S.time_split(rows).select(*keys, "split").collect()}
    assert {tuple(r) for r in rows.withColumn("split", b.label()).select(*keys, "split").collect()} == joined
    for part in ("train", "val", "test"):
        assert {(*r, part) for r in rows.where(b.in_part(part)).select(*keys).collect()} == {r for r in joined if r[3] == part}
    train = rows.where(b.in_part("train"))
    want = {(r.fold, r.role, r.pickup_date) for r in S.fold_dates(train).collect()}
    got = {(fold, "train" if d < start else "val", d) for fold, start, end in b.folds() for d in b.part_dates("train") if end is None or d < end}
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 20])
def test_bounds_of_few_dates(n):
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)]
    b = S.DateBounds.of(dates[::-1])
    parts = [b.part_dates(p) for p in ("train", "val", "test")]
    assert sum(parts, []) == dates
    assert [len(p) for p in parts] == [int(n * 0.7), int(n * 0.85) - int(n * 0.7), n - int(n * 0.85)]


def test_a_changed_file_is_another_store(spark):
    base = shared_dir(spark, "zonecast-test", uuid.uuid4().hex)
    events = spark.read.parquet(f"{SF_SMOKE}/events.parquet")
    events.write.parquet(f"{base}/events.parquet")
    before = C.panel(spark, base).agg(F.sum("demand")).first()[0]
    assert C.panel(spark, base).agg(F.sum("demand")).first()[0] == before
    events.where("event_id % 2 = 0").write.mode("append").parquet(f"{base}/events.parquet")
    assert C.panel(spark, base).agg(F.sum("demand")).first()[0] > before


def test_store_keeps_schema_and_is_built_once(spark):
    path = f"{shared_dir(spark, 'zonecast-test', uuid.uuid4().hex)}/t"
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), "a"), (2, dt.date(2024, 1, 2), None)], "x int, pickup_date date, z string")
    built = []

    def build():
        built.append(1)
        return rows

    for _ in range(2):
        got = PS.stored_once(spark, path, build)
        assert got.schema.simpleString() == rows.schema.simpleString()
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert len(built) == 1
