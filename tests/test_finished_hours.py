"""Each finished hour is priced once, with its zone's running volume; open hours are not."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from zonecast.operators.clean import clean_trips
from zonecast.operators.panel import aggregate_panel
from zonecast.sources.sinks import shared_dir
from zonecast.sources.trips import events_as_trips
from zonecast.streaming.finished_hours import finished_prices, price_finished, run_finished_hours

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DAY = dt.datetime(2024, 1, 2)


def ev(i, minutes, user=3):
    return (i, DAY + dt.timedelta(minutes=minutes), user, "view", 10.0, "")


def put(spark, base, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{name}")


def ids():
    return (i for i in range(1, 10**6) if i % 7 and i % 89 and i % 97)  # not the adapter's dirty rows


def test_open_hours_wait_and_no_hour_is_priced_twice(spark):
    base, n = shared_dir(spark, "zonecast-test", uuid.uuid4().hex), ids()
    put(spark, base, "part0", [ev(next(n), m) for m in (605, 610, 670, 750, 760)])  # 10:05 .. 12:40, watermark 10:40
    out = run_finished_hours(spark, f"{base}/in/part*/*.parquet", 5.0, f"{base}/out")
    assert finished_prices(spark, out).count() == 0  # 10:00-11:00 ends after the watermark
    put(spark, base, "part1", [ev(next(n), m) for m in (620, 800, 795)])  # 13:20: watermark 11:20; 10:20 isn't late yet when read
    run_finished_hours(spark, f"{base}/in/part*/*.parquet", 5.0, out)
    first = {r["hour"]: r for r in finished_prices(spark, out).collect()}
    assert set(first) == {10}
    put(spark, base, "part2", [ev(next(n), m) for m in (615, 1200)])  # 10:15 is late; 20:00 closes 11, 12 and 13
    run_finished_hours(spark, f"{base}/in/part*/*.parquet", 5.0, out)
    rows = finished_prices(spark, out).collect()
    got = {r["hour"]: (r["demand"], r["zone_trip_volume"]) for r in rows}
    assert len(rows) == 4 and got[11] == (1, 2) and got[12] == (2, 3) and got[13] == (2, 4)
    assert got[10] == (first[10]["demand"], 1) and first[10]["optimal_price"] == next(r for r in rows if r["hour"] == 10)["optimal_price"]


def test_many_small_batches_equal_the_whole(spark):
    """In event-time order, one file a batch: the union is the batch panel's finished hours, priced with running counts."""
    base, n = shared_dir(spark, "zonecast-test", uuid.uuid4().hex), ids()
    rng = random.Random(5)
    rows = [ev(next(n), m, user=rng.randrange(12)) for m in sorted(rng.randrange(0, 3000) for _ in range(500))]
    for k in range(5):
        put(spark, base, f"part{k}", rows[k * 100 : (k + 1) * 100])
    out = run_finished_hours(spark, f"{base}/in/part*/*.parquet", 4.0, f"{base}/out", max_files_per_trigger=1)
    got = finished_prices(spark, out)
    clean = clean_trips(events_as_trips(spark.createDataFrame(rows, SCHEMA)))
    last = max(r["tpep_pickup_datetime"] for r in clean.select("tpep_pickup_datetime").collect()) - dt.timedelta(hours=2)
    panel = aggregate_panel(clean).where((F.timestamp_add("HOUR", F.col("hour") + 1, F.col("pickup_date").cast("timestamp_ntz"))) <= F.lit(last))
    panel = panel.withColumn("zone_trip_volume", F.expr("count(*) OVER (PARTITION BY pickup_zone ORDER BY pickup_date, hour ROWS UNBOUNDED PRECEDING)"))
    want = price_finished(panel, 4.0)
    key = lambda df: sorted((str(r["pickup_date"]), r["hour"], r["pickup_zone"], r["demand"], r["zone_trip_volume"], round(r["optimal_price"], 9),
                             round(r["uplift_percent"], 9)) for r in df.collect())
    assert key(got) == key(want) and got.count() > 100


def test_a_retried_batch_changes_nothing(spark):
    base, n = shared_dir(spark, "zonecast-test", uuid.uuid4().hex), ids()
    put(spark, base, "part0", [ev(next(n), m) for m in (5, 65, 400)])
    out = run_finished_hours(spark, f"{base}/in/part*/*.parquet", 5.0, f"{base}/out")
    before = sorted(map(tuple, finished_prices(spark, out).collect()))
    run_finished_hours(spark, f"{base}/in/part*/*.parquet", 5.0, out)  # nothing new
    assert sorted(map(tuple, finished_prices(spark, out).collect())) == before and len(before) == 2
