"""Streaming panel: micro-batches, watermark drops late rows, latest version per key."""

import datetime as dt
import random
import uuid

from zonecast.operators.clean import clean_trips
from zonecast.sources.sinks import shared_dir
from zonecast.sources.trips import events_as_trips
from zonecast.streaming.panel_stream import latest_versions, run_panel_stream

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def ev(i, hh, mm, user=3):
    # ids avoid the adapter's dirty-row rules (multiples of 7, 89, 97)
    return (i, dt.datetime(2024, 1, 2, hh, mm), user, "view", 10.0, "")


def test_watermark_drops_late_rows(spark):
    base = shared_dir(spark, "zonecast-test", uuid.uuid4().hex)
    files = [
        [ev(1, 10, 5), ev(2, 11, 10), ev(3, 12, 30), ev(4, 12, 40)],  # watermark after: 10:40
        [ev(6, 13, 20), ev(8, 12, 50)],                               # watermark after: 11:20
        [ev(5, 7, 15), ev(9, 13, 40)],                                # 07:15 is behind 10:40: dropped
    ]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/part{k}")
    out = run_panel_stream(spark, f"{base}/in/part*/*.parquet", out_dir=f"{base}/out", rule_base=5.0, max_files_per_trigger=1)
    panel = latest_versions(spark, f"{out}/panel")
    got = {r["hour"]: r["demand"] for r in panel.collect()}
    assert got == {10: 1, 11: 1, 12: 3, 13: 2}  # hour 12 updated across batches: 2 then 3
    assert spark.read.parquet(f"{out}/panel").select("batch_id").distinct().count() >= 3
    prices = latest_versions(spark, f"{out}/prices")
    assert prices.count() == 4 and prices.where("optimal_price IS NULL").count() == 0


def test_stream_hours_independent_of_session_time_zone(spark):
    base = shared_dir(spark, "zonecast-test", uuid.uuid4().hex)
    spark.createDataFrame([ev(1, 10, 5), ev(2, 10, 50), ev(3, 11, 10)], SCHEMA).coalesce(1).write.parquet(f"{base}/in/p0")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # +05:30
        out = run_panel_stream(spark, f"{base}/in/p*/*.parquet", out_dir=f"{base}/out")
        got = {r["hour"]: r["demand"] for r in latest_versions(spark, f"{out}/panel").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == {10: 2, 11: 1}


def test_panel_does_not_depend_on_file_layout(spark):
    """1, 4 and 16 files in shuffled order give the same panel."""
    base = shared_dir(spark, "zonecast-test", uuid.uuid4().hex)
    rows = [ev(i, i % 24, i % 60, user=i % 12) for i in range(1, 400) if i % 7 and i % 89 and i % 97]
    random.Random(3).shuffle(rows)
    seen = []
    for n in (1, 4, 16):
        for k in range(n):
            spark.createDataFrame(rows[k::n], SCHEMA).coalesce(1).write.parquet(f"{base}/in{n}/part{k}")
        out = run_panel_stream(spark, f"{base}/in{n}/part*/*.parquet", out_dir=f"{base}/out{n}")
        seen.append(sorted((str(r["pickup_date"]), r["hour"], r["pickup_zone"], r["demand"]) for r in latest_versions(spark, f"{out}/panel").collect()))
    batch = clean_trips(events_as_trips(spark.createDataFrame(rows, SCHEMA))).count()
    assert sum(r[3] for r in seen[0]) == batch and seen[0] == seen[1] == seen[2]
