"""Demand panel over a trip stream (S1) and pricing of updated hours.

Shape: file stream of events -> trip adapter -> cleaning -> watermark (2 h)
-> ``groupBy(window(pickup, 1 hour), zone)`` in update mode. State per
(hour, zone) is dropped once the watermark passes, so it stays bounded.
Rows behind the watermark are dropped from the micro-batch after the one
that moved it (Spark applies the previous batch's watermark to late input).
Exact distinct count is not allowed on streams; the vendor count is the size
of ``collect_set`` (vendor ids are a handful per group).

Every micro-batch is written by ``foreachBatch`` to ``<out>/panel/batch_id=N``
(overwrite of that one partition, so a retried batch is idempotent). The
current panel is the latest version of every key, reduced with ``max_by``
(a partial aggregation, no single-task step). S2 prices the same updated
rows in the same callback into ``<out>/prices/batch_id=N``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.config import PriceConfig
from zonecast.functions import calendar as cal
from zonecast.functions.spatial import round_half_even, zone_key
from zonecast.operators.clean import clean_trips
from zonecast.operators.forecast import rule_forecast_column
from zonecast.operators.pricing import optimize_prices
from zonecast.sources.sinks import shared_dir
from zonecast.sources.trips import events_as_trips

PANEL_STREAM_COLUMNS = [
    "pickup_date", "hour", "day_of_week", "month", "week_of_year", "is_weekend", "is_peak_hour",
    "is_month_start", "is_month_end", "is_high_travel_period", "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "pickup_zone", "pickup_lat_bin", "pickup_lon_bin", "demand", "avg_trip_distance", "avg_duration_min",
    "avg_passenger_count", "avg_fare_amount", "avg_total_amount", "avg_tip_amount", "avg_tolls_amount",
    "avg_speed_kph", "vendor_diversity", "payment_mode",
]
KEYS = ["pickup_date", "hour", "pickup_zone"]


def panel_from_trip_stream(trips: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Streaming (hour, zone) aggregate of clean trips."""
    # wall-clock pickup time -> the instant with the same UTC wall clock, so hourly
    # windows match wall-clock hours in any session time zone
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    t = clean_trips(trips).withColumn(
        "_event_time", F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col("tpep_pickup_datetime"))))
    lat_bin = round_half_even(F.col("pickup_latitude"))
    lon_bin = round_half_even(F.col("pickup_longitude"))
    agg = (t.withWatermark("_event_time", watermark)
           .groupBy(F.window("_event_time", "1 hour").alias("w"), zone_key(lat_bin, lon_bin).alias("pickup_zone"))
           .agg(F.count(F.lit(1)).alias("demand"),
                F.avg("trip_distance").alias("avg_trip_distance"),
                F.avg("trip_duration_min").alias("avg_duration_min"),
                F.avg("passenger_count").alias("avg_passenger_count"),
                F.avg("fare_amount").alias("avg_fare_amount"),
                F.avg("total_amount").alias("avg_total_amount"),
                F.avg("tip_amount").alias("avg_tip_amount"),
                F.avg("tolls_amount").alias("avg_tolls_amount"),
                F.avg("speed_kph").alias("avg_speed_kph"),
                F.size(F.collect_set("VendorID")).cast("bigint").alias("vendor_diversity"),
                F.avg("payment_type").alias("payment_mode"),
                F.min(lat_bin).alias("pickup_lat_bin"),
                F.min(lon_bin).alias("pickup_lon_bin")))
    start = F.timestamp_add("MICROSECOND", F.unix_micros(F.col("w.start")), epoch)
    out = agg.withColumns({"pickup_date": F.to_date(start), "hour": F.hour(start)})
    return out.withColumns(cal.calendar_columns("pickup_date", "hour")).select(*PANEL_STREAM_COLUMNS)


def price_updates(rows: DataFrame, rule_base: float, cfg: PriceConfig = PriceConfig()) -> DataFrame:
    """Forecast (rule forecast with a fitted base) and price updated panel rows."""
    fc = rows.withColumn("predicted_demand", rule_forecast_column(
        F.lit(float(rule_base)), F.col("hour"), F.col("is_weekend"), F.lit(None).cast("double")))
    return optimize_prices(fc, "predicted_demand", cfg).select(
        *KEYS, "demand", "predicted_demand", "reference_price", "optimal_price", "expected_demand",
        "expected_revenue", "static_price", "static_revenue", "uplift_percent")


def run_panel_stream(spark: SparkSession, events_glob: str, out_dir: str | None = None,
                     rule_base: float | None = None, watermark: str = "2 hours",
                     max_files_per_trigger: int | None = None) -> str:
    """Run S1 (and S2 when ``rule_base`` is given) to completion with ``availableNow``; returns out_dir.

    All files that are there when it starts are one micro-batch, so their order
    can't make any of their rows late: lateness is judged between runs, against
    what earlier runs have seen. ``max_files_per_trigger`` bounds a batch for a
    source whose files arrive in event-time order.

    ``out_dir`` and the streaming checkpoint live under the session's shared
    ``spark.checkpoint.dir`` unless given.
    """
    out_dir = out_dir or shared_dir(spark, "zonecast-stream", uuid.uuid4().hex)
    schema = spark.read.parquet(events_glob).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(events_glob)
    panel = panel_from_trip_stream(events_as_trips(events), watermark)

    def on_batch(df: DataFrame, batch_id: int) -> None:
        # two sinks read the same micro-batch: persist it once, release after
        df.persist()
        try:
            df.write.mode("overwrite").parquet(f"{out_dir}/panel/batch_id={batch_id}")
            if rule_base is not None:
                price_updates(df, rule_base).write.mode("overwrite").parquet(f"{out_dir}/prices/batch_id={batch_id}")
        finally:
            df.unpersist()

    q = (panel.writeStream.outputMode("update").foreachBatch(on_batch)
         .option("checkpointLocation", f"{out_dir}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir


def latest_versions(spark: SparkSession, path: str, keys=KEYS) -> DataFrame:
    """Latest row per key across micro-batch outputs (``max_by`` on batch id)."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("_v"))
            .select(*keys, "_v.*"))


def streamed_panel(spark: SparkSession, events_glob: str, **kw) -> DataFrame:
    out = run_panel_stream(spark, events_glob, **kw)
    return latest_versions(spark, f"{out}/panel").select(*PANEL_STREAM_COLUMNS)
