"""Pricing of finished hours (S2): every (hour, zone) is priced once, when it can no longer change.

The panel stream runs in append mode, so a window comes out in the micro-batch whose watermark
passes its end, and never again; hours that are still open don't come out. A later batch only
closes later hours, so counting a zone's finished hours in order gives the running zone volume.
That count is state: a table of one row per zone (bounded by the zones of the bounding box),
written as ``<out>/volumes/batch_id=N`` by batch N from batch N - 1's. Rows priced in a batch are
``<out>/prices/batch_id=N``. Both are overwritten by a retry of the batch, which reads the same
inputs, so an hour is neither lost nor priced twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast.config import PriceConfig
from zonecast.operators.forecast import rule_forecast_column
from zonecast.operators.pricing import optimize_prices
from zonecast.sources.sinks import shared_dir
from zonecast.sources.trips import events_as_trips
from zonecast.streaming.panel_stream import KEYS, panel_from_trip_stream

PRICE_COLUMNS = ["reference_price", "optimal_price", "expected_demand", "expected_revenue", "static_price",
                 "static_revenue", "uplift_percent"]
VOLUMES = "pickup_zone string, finished_hours long"


def with_running_volume(finished: DataFrame, before: DataFrame) -> DataFrame:
    """``finished`` rows plus ``zone_trip_volume``: the zone's finished hours up to and including the row's."""
    order = Window.partitionBy("pickup_zone").orderBy("pickup_date", "hour")
    place = F.row_number().over(order) + F.coalesce(F.col("finished_hours"), F.lit(0))
    return finished.join(before, "pickup_zone", "left").withColumn("zone_trip_volume", place.cast("bigint")).drop("finished_hours")


def volumes_after(finished: DataFrame, before: DataFrame) -> DataFrame:
    """The zones' counts of finished hours with those of ``finished`` added."""
    new = finished.groupBy("pickup_zone").agg(F.count(F.lit(1)).alias("finished_hours"))
    return before.unionByName(new).groupBy("pickup_zone").agg(F.sum("finished_hours").alias("finished_hours"))


def price_finished(rows: DataFrame, rule_base: float, cfg: PriceConfig = PriceConfig()) -> DataFrame:
    """Forecast finished rows by the rule, zone volume included, and search their prices."""
    forecast = rule_forecast_column(F.lit(float(rule_base)), F.col("hour"), F.col("is_weekend"), F.col("zone_trip_volume"))
    priced = optimize_prices(rows.withColumn("predicted_demand", forecast), "predicted_demand", cfg)
    return priced.select(*KEYS, "demand", "zone_trip_volume", "predicted_demand", *PRICE_COLUMNS)


def run_finished_hours(spark: SparkSession, events_glob: str, rule_base: float, out_dir: str | None = None,
                       watermark: str = "2 hours", max_files_per_trigger: int | None = None,
                       cfg: PriceConfig = PriceConfig()) -> str:
    """Price the hours that the trips available now have finished; returns out_dir.

    A second run on the same ``out_dir`` goes on where the first one stopped: it reads new files
    only and prices the hours that these finish. ``rule_base`` is the fitted median demand.
    """
    out_dir = out_dir or shared_dir(spark, "zonecast-finished", uuid.uuid4().hex)
    reader = spark.readStream.schema(spark.read.parquet(events_glob).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    finished = panel_from_trip_stream(events_as_trips(reader.parquet(events_glob)), watermark)

    def on_batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        df.persist()
        try:
            before = (session.read.schema(VOLUMES).parquet(f"{out_dir}/volumes/batch_id={batch_id - 1}") if batch_id
                      else session.createDataFrame([], VOLUMES))
            price_finished(with_running_volume(df, before), rule_base, cfg).write.mode("overwrite").parquet(f"{out_dir}/prices/batch_id={batch_id}")
            volumes_after(df, before).write.mode("overwrite").parquet(f"{out_dir}/volumes/batch_id={batch_id}")
        finally:
            df.unpersist()

    query = (finished.writeStream.outputMode("append").foreachBatch(on_batch)
             .option("checkpointLocation", f"{out_dir}/_checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return out_dir


def finished_prices(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every hour priced so far, once."""
    return spark.read.parquet(f"{out_dir}/prices").drop("batch_id")
