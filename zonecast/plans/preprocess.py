"""Entry 1: raw trips -> clean trips + demand panel + cleaning summary (A1-A10, B, C, D1-D3).

One pass over the raw data: the cleaning counters are an ``Observation`` on
the raw frame, collected while the clean trips are written. The panel is
then built from the written, typed, ``pickup_date``-partitioned trips.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from zonecast.operators.clean import clean_trips, cleaning_stages
from zonecast.operators.panel import build_panel
from zonecast.sources.sinks import read_table, write_document, write_table


def load_and_preprocess(spark: SparkSession, raw: DataFrame, output_dir: str, fmt: str = "parquet"):
    """Write clean_trips, demand_panel and preprocess_summary under ``output_dir``; return (trips, panel, summary)."""
    obs = Observation("cleaning")
    st = cleaning_stages(raw)
    observed = raw.observe(obs, F.count(F.lit(1)).alias("raw_rows"),
                           F.count_if(st["after_dropna"]).alias("after_dropna"),
                           F.count_if(st["after_numeric_coercion"]).alias("after_numeric_coercion"),
                           F.count_if(st["clean_rows"]).alias("clean_rows"))
    clean = clean_trips(observed)
    write_table(clean, f"{output_dir}/clean_trips", ["pickup_date"], fmt)
    counters = dict(obs.get)
    counters["removed_rows"] = counters["raw_rows"] - counters["clean_rows"]
    trips = read_table(spark, f"{output_dir}/clean_trips", clean.schema, fmt)
    panel = build_panel(trips)
    write_table(panel, f"{output_dir}/demand_panel", ["pickup_date"], fmt)
    panel_rows = read_table(spark, f"{output_dir}/demand_panel", panel.schema, fmt).count()
    summary = spark.createDataFrame([{
        **{k: int(v) for k, v in counters.items()},
        "clean_trip_columns": trips.columns, "demand_panel_rows": int(panel_rows),
        "demand_panel_columns": panel.columns,
    }])
    write_document(summary, f"{output_dir}/preprocess_summary")
    return trips, panel, summary
