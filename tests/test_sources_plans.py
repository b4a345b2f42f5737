"""CSV source, optional reads, sinks and the end-to-end plans."""

import os
import uuid

from zonecast.sources.sinks import shared_dir
from zonecast.sources.trips import parse_raw_trips, read_optional, read_raw_trips_csv
from tests.conftest import SF_SMOKE

HEADER = ("VendorID,tpep_pickup_datetime,tpep_dropoff_datetime,passenger_count,trip_distance,pickup_longitude,"
          "pickup_latitude,RateCodeID,dropoff_longitude,dropoff_latitude,payment_type,fare_amount,extra,mta_tax,"
          "tip_amount,tolls_amount,improvement_surcharge,total_amount,store_and_fwd_flag")


def test_csv_reader_with_extra_and_dirty_columns(spark, tmp_path):
    p = tmp_path / "trips.csv"
    rows = [
        "2,2015-01-15 19:05:39,2015-01-15 19:23:42,1,1.59,-73.993896,40.750111,1,-73.974785,40.750618,1,12,1,0.5,3.25,0,0.3,17.05,N",
        "1,bad-time,2015-01-10 20:53:28,1,3.30,-74.001648,40.724243,1,-73.994415,40.759109,1,14.5,0.5,0.5,2,0,0.3,17.8,",
        "1,2015-01-10 20:33:38,2015-01-10 20:53:28,1,abc,-74.001648,40.724243,1,-73.994415,40.759109,1,14.5,0.5,0.5,2,0,0.3,17.8,Y",
    ]
    p.write_text(HEADER + "\n" + "\n".join(rows) + "\n")
    # columns are selected by header name; the extra RateCodeID column is skipped
    typed = parse_raw_trips(read_raw_trips_csv(spark, str(p)))
    got = typed.collect()
    assert got[0]["trip_distance"] == 1.59 and got[0]["_critical_present"]
    assert got[1]["tpep_pickup_datetime"] is None and not got[1]["_critical_present"]
    assert got[2]["trip_distance"] is None and got[2]["_critical_present"]


def test_csv_reader_fixed_schema(spark, tmp_path):
    from zonecast.config import RAW_COLUMNS

    p = tmp_path / "raw.csv"
    p.write_text(",".join(RAW_COLUMNS) + "\n" + "1,2015-01-01 00:00:00,2015-01-01 00:10:00,1,2,-73.99,40.75,-73.95,"
                 "40.72,1,9,0.5,0.5,1,0,0.3,11.3,N\n")
    df = parse_raw_trips(read_raw_trips_csv(spark, str(p)))
    r = df.first()
    assert r["fare_amount"] == 9.0 and r["store_and_fwd_flag"] == "N"


def test_read_optional_missing_is_none(spark, tmp_path):
    assert read_optional(spark, str(tmp_path / "nope")) is None
    assert read_optional(spark, f"{SF_SMOKE}/region.parquet") is not None


def test_end_to_end_plans(spark):
    from zonecast.plans.preprocess import load_and_preprocess
    from zonecast.plans.pricing_run import run_pricing
    from zonecast.plans.train import train_models
    from zonecast.sources.trips import raw_trips

    out = shared_dir(spark, "zonecast-test", uuid.uuid4().hex)
    trips, panel, summary = load_and_preprocess(spark, raw_trips(spark, SF_SMOKE), f"{out}/data")
    s = summary.first()
    assert s["raw_rows"] == 1000 and s["clean_rows"] == 808 and s["demand_panel_rows"] == 762
    trained = train_models(spark, panel, f"{out}/artifacts", ["linear_regression", "ridge_regression"])
    assert trained["best_model"] in ("linear_regression", "ridge_regression")
    res = run_pricing(spark, panel, f"{out}/final", trained["model"], model_name=trained["best_model"],
                      model_summary=spark.read.json(f"{out}/artifacts/model_metrics"),
                      cv_summary=spark.read.parquet(f"{out}/artifacts/cross_validation_summary"))
    report = spark.read.json(f"{out}/final/final_report").first()
    assert report.model_summary.best_model == trained["best_model"] and len(report.model_summary.selection_table) == 2
    assert report.model_summary.feature_importance_method == "native_importance_or_coefficients"
    assert spark.read.json(f"{out}/artifacts/feature_importance_meta").first().method == "native_importance_or_coefficients"
    lines = [r.value for r in spark.read.text(f"{out}/final/run_summary").collect()]
    assert lines[7:9] == ["", "Top CV models:"] and len(lines) == 11
    best = spark.read.parquet(f"{out}/artifacts/cross_validation_summary").orderBy("cv_val_mae_mean", "model_name").first()
    assert lines[9].startswith(f"{best.model_name}  val MAE {best.cv_val_mae_mean:.4f}")
    bare = run_pricing(spark, panel, f"{out}/bare")
    assert bare["summary"].count() == 1 and len(spark.read.text(f"{out}/bare/run_summary").collect()) == 7
    assert res["simulation"].count() > 0
    for sub in ("data/demand_panel", "artifacts/model", "artifacts/model_metrics", "final/final_report",
                "final/run_summary", "final/revenue_curve"):
        assert os.path.exists(f"{out}/{sub}".replace("file:", "")), sub
    from zonecast.sources.sinks import load_model
    assert load_model(f"{out}/artifacts/model") is not None


def test_eda_and_diagnostic_tables(spark):
    from zonecast.plans.catalog import panel, test_predictions
    from zonecast.plans.eda_run import eda_summary_lines, write_diagnostic_tables, write_eda_tables

    out = shared_dir(spark, "zonecast-test", uuid.uuid4().hex)
    p = panel(spark, SF_SMOKE)
    write_eda_tables(spark, p, f"{out}/eda")
    lines = [r["value"] for r in eda_summary_lines(p).orderBy("line_no").collect()]
    assert lines[0] == "EDA SUMMARY" and lines[2] == "Rows: 762" and len(lines) == 16 + 5
    sel = spark.createDataFrame([("m", 1.0, 2.0, 3.0, 1.5, 2.5, 3.5)],
                                "model_name string, train_mae double, val_mae double, test_mae double, "
                                "train_rmse double, val_rmse double, test_rmse double")
    write_diagnostic_tables(spark, sel, test_predictions(spark, SF_SMOKE), None, f"{out}/diag")
    assert spark.read.parquet(f"{out}/diag/model_comparison_mae").count() == 3
    assert spark.read.parquet(f"{out}/eda/correlation").count() == 29 * 29


def test_checkpoint_dir_rule_on_a_cluster_master():
    """A non-local session without spark.checkpoint.dir is an error, never a machine-local folder."""
    import pytest

    from zonecast.session import ensure_checkpoint_dir

    class Conf:
        def __init__(self, value):
            self.value, self.set_calls = value, []

        def get(self, key, default=None):
            return self.value if key == "spark.checkpoint.dir" else default

        def set(self, key, value):
            self.set_calls.append((key, value))

    class Ctx:
        def __init__(self, master, ckpt=None):
            self.master, self.ckpt = master, ckpt

        def getCheckpointDir(self):
            return self.ckpt

        def setCheckpointDir(self, d):
            self.ckpt = d

    class Session:
        def __init__(self, master, value):
            self.conf, self.sparkContext = Conf(value), Ctx(master)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session("yarn", None))
    shared = Session("yarn", "hdfs://shared/ckpt")
    assert ensure_checkpoint_dir(shared) == "hdfs://shared/ckpt"
    assert shared.conf.set_calls == [] and shared.sparkContext.ckpt == "hdfs://shared/ckpt"


def test_csv_pipeline_reads_back_what_it_wrote(spark):
    from zonecast.plans.preprocess import load_and_preprocess
    from zonecast.sources.trips import raw_trips

    base = shared_dir(spark, "zonecast-test", uuid.uuid4().hex)
    _, panel, summary = load_and_preprocess(spark, raw_trips(spark, SF_SMOKE), f"{base}/csv", fmt="csv")
    _, again, other = load_and_preprocess(spark, raw_trips(spark, SF_SMOKE), f"{base}/parquet")
    assert summary.first().asDict() == other.first().asDict()
    key = ["pickup_date", "hour", "pickup_zone", "demand", "avg_fare_amount", "vendor_diversity"]
    assert panel.select(key).exceptAll(again.select(key)).count() == 0 and panel.count() == again.count()
