"""Command line: preprocess -> train -> price, writing every sink under --out.

python -m zonecast.plans.run --sf /root/testdata/sf0.01 --out <shared dir> [--models linear_regression,...]
The default output folder is under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import uuid

from zonecast.operators.models import CANDIDATES
from zonecast.session import local_session
from zonecast.sources.sinks import shared_dir
from zonecast.sources.trips import raw_trips


def main(argv=None) -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--out", default=None)
    ap.add_argument("--models", default=",".join(CANDIDATES), help="candidates to compare (default: all)")
    ap.add_argument("--sample", type=int, default=0, help="price a seeded sample of n test rows (0 = all)")
    a = ap.parse_args(argv)
    from zonecast.plans.preprocess import load_and_preprocess
    from zonecast.plans.pricing_run import run_pricing
    from zonecast.plans.train import train_models

    spark = local_session()
    out = a.out or shared_dir(spark, "zonecast-run", uuid.uuid4().hex)
    _, panel, summary = load_and_preprocess(spark, raw_trips(spark, a.sf), f"{out}/data")
    from zonecast.plans.eda_run import write_diagnostic_tables, write_eda_tables

    write_eda_tables(spark, panel, f"{out}/eda")
    trained = train_models(spark, panel, f"{out}/artifacts", a.models.split(","))
    write_diagnostic_tables(spark, spark.read.parquet(f"{out}/artifacts/model_selection_summary"),
                            spark.read.parquet(f"{out}/artifacts/predictions/test"),
                            spark.read.parquet(f"{out}/artifacts/feature_importance"), f"{out}/diagnostics")
    run_pricing(spark, panel, f"{out}/final", trained["model"], sample_size=a.sample or None,
                model_name=trained["best_model"], model_summary=spark.read.json(f"{out}/artifacts/model_metrics"),
                cv_summary=spark.read.parquet(f"{out}/artifacts/cross_validation_summary"))
    print(out)


if __name__ == "__main__":
    main()
