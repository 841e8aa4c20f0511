"""Nightly report job, as submitted to a cluster.

    spark-submit --conf spark.checkpoint.dir=hdfs:///shared/checkpoints \\
        jobs/nightly_reports.py --data hdfs:///warehouse/retail \\
        --out hdfs:///reports/2001-08-01 --as-of 2001-08-01 \\
        --input-bytes 100000000000000 --cores 8000

``--data`` holds one Parquet folder per source table (``orders.parquet`` ...).
The master and executors come from spark-submit; shuffle and scan sizes from
``scale_conf``.  Checkpoints go to the cluster's ``spark.checkpoint.dir``
(required outside local mode).  Each report is written as Parquet below
``--out``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillwise.operators import catalog, ledger, quality, sales  # noqa: E402
from tillwise.session import build_session, scale_conf  # noqa: E402
from tillwise.sources import Tables  # noqa: E402


def reports(t: Tables, as_of: dt.date) -> dict:
    day = as_of - dt.timedelta(days=1)
    return {
        "revenue_by_category": sales.revenue_by_category(t),
        "daily_summary": sales.daily_summary(t, day),
        "monthly_sales": sales.monthly_sales(t, as_of),
        "product_sales_summary": sales.product_sales_summary(t),
        "clearance_candidates": sales.clearance_candidates(t, as_of),
        "expiry_alerts": catalog.expiry_alerts(t, as_of),
        "low_stock_alerts": ledger.low_stock_alerts(t, as_of),
        "data_quality": quality.data_quality(t, as_of),
    }


def main(argv: list[str] | None = None) -> dict[str, str]:
    ap = argparse.ArgumentParser()
    ap.add_argument("--data", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--as-of", required=True, type=dt.date.fromisoformat)
    ap.add_argument("--input-bytes", type=int, default=0)
    ap.add_argument("--cores", type=int, default=0)
    ap.add_argument("--only", default="")
    args = ap.parse_args(argv)
    extra = scale_conf(args.input_bytes, args.cores) if args.input_bytes and args.cores else {}
    spark = build_session(app_name="tillwise-nightly", extra=extra)
    t = Tables.from_dir(spark, args.data)
    wanted = set(filter(None, args.only.split(",")))
    written = {}
    for name, df in reports(t, args.as_of).items():
        if wanted and name not in wanted:
            continue
        path = os.path.join(args.out, name)
        df.write.mode("overwrite").parquet(path)
        written[name] = path
    return written


if __name__ == "__main__":
    main()
