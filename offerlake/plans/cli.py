"""Command line for the composed jobs.

    python -m offerlake.plans.cli startup --offers PATH --snapshot PATH --feed PATH --as-of "2024-01-31 00:00:00"
    python -m offerlake.plans.cli report  --offers PATH --group-by weekly --as-of "..." --out PATH
    python -m offerlake.plans.cli sweep   --offers PATH --as-of "..." --out PATH

Run it with spark-submit on a cluster (the master and spark.checkpoint.dir
come from the launcher) or with plain python for a local session.
"""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import functions as F

from offerlake.operators import lifecycle
from offerlake.plans import jobs
from offerlake.session import get_spark
from offerlake.sources import io


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="offerlake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    st = sub.add_parser("startup", help="five sweeps -> new snapshot, then rebroadcast the order feed")
    st.add_argument("--offers", required=True)
    st.add_argument("--snapshot", required=True)
    st.add_argument("--feed", required=True)
    rp = sub.add_parser("report", help="the dashboard document as one JSON line")
    rp.add_argument("--offers", required=True)
    rp.add_argument("--group-by", default="daily", choices=["daily", "weekly", "monthly"])
    rp.add_argument("--out", required=True)
    sw = sub.add_parser("sweep", help="rows each start-up sweep acts on")
    sw.add_argument("--offers", required=True)
    sw.add_argument("--out", required=True)
    for p in (st, rp, sw):
        p.add_argument("--as-of", required=True, help="UTC, e.g. 2024-01-31 00:00:00")
    args = ap.parse_args(argv)
    as_of = datetime.fromisoformat(args.as_of)
    spark = get_spark()
    if args.cmd == "startup":
        summary = jobs.startup_job(spark, args.offers, args.snapshot, args.feed, as_of)
        summary.show(truncate=False)
    elif args.cmd == "report":
        jobs.dashboard_report(spark, args.offers, args.group_by, as_of).write.mode("overwrite").text(args.out)
    else:
        offers = io.read_offers(spark, args.offers)
        parts = [lifecycle.sweep(offers, rule, as_of).withColumn("rule", F.lit(rule))
                 for rule in lifecycle.SWEEP_ORDER]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
