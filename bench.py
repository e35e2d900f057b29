"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans import checks  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402

HEADLINE = [
    "completeness",
    "duplicate_rows",
    "freshness_violations",
    "match_candidates",
    "match_one_to_one",
    "orphan_transactions",
    "missing_receipts",
    "match_receipts_lev",
    "build_vendor_profiles",
    "amount_outliers_by_vendor",
    "rolling_deviation",
    "anomaly_report",
    "isolation_forest_score",
    "email_matches",
    "receipt_files",
    "severity_live",
    "run_audit",
    "fp_rate_by_vendor",
    "corrupt_missing",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{root}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        # the noop sink runs the whole query without collecting it
        checks.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")),
                "cpus": cpus,
                "transactions": rows,
                "audit_rows_per_second": round(rows / seconds["run_audit"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
