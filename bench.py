"""Headline queries on one scale factor; prints one JSON line.

Each query runs twice in one session and the second run counts, so the numbers
are about the plans and not about the start of the JVM. Results go to a
``noop`` sink: everything is computed, nothing is collected.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) apply.
"""

import json
import os
import sys
import time

from sitemarks.plans import derived
from sitemarks.plans.queries import QUERIES
from sitemarks.session import build_session

HEADLINE = [
    "detection_result",
    "html_evidence",
    "evidence_all",
    "summary_flags",
    "result_json",
    "catalog_theta_join",
    "page_resources",
    "page_metadata",
    "run_statistics",
    "progress_snapshots",
    "url_variations",
    "resume_pending",
    "run_reconcile",
    "domain_waves",
    "block_windows",
    "block_alerts",
    "retry_queue",
    "stall_gaps",
    "resolved_url",
    "stream_detection",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(cpus, "sitemarks-bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(timed(spark, name, sf_dir), 3)
    pages = derived.table(spark, sf_dir, "pages").count()
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    if "detection_result" in seconds:
        out["pages_per_sec"] = round(pages / seconds["detection_result"], 1)
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
