"""Time the headline queries: one cold and BENCH_WARM (default 1) warm runs each; the value is the sum of warm medians.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma list) override the defaults.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pagespark.plans import load_catalog
from pagespark.session import get_session

HEADLINE = [
    "network_errors", "network_report", "paired_requests", "settle_times", "sessions_half_hour", "active_tab_per_call",
    "session_load", "storage_state", "cookie_jar", "effective_settings", "url_verdicts", "redacted_calls",
    "classified_calls", "compact_text", "compact_html", "markdown", "find_text", "page_assertions", "dom_tag_counts",
    "compact_trees", "snapshot_diff",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = int(os.environ.get("BENCH_WARM", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    spark.range(1000).selectExpr("sum(id)").collect()
    took, cold = {}, {}
    for name in names:
        times = []
        for _ in range(1 + warm):
            t0 = time.time()
            catalog[name].job(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t0)
        cold[name] = round(times[0], 3)
        took[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} cold {cold[name]} warm {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "cold": cold, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
