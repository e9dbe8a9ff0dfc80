"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "channel_totals",
    "account_activity",
    "hold_time",
    "identity_sharing",
    "feature_matrix",
    "ring_edges",
    "ring_alerts",
    "ring_roles",
    "rings_discovered",
    "taint_summary",
    "freeze_plan",
    "fund_flow_paths",
    "recruits",
    "heatmap_grid",
    "kde_surface",
    "snapshot_features",
    "ledger_page",
    "recent_transactions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from muletrace.plans import catalog
    from muletrace.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    names = sys.argv[1:] or HEADLINE
    queries["channel_totals"](spark, sf_dir).collect()  # start the engine before timing
    times = {}
    for name in names:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir), "cpus": cpus}))


if __name__ == "__main__":
    main()
