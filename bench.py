"""Time the headline queries and print one JSON line.

Each query runs once for warming up and then ``BENCH_RUNS`` times (1); the
best run counts.  All rows and columns are produced and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from flowloom.operators.lineage import clear
from flowloom.plans import QUERIES
from flowloom.session import local_session

HEADLINES = [
    "flow_facts",
    "route_summary",
    "enrich_flows",
    "rollup_region_nation",
    "cube_flag_brand",
    "assets_per_route",
    "dedup_latest",
    "join_left",
    "asof_last_click",
    "band_clicks_before_purchase",
    "quantiles",
    "resample_monthly",
    "rolling_7_days",
    "rolling_6_hours",
    "top_receivers_per_source",
    "top_senders",
    "sender_turnover",
    "edges",
    "degrees",
    "transitions",
    "projection_strength",
    "clustering",
    "connected_components",
    "pagerank_trade",
    "hits",
    "label_propagation",
    "k_core",
    "bfs_levels",
    "sender_distribution",
    "rank_largest_quantities",
    "share_of_source",
    "strong_edges",
    "sankey_links",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, "flowloom-bench")
    seconds = {}
    for name in names:
        times = []
        for _ in range(1 + runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:] or times), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(line), flush=True)
    clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
