"""Benchmark: median seconds of headline queries, one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_RUNS (default 3) set the data, the cores and the repetitions.  Each query
is run once to warm up.  Results are written to the ``noop`` sink, so every row
and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {  # query → table whose rows are the input
    "r02_behaviour_rules": "events", "r03_sigma_rules": "events", "r06_lolbin_findings": "events", "r17_content_signatures": "documents",
    "r18_sensitive_data": "documents", "r20_whitelist_suppress": "events", "x01_char_entropy": "documents", "x12_url_features": "pages",
    "j02_enrich_network": "events", "j15_build_edges": "events", "j16_thread_outside_modules": "lineitem", "a08_flow_stats": "events",
    "a11_incident_rollup": "events", "a15_reputation_fold": "events", "a17_feed_health": "orders", "w01_dedup_alerts": "events",
    "w02_query_rate_60s": "events", "w03_beacon_stats": "events", "w09_sequence_features": "events", "w10_eventlog_chains": "events",
    "set02_diff_processes": "events", "g03_ransomware": "events", "c01_dns_threats": "events", "c05_enrich_events": "events",
    "c08_alert_flow": "events", "u06_execution_state": "lineitem", "h12_large_transfers": "events", "w16_correlate_exact": "events",
}


def main() -> None:
    from wardline.plans import catalog  # noqa: F401
    from wardline.plans.registry import QUERIES
    from wardline.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, "bench", shuffle_partitions=cpus)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in set(HEADLINE.values())}
    only = set(sys.argv[1:])
    seconds, rate = {}, {}
    for name, table in HEADLINE.items():
        if only and name not in only:
            continue
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        rate[name] = round(rows[table] / seconds[name])
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "rows_per_second": rate, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
