"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. Every query runs to
the end (into a sink that discards rows); the best of BENCH_RUNS is reported
after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from ledgerloom import catalog  # noqa: E402
from ledgerloom.session import local_session  # noqa: E402

HEADLINE = (
    "customer_hourly_rollup", "org_hourly_rollup", "customer_daily_rollup", "org_daily_rollup",
    "customer_monthly_rollup", "org_monthly_rollup", "customer_hourly_two_runs", "upsert_daily_summary",
    "top_parties", "party_distribution", "weekly_trend", "kpi_tiles", "share_of_total",
    "dq_duplicate_transfers", "dq_summary_vs_raw_by_day", "dedupe_events", "route_events",
    "wallet_success_events", "apply_webhooks", "user_history_pages", "dest_summary", "ledger_balance",
    "purge_expired", "settlement_deductions", "reconcile_bank", "org_party_monthly",
)
STREAMS = ("stream_routed_events", "stream_hourly_rollup")


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, app="ledgerloom-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = catalog.all_queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        run(queries[name], spark, sf_dir)
        times[name] = round(min(run(queries[name], spark, sf_dir) for _ in range(runs)), 3)
    for name in STREAMS:
        run(queries[name], spark, sf_dir)
        times[name] = round(run(queries[name], spark, sf_dir), 3)
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
