"""Times the headline queries and prints one JSON line.

Every query is built and run into a sink that discards its rows, once to warm
up and then BENCH_RUNS times; the median counts.  Streaming and sink queries
include their writes.  Two inputs are stored tables that a session derives once,
in the warm-up: the message log and the approval steps, whose derivation is
timed as ``approval_steps``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnwork.session import local_session  # noqa: E402
from tarnwork.workload import QUERIES  # noqa: E402

HEADLINE = [
    "scan_count",
    "daily_order_totals",
    "orders_by_region",
    "events_first_100",
    "json_decode_valid",
    "sink_full_refresh",
    "pit_features",
    "materialize_latest",
    "materialize_incremental",
    "online_lookup",
    "label_encode",
    "access_decision",
    "access_decision_expiry_only",
    "manager_chain2",
    "approval_chain",
    "approval_steps",
    "approver_worklist",
    "request_final_status",
    "steps_after_reject",
    "steps_transfer",
    "sla_actions",
    "request_with_steps",
    "audit_last_200",
    "membership_to_add",
    "contract_columns",
    "governance_lookup",
    "lineage_edges",
    "catalog_diff",
    "log_rate_by_level",
    "log_fields",
    "counter_rate",
    "rate_sum_by",
    "latency_avg",
    "hist_q99",
    "alert_error_pct",
    "alert_for",
    "tumble_1m",
    "stream_detail",
    "stream_tumble_1m",
    "stream_dedup",
    "rf_vector_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, shuffle_partitions=cores, app="bench")
    times: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        taken = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cores,
                "shuffle_partitions": cores,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
