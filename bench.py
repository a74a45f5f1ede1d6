"""Headline queries, timed. Prints one JSON line.

Each query is run to the end (every column of every row) into a sink that keeps nothing,
once to warm up and then RUNS more times; the best time counts. Streaming queries do their
work when called, so the call is inside the timing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from relaymill.plans import catalog
from relaymill.session import local_session

RUNS = 1
HEADLINE = (
    "request_outcome",
    "ingest_flow1",
    "ingest_flow2",
    "batch_generate",
    "flow1_reflect",
    "flow2_examine",
    "flow1_acknowledge",
    "flow2_seal",
    "rejected_messages",
    "persist_projection",
    "upsert_latest",
    "end_to_end_flow1",
    "end_to_end_flow2",
    "table_scan",
    "latest_n",
    "latest_flow2",
    "lookup_message",
    "created_range",
    "audit_steps",
    "replica_diff",
    "stream_end_to_end",
    "stream_upsert",
)
# Work outside Spark's compiled plan dominates these; one timed run is enough.
ONCE = ("stream_end_to_end", "stream_upsert")


def run(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    registered = catalog.queries()
    chosen = [name for name in HEADLINE if not sys.argv[1:] or name in sys.argv[1:]]
    times: dict[str, float] = {}
    for name in chosen:
        first = run(registered[name], spark, sf_dir)
        again = [] if name in ONCE else [run(registered[name], spark, sf_dir) for _ in range(RUNS)]
        times[name] = round(min([first, *again]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rpartition("sf")[2],
            }
        )
    )


if __name__ == "__main__":
    main()
