"""Time the headline queries, each twice; prints one JSON line with the second, warm times and the first ones."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelake.session import build_session
from tracelake.workload.catalogue import QUERIES

HEADLINE = (
    "thread_cpu_precise", "process_cpu_precise", "ready_to_switch", "lock_contention", "cpu_sampling_table",
    "cpu_timeline", "per_cpu_summary", "hot_functions", "duration_histogram", "dispatch_quality",
    "stack_weights", "call_edges", "connection_summary", "enriched_connection_summary", "process_throughput",
    "connect_latency", "completion_batches", "socket_lifecycle", "request_report", "queue_depth",
    "quic_connections", "quic_ack_delays", "decoded_packets", "capture_summary", "send_recv_latency",
    "compare_functions", "consolidated_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()
    wanted = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    first, times = {}, {}
    for name in wanted:
        for runs in (first, times):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], "first", first[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first_run": first, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
