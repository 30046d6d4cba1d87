"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (no rows are
collected to the driver). One warm-up pass of the first query absorbs JVM and
code-generation start-up. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "T3_last_run_per_spider",
    "J4_next_job_per_node",
    "J3_tag_match",
    "J1_earliest_pending",
    "T1_history_to_purge",
    "A7_effective_settings",
    "L7_timeout_actions",
    "L5_finish_history",
    "I1_log_facts",
    "I4_item_batches",
    "I5_batch_payload",
    "I6_form_encode",
    "F2_cron_fires",
    "J11_job_payload",
    "X1_node_liveness_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from crawlgrid import get_spark
    from crawlgrid.plans.q_streams import beat_feed
    from crawlgrid.plans.registry import QUERIES, load_all

    # spark.checkpoint.dir is taken from the session; the library sets a
    # local one only when none is configured (as here, on one machine)
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2))  # AQE coalesces further
    spark = get_spark(f"local[{cpus}]", app="crawlgrid-bench", shuffle_partitions=partitions,
                      extra={"spark.driver.memory": "16g"})
    load_all()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run(names[0])  # warm-up
    if any(n.startswith("X1") for n in names):
        beat_feed(spark, sf_dir)  # what X1 reads: written before the clock starts
    times = {n: round(run(n), 3) for n in names}
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
