"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is planned and run afresh into a sink that discards its rows: once to warm up,
then ``$BENCH_RUNS`` times, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from curalith.queries import QUERIES
from curalith.session import build_session

HEADLINE = [
    "curated_quality",
    "dq_missing_fail",
    "enrich_lines",
    "typed_cells",
    "csv_typed_scan",
    "schema_violations",
    "quarantine_stats",
    "pk_duplicates",
    "record_index",
    "dataset_fingerprint",
    "ontology_project",
    "join_inner",
    "join_left",
    "join_full",
    "join_multi_key",
    "asof_join",
    "asof_nearest",
    "status_fold",
    "latest_per_key",
    "sequence_numbers_per_store",
    "previous_version",
    "publish_classify",
    "lineage_trace",
    "lineage_documents",
    "retrieve_joined",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in chosen:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
