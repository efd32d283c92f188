"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the cores. Every query runs once to warm
up, then twice; the mean counts. Results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.catalog.queries import QUERIES
from tidemark.session import local_session

HEADLINES = (
    "lab_features",
    "med_features",
    "diag_presence",
    "window_filter",
    "train_period",
    "process_family",
    "max_scale",
    "pivot_features",
    "codemap",
    "last_note",
    "clean_text",
    "tfidf_topk",
    "embed_text",
    "embedding_mean_pool",
    "roc_auc",
    "cohort_auc",
    "sparse_matrix",
)


def seconds(spark, folder: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=cores)
    timings = {}
    for name in HEADLINES:
        seconds(spark, folder, name)
        timings[name] = round(statistics.mean(seconds(spark, folder, name) for _ in range(2)), 3)
    result = {
        "metric": "headline queries, sum of means",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
