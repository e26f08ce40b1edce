"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``. Every query is run to the end and its rows are counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from workloads import QUERIES
from workloads.check import session

HEADLINE = [
    "load_hierarchy", "flatten_depth2", "flatten_depth4", "flatten_depth5", "validate_violations", "valid_docs",
    "chunk_ids", "point_ids", "embed_hash", "ingest_collection", "knn_topk", "knn_queries_side", "knn_blocked",
    "knn_by_project", "assemble_prompt", "parse_predictions", "attach_similarity", "result_envelope",
    "blacklist_hits", "blacklist_by_grams", "delete_points", "jobs_latest", "stream_ingest",
    "match_forward", "match_reverse", "match_both",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    QUERIES["flatten_depth1"](spark, sf_dir).count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
