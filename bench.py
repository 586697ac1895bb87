"""Headline timings: one JSON line with seconds per query.

Each query runs into a no-op sink, once to warm up and then ``BENCH_RUNS`` times; the
median counts. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from codeloom.plans.queries import REGISTRY  # noqa: E402
from codeloom.session import local_session  # noqa: E402

HEADLINE = (
    "corpus_scan", "language_profile", "module_profile", "functions", "chunks_token",
    "chunks_fixed", "dedup_hash", "cache_lookup", "cache_miss", "embed_corpus",
    "vector_topk", "vector_topk_batch", "prompt_evidence", "report_assemble",
    "validate_methods", "containing_function",
)


def run(spark, folder: str, name: str) -> float:
    started = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, folder, name)
        seconds[name] = round(statistics.median(run(spark, folder, name) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline queries, warm median",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": pathlib.Path(folder).name.removeprefix("sf"),
        "cores": cores,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
