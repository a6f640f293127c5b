"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "search_query",        # flagship: scoring -> index -> substring search -> lookup
    "postings",            # inverted index build
    "search_batch",        # table of queries, bigram equi-join matching
    "difficulty_score",    # scoring projection
    "index_terms",
    "crawled_metadata",    # pages -> links -> topics -> numbered metadata
    "parse_or_fallback",   # reply cleaning + JSON parsing with fallback
    "render_prompts",
    "case_verdicts",       # lineitem-sized verdict aggregation
    "expectations",        # assembly + rule checks
    "assign_ids",          # distributed dense numbering
    "retry_first_success", # minima and counts, no window
    "run_summary",
    "sequence_ratio",      # exact ratio UDF on record pairs
    "metadata_collection",
    "assemble_records",
    "dedupe_gate_benchmark",  # near-duplicate gate: documents vs benchmark items
    "dedupe_gate",         # the same, parts against a small store
    "near_dup_pairs",      # all duplicate pairs of distinct strings
    "first_duplicate",     # earliest duplicate of each record
    "greedy_dedupe",       # keep-first in growing prefixes
    "stream_gate",         # keep-first over arriving batches
    "stream_index",        # index kept current over arriving batches
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from pyspark.sql import SparkSession

    from quarry.plans.queries import QUERIES

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("quarry-bench")
             .config("spark.sql.shuffle.partitions", str(max(8, int(cpus) * 2)))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-bench-"))
    # JVM/session start-up is not a query: warm up once, untimed.
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
