"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from prospectra.plans.catalogue import catalogue  # noqa: E402

HEADLINE = (
    "chunk_pages", "classify_by_keywords", "tokenise", "bm25_search", "knn_l2", "hybrid_search",
    "scorecard", "financial_flags", "assemble_items", "section_ranges", "rank_register", "fewest_batches",
    "unsupported_figures", "case_summary", "offer_metrics", "merge_page_blocks", "trailing_usage", "total_and_rating",
    "upsert_documents", "stream_usage", "collect_facts", "analysis_digest", "tag_chunks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("prospectra-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue().queries
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        while len(runs) < 3 and sum(runs) < 24:      # the best of three
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
