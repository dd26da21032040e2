"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, os.path.join(str(ROOT), "src"))

HEADLINE = ("tokenize_docs", "postings", "bm25_topk", "bm25_benchmark_batch", "dense_topk", "sentence_split", "page_links", "segment_strategies", "find_on_pages", "locate_control", "etag_changes", "settle_sessions")


def main() -> None:
    from pagelode.plans.queries import queries
    from pagelode.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", "16g", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("OFF")
    known, took = queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    rates = {"pages_per_s": round(pages / took["segment_strategies"], 1), "query_documents_per_s": round(spark.read.parquet(f"{sf}/documents.parquet").count() * spark.read.parquet(f"{sf}/benchmark.parquet").count() / took["bm25_benchmark_batch"])}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rates": rates, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
