"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lodestone.session import get_spark

HEADLINE = ["knn_top10", "knn_batch_top5", "agg_topk", "term_stats", "bm25_top10", "hash_embed", "hybrid_search_top10", "rerank_fusion", "chunk_documents", "dedup_title_year", "index_diff", "tag_banding", "creators_joined", "stored_attachments"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    from lodestone.plans import catalogue

    found, took = catalogue.queries(), {}
    spark.range(1).count()
    for name in HEADLINE:
        started = time.time()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
