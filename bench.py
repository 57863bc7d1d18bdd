"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from factloom.queries import load
from factloom.session import local_session

HEADLINE = (
    "bm25_topk", "rule_rerank", "hybrid_merge", "search_diagnostics", "dense_topk", "overlap_retrieval", "token_idf",
    "evidence_rank", "useful_page_funnel", "page_quality", "line_repeat_cap", "overlap_chunks", "page_dedup_two_keys",
    "content_hash_dedup", "kb_build_counts", "html_strip_text", "entity_prf", "claim_rouge", "scoring_points",
    "weighted_final_score", "judge_numbers", "run_summary", "metric_compare", "sample_deltas", "failure_categories",
    "tool_sequences", "error_streaks", "ttl_cache_hits", "kb_bucket_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    only = sys.argv[1:]
    spark = local_session(cpus, app="factloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    # one small job so that starting the JVM is not charged to the first query
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
