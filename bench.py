"""Seconds per registered query: prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the local core count;
``BENCH_QUERIES`` (comma separated) limits the run.  Each query is executed in full
into a sink that discards rows.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marginalia.plans.catalog import CATALOG  # noqa: E402
from marginalia.session import build_session  # noqa: E402

HEADLINE = (
    "doc_hash_dedupe", "clean_text", "sentence_split", "heading_sections", "repeated_line_removal", "chunk_documents",
    "chunk_cleaned_documents", "token_keywords", "conversation_notes", "row_sentences", "date_compare", "number_extract",
    "entity_resolution", "candidate_memories", "bfs_subgraph", "facts_per_part", "replacement_chain", "memory_supersede",
    "late_event_guard", "memory_merge_sources", "edge_upsert", "delete_document_cascade", "projection_delta", "cosine_topk_per_label",
    "keyword_topk", "ngram_leak", "hybrid_fusion", "evidence_trim", "draft_issues", "review_decisions", "eval_report", "answer_benchmark",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        CATALOG[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus), "spark": spark.version,
                      "shuffle_partitions": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
