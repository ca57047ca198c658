"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from corpusward import catalog
from corpusward.session import build_session

HEADLINE = [
    "split_sections", "redact_pii", "chunk_fixed_overlap", "acl_filter", "sessionize_gap",
    "assemble_thread", "version_documents", "chunk_table_rows", "exact_dedup", "dedup_keep_first",
    "lexical_weights", "build_sparse_vector", "embed", "dense_topk", "sparse_topk", "hybrid_rrf",
    "rerank_topk", "cache_lookup", "assemble_context", "strip_invalid_citations", "acl_leak_audit",
    "lineage_explode_join", "ops_rollup", "page_audit_log", "sink_chunk_index",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("acl_filter")
    seconds = {name: run(name) for name in HEADLINE}
    total = round(sum(seconds.values()), 3)
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    questions = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
        "chunks_indexed_per_sec": round(documents / seconds["embed"], 1),
        "questions_per_sec": round(questions / seconds["rerank_topk"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
