"""Retrieval quality, citation quality, ingestion and operations reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusward.functions import guard

# Alert thresholds and request limits per minute.
P95_LIMIT_MS = 8000
CACHE_HIT_FLOOR = 0.20
FAILURE_CEILING = 0.05
RATE_LIMITS = {"register": 5, "login": 10, "query": 30}


def context(retrieved: DataFrame) -> DataFrame:
    """``(query_id, context, files, n_chunks, top_score)`` from ``(query_id, rank, filename, text,
    rerank_score)``; a question has at most as many rows as the search limit."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "filename", "text", "rerank_score")))
    grouped = retrieved.groupBy("query_id").agg(rows.alias("__rows"))
    blocks = F.transform(
        F.col("__rows"), lambda r: guard.context_block(r["rank"], r["filename"], r["text"])
    )
    return grouped.select(
        "query_id",
        F.array_join(blocks, "\n").alias("context"),
        F.array_sort(F.array_distinct(F.col("__rows.filename"))).alias("files"),
        F.size("__rows").alias("n_chunks"),
        F.element_at("__rows", 1)["rerank_score"].alias("top_score"),
    )


def shared_context(questions: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``questions`` with ``context, files, n_chunks``, those of ``context`` for ``found`` with its chunks.

    ``found(query_id, rank, chunk_key)`` has no texts. Questions that found the same chunks in the same
    order share one context: texts move once per distinct list, never once per question, and
    the context meets its questions where it was made. Questions without a chunk are left out.
    """
    lists = found.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_key"))).alias("__list")
    )
    asked = questions.join(lists, "query_id")
    retrieved = (
        lists.select("__list").distinct().select("__list", F.inline("__list"))
        .join(chunks.select("chunk_key", "filename", "text"), "chunk_key")
        .select(F.col("__list").alias("query_id"), "rank", "filename", "text", F.lit(None).cast("double").alias("rerank_score"))
    )
    made = context(retrieved).select(F.col("query_id").alias("__list"), "context", "files", "n_chunks")
    return asked.join(made, "__list").drop("__list")


def answer_groups(retrieved: DataFrame) -> DataFrame:
    """Union of the groups of all chunks behind an answer."""
    return retrieved.groupBy("query_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("allowed_groups")))).alias("groups")
    )


def retrieved_files(retrieved: DataFrame) -> DataFrame:
    return retrieved.groupBy("query_id").agg(
        F.array_sort(F.collect_set("filename")).alias("files")
    )


def retrieval_quality(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per question with gold chunks: recall, precision at ``k``, reciprocal rank of the first hit."""
    hits = retrieved.filter(F.col("rank") <= k).join(
        gold.select("query_id", "chunk_key"), ["query_id", "chunk_key"]
    )
    found = hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.min("rank").alias("first_hit")
    )
    wanted = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    n = F.coalesce("n_hits", F.lit(0))
    return wanted.join(found, "query_id", "left").select(
        "query_id", "n_gold", n.alias("n_hits"),
        (n / F.col("n_gold")).alias("recall"),
        (n / F.lit(k)).alias("precision"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def overall_quality(per_question: DataFrame) -> DataFrame:
    """Means over all questions with gold chunks."""
    return per_question.agg(
        F.count("*").alias("n_questions"),
        F.avg("recall").alias("context_recall"),
        F.avg("precision").alias("context_precision"),
        F.avg("reciprocal_rank").alias("mrr"),
    )


def citation_precision(answers: DataFrame) -> DataFrame:
    """Share of all citations (repeats counted) that name a retrieved file."""
    cited = guard.citations(F.col("answer"))
    good = F.filter(cited, lambda name: F.array_contains(F.col("files"), name))
    return answers.agg(
        F.sum(F.size(cited)).alias("n_citations"),
        F.sum(F.size(good)).alias("n_valid"),
        F.try_divide(F.sum(F.size(good)), F.sum(F.size(cited))).alias("precision"),
    )


def ingestion_log(events: DataFrame) -> DataFrame:
    """Per file: first and last load, loads, who loaded it last and with which status."""
    newest = F.max_by(F.struct("loaded_by", "status"), F.struct("ts", "id"))
    return events.groupBy("filename").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count("*").alias("n_loads"), newest.alias("__last"),
    ).select(
        "filename", "first_ts", "last_ts", "n_loads",
        F.col("__last.loaded_by").alias("loaded_by"), F.col("__last.status").alias("status"),
    )


def ingest_summary(chunks: DataFrame, kept: Column) -> DataFrame:
    """Per source: files, chunks read, duplicates dropped, chunks stored."""
    stored = F.sum(kept.cast("bigint"))
    return chunks.groupBy("source_type").agg(
        F.countDistinct("filename").alias("files"),
        F.count("*").alias("extracted"),
        (F.count("*") - stored).alias("duplicates"),
        stored.alias("stored"),
    )


def _exact_p95(requests: DataFrame, every: str, share: float = 0.95) -> DataFrame:
    """``(w, p95_ms)``: the smallest latency that ``share`` of a window's requests do not exceed.

    Works on counts per distinct latency, which are pre-aggregated, never on a window's rows.
    """
    counted = requests.filter(F.col("latency_ms").isNotNull()).groupBy(
        F.window("ts", every).alias("w"), "latency_ms"
    ).agg(F.count("*").alias("__n"))
    window = W.partitionBy("w")
    upto = F.sum("__n").over(window.orderBy("latency_ms"))
    reached = counted.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(window))
    return (
        reached.filter(F.col("__upto") >= F.ceil(F.col("__all") * F.lit(share).cast("decimal(3,2)")))
        .groupBy("w").agg(F.min("latency_ms").alias("p95_ms"))
    )


def ops_rollup(
    requests: DataFrame, every: str = "1 hour", accuracy: int | None = None,
) -> DataFrame:
    """Per time window: p95 latency, cache hit rate, failure rate, tokens, cost, threshold flags.

    ``requests``: ``ts, latency_ms, cached, failed, tokens`` and, if known, ``cost``. The percentile
    is exact; ``accuracy`` (rank error ``1 / accuracy``) replaces it by a mergeable sketch.
    """
    window = F.window("ts", every).alias("w")
    sketch = [F.percentile_approx("latency_ms", 0.95, accuracy).alias("p95_ms")] if accuracy else []
    cost = [F.sum("cost").alias("cost")] if "cost" in requests.columns else []
    rolled = requests.groupBy(window).agg(
        F.count("*").alias("n_requests"), *sketch,
        F.avg(F.col("cached").cast("double")).alias("cache_hit_rate"),
        F.avg(F.col("failed").cast("double")).alias("failure_rate"),
        F.sum("tokens").alias("tokens"), *cost,
    )
    if not accuracy:
        rolled = rolled.join(_exact_p95(requests, every), "w", "left")
    return rolled.select(
        F.col("w.start").alias("window_start"), "n_requests", "p95_ms", "cache_hit_rate",
        "failure_rate", "tokens", *(["cost"] if cost else []),
        (F.col("p95_ms") > P95_LIMIT_MS).alias("slow"),
        (F.col("cache_hit_rate") < CACHE_HIT_FLOOR).alias("cold_cache"),
        (F.col("failure_rate") > FAILURE_CEILING).alias("failing"),
    )


def over_limit(requests: DataFrame, limit: int, caller: str = "caller") -> DataFrame:
    """Callers with more than ``limit`` requests in a calendar minute; batch or streaming."""
    return (
        requests.groupBy(F.window("ts", "1 minute").alias("w"), caller)
        .agg(F.count("*").alias("n_requests"))
        .filter(F.col("n_requests") > limit)
        .select(F.col("w.start").alias("minute"), caller, "n_requests")
    )
