"""The question flow for a batch of questions: cache, search, guard, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.functions import access, guard, text
from corpusward.operators import admin, cache, reports, search
from corpusward.session import cut


def accepted(questions: DataFrame, principals: DataFrame) -> DataFrame:
    """Questions of valid length, with the asker's groups; unknown users are Public only."""
    groups = principals.select("username", "groups")
    return (
        questions.filter(text.query_length_ok(F.col("query")))
        .join(groups, "username", "left")
        .withColumn("groups", access.effective_groups(F.col("groups")))
    )


def guarded(questions: DataFrame, retrieved: DataFrame, threshold: float = guard.GATE_THRESHOLD):
    """Per question either a refusal or the prompt for the model; ``files`` lists valid citations."""
    ready = questions.select("query_id", "query").join(reports.context(retrieved), "query_id", "left")
    refusal = guard.gate(F.col("n_chunks"), F.col("top_score"), threshold)
    return ready.select(
        "query_id", "query", refusal.alias("refusal"),
        F.when(refusal.isNull(), guard.prompt(F.col("context"), F.col("query"))).alias("prompt"),
        F.coalesce("files", access.strings()).alias("files"),
    )


def finished(gated: DataFrame, generated: DataFrame) -> DataFrame:
    """Refusals as they are, generated answers (``query_id, answer``) with citations checked."""
    both = gated.join(generated, "query_id", "left")
    raw = F.coalesce("answer", F.lit(""))
    return both.select(
        "query_id", "query",
        F.coalesce("refusal", guard.strip_invalid(raw, F.col("files"))).alias("response"),
        F.when(F.col("refusal").isNull(), guard.valid_citations(raw, F.col("files")))
        .otherwise(access.strings()).alias("citations"),
        (F.col("refusal").isNull() & guard.needs_review(raw, F.col("files"))).alias("review"),
    )


def answer(
    questions: DataFrame, principals: DataFrame, cached: DataFrame, index: DataFrame,
    chunks: DataFrame, encoded: DataFrame, generated: DataFrame, limit: int = 5,
    cache_mode: str = "all_chunks", cache_encoded: DataFrame | None = None,
    active_only: bool = True,
) -> dict[str, DataFrame]:
    """The flow end to end.

    ``questions``: ``query_id, username, query, ts``; ``encoded``: vectors of the expanded
    questions, for the search; ``cache_encoded``: those of the plain ones, for the cache, if they
    differ; ``cached``: live cache entries; ``generated``: model answers. Replaced versions are not
    searched unless ``active_only`` is off. Returns ``hits``,
    ``retrieved``, ``answers``, the ``entries`` to write to the cache, and the ``audit`` rows.
    """
    asked = accepted(questions, principals)
    plain = encoded if cache_encoded is None else cache_encoded
    vectors = asked.select("query_id", "groups").join(plain, "query_id")
    hits = cut(cache.lookup(vectors, cached, mode=cache_mode))
    missed = cut(cache.misses(asked, hits))
    vectors = encoded.join(missed.select("query_id"), "query_id", "left_semi")
    retrieved = cut(search.search(index, chunks, missed, vectors, limit, active_only=active_only))
    answers = finished(guarded(missed, retrieved), generated)
    served = (
        hits.select("query_id", F.col("response_text").alias("response"), F.lit("cache").alias("served_from"))
        .unionByName(answers.select("query_id", "response", F.lit("search").alias("served_from")))
        .join(questions.select("query_id", "username", "query", "ts"), "query_id")
    )
    lineage = retrieved.select(
        "query_id", "rank", F.col("chunk_key").alias("chunk_id"), "filename", "source_type",
        "allowed_groups", "rerank_score",
    )
    return {
        "hits": hits,
        "retrieved": retrieved,
        "answers": answers,
        "entries": cache.new_entries(answers, retrieved, plain, questions),
        "audit": admin.audit_rows(served, principals, lineage),
    }
