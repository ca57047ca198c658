"""The answer cache as a table: lookup, misses, new entries, expiry, invalidation."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions import access
from corpusward.functions.times import micros
from corpusward.operators.search import dense_topk
from corpusward.schemas import ANSWER_CACHE

MAX_DISTANCE = 0.15
TTL_SECONDS = 3600


def live(cache: DataFrame, as_of: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Entries younger than the time to live."""
    age = micros(as_of) - micros(F.col("created_at"))
    return cache.filter(age < ttl_seconds * 1000000)


def reusable(entries: DataFrame, mode: str = "all_chunks") -> DataFrame:
    """Rows (entry plus the asker's ``groups``) the asker may be answered from.

    ``any`` admits an entry if one of its groups matches, also when another chunk behind the
    answer is restricted; ``all_chunks`` asks that every chunk be visible.
    """
    if mode == "any":
        return entries.filter(access.may_reuse(F.col("allowed_groups"), F.col("groups")))
    return entries.filter(access.may_reuse_all(F.col("chunk_groups"), F.col("groups")))


def lookup(
    questions: DataFrame, cache: DataFrame, max_distance: float = MAX_DISTANCE,
    mode: str = "all_chunks", acl_first: bool = False, **options,
) -> DataFrame:
    """Questions answered from the cache: nearest entry, if close enough and permitted.

    ``questions``: ``query_id, groups, dense`` of the plain question; ``cache``: ``entry_id,
    response_text, allowed_groups, chunk_groups, dense``. By default the nearest entry is taken
    first and then checked, so a forbidden nearest entry is a miss; ``acl_first`` searches only
    among permitted entries (any-match on ``allowed_groups``) instead.
    """
    entries = cache.withColumnRenamed("entry_id", "chunk_key")
    if acl_first:
        open_to_all = F.when(
            F.size("allowed_groups") == 0, access.strings(access.PUBLIC)
        ).otherwise(F.col("allowed_groups"))
        nearest = dense_topk(entries.withColumn("allowed_groups", open_to_all), questions, 1, **options)
    else:
        nearest = dense_topk(entries, questions.drop("groups"), 1, **options)
    close = nearest.withColumn("distance", F.round(1 - F.col("score"), 9)).filter(
        F.col("distance") < max_distance
    )
    found = (
        close.select("query_id", F.col("chunk_key").alias("entry_id"), "distance")
        .join(questions.select("query_id", "groups"), "query_id")
        .join(cache.drop("dense"), "entry_id")
    )
    return reusable(found, mode).select("query_id", "entry_id", "distance", "response_text")


def misses(questions: DataFrame, hits: DataFrame) -> DataFrame:
    return questions.join(hits.select("query_id"), "query_id", "left_anti")


def new_entries(answers: DataFrame, retrieved: DataFrame, encoded: DataFrame, times: DataFrame) -> DataFrame:
    """Entries, as ``schemas.ANSWER_CACHE`` has them, for answers that cite at least one retrieved file.

    ``retrieved``: the chunks behind the answers, some per question; ``encoded``: ``query_id, dense``
    of the plain questions; ``times``: ``query_id, ts``. An entry keeps the groups of each of its
    chunks and all their files, so that ``lookup`` and ``invalidate`` can judge it later.
    """
    behind = retrieved.groupBy("query_id").agg(
        F.array_sort(F.collect_set("allowed_groups")).alias("chunk_groups"),
        F.array_sort(F.collect_set("filename")).alias("files"),
    )
    entries = answers.filter(F.size("citations") > 0).join(behind, "query_id")
    entries = entries.join(encoded.select("query_id", "dense"), "query_id").join(
        times.select("query_id", F.col("ts").alias("created_at")), "query_id")
    return entries.select(
        F.xxhash64("query_id", "query", "created_at").alias("entry_id"), F.col("query").alias("query_text"),
        F.col("response").alias("response_text"),
        F.array_sort(F.array_distinct(F.flatten("chunk_groups"))).alias("allowed_groups"),
        "chunk_groups", "files", "dense", "created_at",
    )


def write_entries(entries: DataFrame, path: str, batch_id: int) -> None:
    """Store a batch's entries by the hour they were made in; a repeated batch replaces its own."""
    hour = F.date_format("created_at", "yyyyMMddHH").cast("int")
    entries.withColumn("hour", hour).write.mode("overwrite").partitionBy("hour").parquet(f"{path}/batch_id={batch_id}")


def read_entries(
    spark: SparkSession, path: str, as_of: datetime, ttl_seconds: int = TTL_SECONDS
) -> DataFrame:
    """Entries that are live at ``as_of``, a time in the session's zone; only the folders of their
    hours are read.

    Of entries made more than once for the same words and files the newest is read, ties to the
    smaller id.
    """
    oldest = as_of - timedelta(seconds=ttl_seconds)
    first, last = (int(moment.strftime("%Y%m%d%H")) for moment in (oldest, as_of))
    stored = spark.read.schema(f"{ANSWER_CACHE}, batch_id BIGINT, hour INT").parquet(path)
    now = F.lit(as_of.isoformat(" ")).cast("timestamp")
    recent = stored.filter(F.col("hour").between(first, last) & (F.col("created_at") <= now))
    columns = [c for c in recent.columns if c not in ("batch_id", "hour")]
    newest = F.max_by(F.struct(*columns), F.struct("created_at", -F.col("entry_id").cast("decimal(20,0)")))
    found = live(recent, now, ttl_seconds).groupBy("query_text", "files", "chunk_groups").agg(newest.alias("e"))
    return found.select("e.*")


def invalidate(cache: DataFrame, updated: DataFrame, files: str = "files") -> DataFrame:
    """Entries none of whose source files is in ``updated(filename)``."""
    stale = (
        cache.select("entry_id", F.explode(files).alias("filename"))
        .join(updated.select("filename").distinct(), "filename", "left_semi")
        .select("entry_id").distinct()
    )
    return cache.join(stale, "entry_id", "left_anti")
