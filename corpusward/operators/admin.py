"""Audit log, dead letters, principals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions import access
from corpusward.functions.text import iso_timestamp
from corpusward.functions.times import micros

MAX_RETRIES = 3
BACKOFF_CAP_SECONDS = 60
MAX_AUDIT_PAGE = 500
MAX_DLQ_PAGE = 200


# --- audit log ---------------------------------------------------------------------------------

def audit_rows(
    answers: DataFrame, principals: DataFrame, lineage: DataFrame | None = None
) -> DataFrame:
    """Audit rows for ``answers(query_id, username, query, response, served_from, ts)``.

    ``lineage(query_id, rank, chunk_id, filename, source_type, allowed_groups, rerank_score)`` adds
    the retrieved chunks; answers served from the cache have none. Unknown users get a null id.
    """
    known = principals.select("username", "user_id")
    rows = answers.join(known, "username", "left")
    if lineage is not None:
        item = F.struct("chunk_id", "filename", "source_type", "allowed_groups", "rerank_score")
        listed = lineage.groupBy("query_id").agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("rank"), item.alias("item")))),
                lambda r: r["item"],
            ).alias("retrieved_chunks")
        )
        rows = rows.join(listed, "query_id", "left")
    else:
        rows = rows.withColumn("retrieved_chunks", F.lit(None))
    return rows.select(
        "user_id", "query", "response", "served_from", "retrieved_chunks", "ts"
    )


def display_user(user_id: Column) -> Column:
    return F.coalesce(user_id.cast("string"), F.lit("Anon"))


def page(rows: DataFrame, order: str, tie: str, skip: int, limit: int, cap: int) -> DataFrame:
    """Newest first; only ``skip + limit`` rows per task leave the scan.

    A page of more than ``cap`` rows is refused, not cut.
    """
    if not 1 <= limit <= cap or skip < 0:
        raise ValueError(f"limit must be 1 to {cap} and skip 0 or more; got {limit} and {skip}")
    return rows.orderBy(F.desc(order), F.desc(tie)).offset(skip).limit(limit)


def audit_page(logs: DataFrame, skip: int = 0, limit: int = 50, tie: str = "id") -> DataFrame:
    return page(logs, "ts", tie, skip, limit, MAX_AUDIT_PAGE).withColumn(
        "timestamp", iso_timestamp(F.col("ts"))
    )


def lineage_cards(logs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per audit entry and chunk it cites, with the chunk's columns where it exists.

    A popular chunk makes a hot join key on the log side, which adaptive execution splits.
    """
    cited = logs.withColumn("chunk_key", F.explode_outer("chunk_ids")).drop("chunk_ids")
    return cited.join(chunks, "chunk_key", "left")


def leaks(logs: DataFrame, chunks: DataFrame, principals: DataFrame) -> DataFrame:
    """Cited chunks their reader was not entitled to see; expected to be empty."""
    cards = lineage_cards(logs, chunks).filter(F.col("allowed_groups").isNotNull())
    readers = principals.select("user_id", "groups")
    return cards.join(readers, "user_id", "left").filter(
        ~access.may_see(F.col("allowed_groups"), F.col("groups"))
    )


# --- dead letters ------------------------------------------------------------------------------

def dead_letters(failures: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failed rows (``filepath, source_type, error_message, attempt, ts``) whose retries are used up."""
    return failures.filter(F.col("attempt") >= max_retries).select(
        "filepath", "source_type", "error_message",
        F.col("attempt").cast("int").alias("retry_count"),
        F.lit("FAILED").alias("status"), F.col("ts").alias("created_at"),
    )


def retries(
    failures: DataFrame, max_retries: int = MAX_RETRIES, cap_seconds: int = BACKOFF_CAP_SECONDS
) -> DataFrame:
    """Failed rows to try again, with the time of the next attempt: 2**attempt seconds, capped."""
    wait = F.least(F.lit(cap_seconds), F.pow(F.lit(2), F.col("attempt")).cast("int"))
    return failures.filter(F.col("attempt") < max_retries).select(
        "filepath", "source_type", "error_message",
        (F.col("attempt") + 1).alias("attempt"),
        F.timestamp_micros(micros(F.col("ts")) + wait * 1000000).alias("next_attempt_at"),
    )


def with_status(dlq: DataFrame, status: str | None = None) -> DataFrame:
    return dlq if not status else dlq.filter(F.col("status") == F.lit(status.upper()))


def dlq_page(
    dlq: DataFrame, status: str | None = None, skip: int = 0, limit: int = 50, tie: str = "id"
) -> DataFrame:
    return page(with_status(dlq, status), "created_at", tie, skip, limit, MAX_DLQ_PAGE)


def mark(dlq: DataFrame, chosen: DataFrame, status: str, key: str = "id") -> DataFrame:
    """``dlq`` with the status of the chosen records rewritten."""
    flags = chosen.select(key).distinct().withColumn("__chosen", F.lit(True))
    new = F.when(F.col("__chosen"), F.lit(status)).otherwise(F.col("status"))
    return dlq.join(flags, key, "left").withColumn("status", new).drop("__chosen")


def replay(dlq: DataFrame, chosen: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Files to ingest again, and the table with those records marked RETRIED."""
    queue = dlq.join(chosen.select(key).distinct(), key, "left_semi").select(
        "filepath", "source_type"
    )
    return queue, mark(dlq, chosen, "RETRIED", key)


# --- principals --------------------------------------------------------------------------------

def for_admins(rows: DataFrame, principals: DataFrame, asker: Column) -> DataFrame:
    """``rows`` if the asking user is an admin, else none of them."""
    allowed = principals.filter((F.col("username") == asker) & access.is_admin(F.col("groups")))
    return rows.filter(allowed.select(F.count("*") > 0).scalar())


def admin_rows(rows: DataFrame, principals: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows of users that hold the admin group."""
    admins = principals.filter(access.is_admin(F.col("groups"))).select(user)
    return rows.join(admins, user, "left_semi")


def register(existing: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: new user names enter as Public; taken ones are rejected.

    Of several requests for one name the first by ``request_id`` counts.
    """
    first = requested.groupBy("username").agg(F.min("request_id").alias("request_id"))
    accepted = first.join(existing.select("username"), "username", "left_anti").withColumn(
        "groups", access.strings(access.PUBLIC)
    )
    rejected = requested.join(accepted.select("request_id"), "request_id", "left_anti")
    return accepted, rejected


def update_groups(principals: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(updated principals, rejected changes)``; groups are replaced, not merged."""
    new = changes.select("username", F.col("groups").alias("__new"))
    updated = (
        principals.join(new, "username", "left")
        .withColumn("groups", F.coalesce("__new", "groups")).drop("__new")
    )
    rejected = changes.join(principals.select("username"), "username", "left_anti")
    return updated, rejected


def role_membership(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """``(user_id, groups)`` from the many-to-many role tables."""
    return (
        users.select("user_id").join(user_roles, "user_id").join(roles, "role_id")
        .groupBy("user_id").agg(F.array_sort(F.collect_set("role_name")).alias("groups"))
    )


def delete_documents(
    documents: DataFrame, chunks: DataFrame, doomed: DataFrame, key: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed documents: chunks go with their document."""
    gone = doomed.select(*key).distinct()
    return documents.join(gone, key, "left_anti"), chunks.join(gone, key, "left_anti")


def delete_users(
    principals: DataFrame, logs: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Principals without the doomed users; their audit rows stay, with a null user."""
    gone = doomed.select("user_id").distinct().withColumn("__gone", F.lit(True))
    kept = logs.join(gone, "user_id", "left").withColumn(
        "user_id", F.when(F.col("__gone").isNull(), F.col("user_id"))
    )
    return principals.join(gone, "user_id", "left_anti"), kept.drop("__gone")
