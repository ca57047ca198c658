"""From whole texts, messages and table rows to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions import access, text
from corpusward.functions.times import micros
from corpusward.operators.running import time_bucket, with_running


def markdown_chunks(docs: DataFrame, body: str = "text") -> DataFrame:
    """One row per section with its own access groups; other columns repeat."""
    keep = [c for c in docs.columns if c != body]
    pieces = docs.select(*keep, F.posexplode(text.sections(F.col(body))).alias("chunk_index", body))
    return pieces.withColumn("allowed_groups", access.section_groups(F.col(body)))


def overlap_chunks(
    docs: DataFrame, body: str = "text", size: int = 512, overlap: int = 64
) -> DataFrame:
    """Prose in word windows of ``size`` with ``overlap``."""
    keep = [c for c in docs.columns if c != body]
    windows = text.overlap_windows(F.col(body), size, overlap)
    return docs.select(*keep, F.posexplode(windows).alias("chunk_index", body))


def page_chunks(parts: DataFrame, body: str = "text") -> DataFrame:
    """Document parts (``filename, chunk_index, text``); blank ones dropped."""
    return (
        parts.filter(~text.is_blank(F.col(body)))
        .withColumn("allowed_groups", access.strings(access.PUBLIC))
    )


def table_chunks(
    rows: DataFrame, bucket: Column, budget: int = 500, header: str | None = None
) -> DataFrame:
    """Pack table rows (``filename, row_no, row_text``) into chunks of about ``budget`` characters.

    A row belongs to chunk ``floor(characters before it / budget)``; each row counts its length
    plus a line end, so a chunk holds at most ``budget`` rows however the table grows. Chunks are
    numbered without gaps. ``header`` names a column repeated on top of every chunk.
    """
    sized = rows.withColumn("__size", (F.length("row_text") + 1).cast("bigint"))
    placed = with_running(
        sized, ["filename"], ["row_no"], bucket,
        exclusive={"__before": ("sum", F.col("__size"))},
    ).withColumn("__slot", F.floor(F.col("__before") / budget))
    extra = [F.first(header).alias("__head")] if header else []
    packed = placed.groupBy("filename", "__slot").agg(
        F.min("row_no").alias("first_row"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("row_no", "row_text"))),
                lambda r: r["row_text"],
            ),
            "\n",
        ).alias("text"),
        *extra,
    )
    if header:
        packed = packed.withColumn("text", F.concat("__head", F.lit("\n"), "text"))
    numbered = with_running(
        packed, ["filename"], ["__slot"], F.shiftright("__slot", 16),
        exclusive={"chunk_index": ("sum", F.lit(1))},
    )
    return numbered.select(
        "filename", "chunk_index", "text",
        access.filename_groups(F.col("filename")).alias("allowed_groups"),
    )


def whole_table_chunks(
    rows: DataFrame, bucket: Column, rows_per_part: int | None = None
) -> DataFrame:
    """A table (``filename, header, row_no, row_text``) as one Markdown chunk, ``part`` 0.

    With ``rows_per_part`` longer tables go on in further parts, the header repeated.
    """
    if rows_per_part is None:
        placed = rows.withColumn("part", F.lit(0))
    else:
        placed = with_running(
            rows, ["filename"], ["row_no"], bucket,
            exclusive={"__nth": ("sum", F.lit(1))},
        ).withColumn("part", F.floor(F.col("__nth") / rows_per_part).cast("int"))
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("row_no", "row_text"))), lambda r: r["row_text"]
    )
    return placed.groupBy("filename", "part").agg(
        F.concat(F.first("header"), F.lit("\n"), F.array_join(lines, "\n")).alias("text")
    )


def sessionize(
    messages: DataFrame, channel: str = "channel", ts: str = "ts", tie: str = "pos",
    gap_seconds: int = 600, bucket_seconds: int = 86400,
) -> DataFrame:
    """Number the threads of every channel: a gap of ``gap_seconds`` or more starts a new one.

    Adds ``thread_no`` (from 0) and ``nth`` (position inside the thread, from 0). Long channels
    are split over time buckets, so no task ever sorts a whole channel.
    """
    bucket = time_bucket(F.col(ts), bucket_seconds)
    at = micros(F.col(ts))
    linked = with_running(
        messages, [channel], [ts, tie], bucket,
        inclusive={"__seq": ("sum", F.lit(1))},
        exclusive={"__last": ("max", at)},
    )
    starts = F.col("__last").isNull() | (at - F.col("__last") >= gap_seconds * 1000000)
    flagged = linked.withColumn("__start", starts)
    threaded = with_running(
        flagged, [channel], [ts, tie], bucket,
        inclusive={
            "__threads": ("sum", F.col("__start").cast("bigint")),
            "__first": ("max", F.when(F.col("__start"), F.col("__seq"))),
        },
    )
    return threaded.select(
        *messages.columns,
        (F.col("__threads") - 1).alias("thread_no"),
        (F.col("__seq") - F.col("__first")).alias("nth"),
    )


def thread_chunks(
    threads: DataFrame, channel: str = "channel", user: str = "user", body: str = "text",
    per_part: int | None = None,
) -> DataFrame:
    """Join each thread's ``User u: text`` lines in order, as ``part`` 0.

    With ``per_part`` longer threads go on in further parts, which belong to a chunk's key.
    """
    part = F.lit(0) if per_part is None else F.floor(F.col("nth") / per_part).cast("int")
    line = F.concat(F.lit("User "), F.col(user), F.lit(": "), F.col(body))
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("nth"), line.alias("line")))),
        lambda m: m["line"],
    )
    return (
        threads.withColumn("part", part)
        .groupBy(channel, F.col("thread_no").alias("chunk_index"), "part")
        .agg(F.array_join(lines, "\n").alias("text"), F.count("*").alias("n_messages"))
        .withColumn("allowed_groups", access.strings(access.PUBLIC))
    )
