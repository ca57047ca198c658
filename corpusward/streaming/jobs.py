"""Structured Streaming jobs. Each runs on whatever the file source delivers next.

Batch functions are reused inside ``foreachBatch``; their outputs are keyed by the batch id, so a
replayed batch overwrites its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusward.operators import admin, dedup, fingerprints
from corpusward.session import cut, release


def table_stream(
    spark: SparkSession, path: str, schema, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream over a Parquet table: a folder, or a single file matched by a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Work off everything available, one call of ``each`` per micro-batch."""
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store a micro-batch's output under its id."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def ingest_stream(
    stream: DataFrame, ingest: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Every new file goes through the batch ingest function."""
    return run_batches(stream, lambda df, i: write_batch(ingest(df), out, i), checkpoint)


def sessions(messages: DataFrame, channel: str = "channel", ts: str = "ts",
             gap_seconds: int = 600, lateness: str = "10 minutes") -> DataFrame:
    """Closed threads of a live message stream.

    ``session_window`` also joins messages exactly one gap apart, so the gap is a microsecond
    shorter, which makes it strict. Rows later than the watermark are dropped by Spark.
    """
    gap = f"{gap_seconds - 1}.999999 seconds"
    return (
        messages.withWatermark(ts, lateness)
        .groupBy(F.session_window(ts, gap).alias("w"), channel)
        .agg(F.count("*").alias("n_messages"), F.max(ts).alias("last_ts"))
        .select(channel, F.col("w.start").alias("first_ts"), "last_ts", "n_messages")
    )


def dedup_batch(
    spark: SparkSession, batch: DataFrame, batch_id: int, state: str, out: str,
    key: str = "chunk_key", body: str = "text", threshold: float = dedup.THRESHOLD,
) -> None:
    """Drop chunks that duplicate a chunk kept in an earlier batch, then within the batch.

    ``state`` holds the fingerprints of kept chunks per batch, written after the chunks: a batch
    that dies half way is repeated against the same earlier state. Only the shards of the state that
    the batch hits are read.
    """
    sets = cut(dedup.word_sets(batch, key, body))
    fresh = sets
    if batch_id:
        known = fingerprints.matches(spark, sets, state, F.col("batch_id") < batch_id, threshold)
        fresh = cut(sets.join(known.select("key"), "key", "left_anti"))
    kept, made = dedup.kept_keys(fresh, threshold)
    write_batch(dedup.picked(batch, kept.withColumnRenamed("key", key), key), out, batch_id)
    fingerprints.remember(spark, dedup.picked(fresh, kept), state, batch_id, threshold)
    release(sets, fresh, kept, made)


def dedup_stream(
    spark: SparkSession, stream: DataFrame, state: str, out: str, checkpoint: str, **options
) -> StreamingQuery:
    return run_batches(
        stream, lambda df, i: dedup_batch(spark, df, i, state, out, **options), checkpoint
    )


def retry_stream(stream: DataFrame, retry_out: str, dlq_out: str, checkpoint: str) -> StreamingQuery:
    """Failures with retries left go to the retry table, the others to the dead letters."""

    def each(df: DataFrame, batch_id: int) -> None:
        write_batch(admin.retries(df), retry_out, batch_id)
        write_batch(admin.dead_letters(df), dlq_out, batch_id)

    return run_batches(stream, each, checkpoint)


def rate_report(requests: DataFrame, limit: int, caller: str = "caller",
                lateness: str = "1 minute") -> DataFrame:
    """Callers over the limit per closed minute."""
    return (
        requests.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 minute").alias("w"), caller)
        .agg(F.count("*").alias("n_requests"))
        .filter(F.col("n_requests") > limit)
        .select(F.col("w.start").alias("minute"), caller, "n_requests")
    )
