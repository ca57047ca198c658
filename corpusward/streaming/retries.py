"""Ingest that tries failed files again by itself, and takes requests to replay dead letters.

One query reads three streams: landed files, the store's own rejects, and requests. Files go into the
next batch of ``plans/corpus.py`` at once. Rejects meet the state of their file, which is kept with that of
the other files of its hash shard, and a processing-time timer of the shard: when the file's wait is over
(``2**attempt`` seconds, capped) it is read again and goes into whichever batch runs then. If that fails too, its new reject comes back with the next attempt, until after
``max_retries`` it becomes a dead letter. A request lets a file begin anew.

All of a batch, dead letters included, counts once its commit marker is there, and a replayed batch
sees the times of the first run, so nothing is tried or buried twice. Nothing stored is rewritten:
the status of a dead letter follows from the requests and documents that came after it.

Defined results: of several rejects of a file and attempt the first by message counts, those of older
attempts are ignored; a file that is gone by its next attempt fails with "cannot be read"; rejects
that concern one message of a file that was read are not tried again. The trigger must run on time
(``availableNow`` never ends while timers may fire), and state must be in RocksDB, see
``threads.STATE_SETTINGS``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusward.operators.admin import BACKOFF_CAP_SECONDS, MAX_RETRIES
from corpusward.plans import corpus
from corpusward.session import cut, exists, release, scratch_path
from corpusward.sources import readers

REQUESTS = "filepath STRING, source_type STRING, requested_at TIMESTAMP"
_EVENT = ["filepath", "source_type", "error_message", "attempt"]
_OUT = "path STRING, source_type STRING, error_message STRING, attempt INT, kind STRING, at_ms BIGINT"
# A batch saves what changed in the state, not the state's files of every partition.
CHANGES_ONLY = ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
PATHS = 1000  # paths listed in one scan
SHARDS = 1024  # groups of files, by hash of their paths, whose state is one value


class Attempts(StatefulProcessor):
    """Rejects and requests of a shard's files in; ``due`` attempts and ``dead`` letters out.

    The state of a shard's files is read and written as one value, so what a batch costs follows from
    the files in it and not from calls per file.
    """

    def __init__(self, max_retries: int, cap_seconds: int, second_ms: int) -> None:
        self.max_retries, self.cap_seconds, self.second_ms = max_retries, cap_seconds, second_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # JSON: of each file its newest attempt, source, error, and the time it waits for or null
        self.files = handle.getValueState("files", "files STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        newest, asked = {}, {}
        for frame in rows:
            for path, source, error, attempt in frame[_EVENT].itertuples(index=False, name=None):
                if attempt < 0:
                    asked[path] = source
                elif path not in newest or (-attempt, error) < (-newest[path][0], newest[path][2]):
                    newest[path] = int(attempt), source, error
        known, out, timers = self._known(), [], set()
        for path, (attempt, source, error) in newest.items():
            if path in known and attempt <= known[path][0]:
                continue
            due = None
            if attempt >= self.max_retries:
                out.append((path, source, error, attempt, "dead"))
            else:
                due = now + min(self.cap_seconds, 2 ** attempt) * self.second_ms
                timers.add(due)
            known[path] = attempt, source, error, due
        for path, source in asked.items():
            known.pop(path, None)  # a timer that finds no file waiting does nothing
            out.append((path, source, None, 0, "due"))
        self.files.update((json.dumps(list(known.items())),))
        for due in timers:
            self.handle.registerTimer(due)
        yield from self._rows(out, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known, out = self._known(), []
        for path, (attempt, source, error, due) in known.items():
            if due is not None and due <= now:
                known[path] = attempt, source, error, None
                out.append((path, source, error, attempt + 1, "due"))
        if out:
            self.files.update((json.dumps(list(known.items())),))
        yield from self._rows(out, now)

    def _known(self) -> dict:
        stored = self.files.get()  # null where there is none: one call instead of two
        return dict(json.loads(stored[0])) if stored else {}

    def _rows(self, out: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        if out:
            rows = pd.DataFrame(out, columns=["path", "source_type", "error_message", "attempt", "kind"])
            yield rows.assign(at_ms=now)


def read_again(spark: SparkSession, due: DataFrame) -> DataFrame:
    """``(path, value, modified)`` of the files ``due(path)`` that are still there.

    Only their folders are listed, and only they are read; paths pass the driver in groups.
    """
    place = scratch_path(spark, "again")
    schema = "path STRING, value STRING, modified TIMESTAMP"
    spark.createDataFrame([], schema).write.parquet(place)
    paths = (row.path for row in due.select("path").distinct().toLocalIterator())
    while group := list(islice(paths, PATHS)):
        folders = {unquote(path.rsplit("/", 1)[0]) for path in group}
        there = ["".join(f"\\{c}" if c in "{}[]*?\\" else c for c in f) for f in folders if exists(spark, f)]
        if there:
            files = spark.read.option("wholetext", True).text(there).filter(F.col("_metadata.file_path").isin(group))
            files.select(
                F.col("_metadata.file_path").alias("path"), "value",
                F.col("_metadata.file_modification_time").alias("modified"),
            ).write.mode("append").parquet(place)
    found = spark.read.schema(schema).parquet(place)
    found.scratch = place
    return found


def _small_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def request_replay(store: corpus.Store, letters: DataFrame) -> None:
    """Ask for files of ``letters(filepath, source_type)`` to be ingested again."""
    letters.select("filepath", "source_type", F.current_timestamp().alias("requested_at")).write.mode(
        "append").parquet(f"{store.root}/requests")


def dead_letters(store: corpus.Store) -> DataFrame:
    """``(filepath, source_type, error_message, retry_count, status, created_at)``.

    ``RESOLVED`` once a later batch holds the file's document, ``RETRIED`` once it was asked for
    again, else ``FAILED``.
    """
    spark, requests = store.spark, f"{store.root}/requests"
    spark.createDataFrame([], REQUESTS).write.mode("ignore").parquet(requests)
    asked = spark.read.schema(REQUESTS).parquet(requests).groupBy("filepath").agg(F.max("requested_at").alias("__asked"))
    stored = store.table("documents", ids=True).groupBy("filepath").agg(F.max("batch_id").alias("__stored"))
    status = (
        F.when(F.col("__stored") > F.col("batch_id"), "RESOLVED")
        .when(F.col("__asked") >= F.col("created_at"), "RETRIED").otherwise("FAILED")
    )
    return (
        store.table("dead", ids=True).join(asked, "filepath", "left").join(stored, "filepath", "left")
        .select("filepath", "source_type", "error_message", "retry_count", status.alias("status"), "created_at")
    )


def ingest_stream(
    files: DataFrame, store_root: str, checkpoint: str, root: str | None = None,
    again: Callable[[SparkSession, DataFrame], DataFrame] = read_again, max_retries: int = MAX_RETRIES,
    cap_seconds: int = BACKOFF_CAP_SECONDS, second_ms: int = 1000, trigger: str = "1 second", **options,
) -> StreamingQuery:
    """Landed ``files`` (see ``readers.landed``, of the same ``root``) into the store, with retries.

    ``again(spark, due)`` reads files a second time; ``due`` has ``path`` and ``attempt``.
    ``second_ms`` is the length of a second of waiting. Runs until it is stopped.
    """
    spark = files.sparkSession
    store = corpus.Store(spark, store_root)
    dead_letters(store)
    store.table("rejects")
    spark.conf.set(*CHANGES_ONLY)
    rejects = _small_stream(spark, f"{store.root}/rejects", corpus.TABLES["rejects"]).filter(
        ~F.col("error_message").startswith(corpus.PARTIAL)).select(_EVENT)
    requests = _small_stream(spark, f"{store.root}/requests", REQUESTS).select(
        "filepath", "source_type", F.lit(None).cast("string").alias("error_message"), F.lit(-1).alias("attempt"))
    told = rejects.unionByName(requests).withColumn("shard", F.pmod(F.xxhash64("filepath"), F.lit(SHARDS)))
    events = told.groupBy("shard").transformWithStateInPandas(
        Attempts(max_retries, cap_seconds, second_ms), _OUT, "append", "ProcessingTime")
    arrived = files.withColumn("kind", F.lit("file")).withColumn("attempt", F.lit(0))
    everything = arrived.unionByName(events, allowMissingColumns=True)

    def each(batch: DataFrame, batch_id: int) -> None:
        own = corpus.Store(spark, store_root)  # a stream with state has a session without adaptive plans
        if batch_id in own.committed():
            return
        batch = cut(batch, spark)
        kinds = {row[0] for row in batch.select("kind").distinct().collect()}  # three at most
        if not kinds:
            release(batch)
            return
        rows, found = batch.filter("kind = 'file'").select("path", "source_type", "filename", "value", "modified", "attempt"), None
        if "due" in kinds:
            due = batch.filter("kind = 'due'").select("path", "attempt")
            found = again(own.spark, due)
            late = readers.landed(due.join(found, "path", "left"), root).join(due, "path")
            rows = rows.unionByName(late)
        if "dead" in kinds:
            own.write("dead", batch_id, batch.filter("kind = 'dead'").select(
                F.col("path").alias("filepath"), "source_type", "error_message", F.col("attempt").alias("retry_count"),
                F.timestamp_millis("at_ms").alias("created_at")))
        else:
            own.clear(batch_id, "dead")
        corpus.ingest_batch(own, rows, batch_id, **options)
        release(batch, found)

    return (
        everything.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(processingTime=trigger).start()
    )
