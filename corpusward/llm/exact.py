"""Exact duplicates with a keyed, disk-backed streaming state.

1. Every row *arrives* as ``(id, digest, file, row)``: SHA-256 of its whole text, its stable id, and
   the content locator, the file and row where the text lies. Texts stay where they are.
2. A Structured Streaming query keeps one state entry per digest in RocksDB, never expired: how
   many rows arrived and the one that stays (largest id, of repeated ids the one with the largest
   locator). Arrivals are combined before they reach the state, so a digest with a third of all
   rows costs one update per task. Restarting the query on the same checkpoint goes on where it
   stopped; new arrivals meet everything seen before.
3. The state is read as a table. Rows of digests seen more than once are *hits*: their texts are
   fetched by locator and compared byte for byte, as smallest and largest text per digest, again
   combined before the shuffle. Where these differ the digest lies, and its rows are grouped by
   their texts instead.

All steps are DataFrame operations of the JVM; the stream has no Python in it.

Defined results: null counts as the empty text; a null id is smaller than any other; of equal texts
with equal ids one row stays; an empty table gives an empty result; columns other than id and text
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.llm.rows import PLACE, located
from corpusward.llm.words import whole
from corpusward.operators.skew import join_hot
from corpusward.session import cut, scratch_path

# A digest with this share of all rows is a hot join key; at most 1 / HOT_SHARE are.
HOT_SHARE = 0.001
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # else every partition of the state reserves several megabytes before it holds anything
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def arrivals(rows: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """``(id, digest, file, row)`` of located rows."""
    return rows.select(
        F.col(key).alias("id"), F.sha2(whole(F.col(body)), 256).alias("digest"),
        F.col("__file").alias("file"), F.col("__row").alias("row"),
    )


def _state_session(spark: SparkSession) -> SparkSession:
    """A session of its own for the state's settings, in the same application."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for name, value in STATE_SETTINGS.items():
        own.conf.set(name, value)
    return own


def absorb(spark: SparkSession, source: str, schema, checkpoint: str) -> None:
    """Feed all arrivals below ``source`` that the state at ``checkpoint`` has not seen yet."""
    own = _state_session(spark)
    state = (
        own.readStream.schema(schema).parquet(source)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max(F.struct("id", "file", "row")).alias("stays"))
    )
    (
        state.writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .start().awaitTermination()
    )


def known(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table ``(digest, n, id, file, row)``: one row per digest ever seen."""
    state = _state_session(spark).read.format("statestore").load(checkpoint)
    rows = state.select("key.*", "value.*").toDF("digest", "n", "stays")
    path = scratch_path(spark, "known")
    rows.select("digest", "n", "stays.*").write.parquet(path)
    return spark.read.parquet(path)


def _assigned(arrived: DataFrame, state: DataFrame) -> DataFrame:
    """Every arrival with its digest's ``(n, keep_id, keep_file, keep_row)``."""
    total = arrived.select(F.count("*")).scalar()
    keepers = state.select(
        "digest", "n", F.col("id").alias("keep_id"), F.col("file").alias("keep_file"),
        F.col("row").alias("keep_row"),
        (F.col("n") >= F.greatest(total * HOT_SHARE, F.lit(1000))).alias("__hot"),
    )
    spread = F.concat(F.col("file"), F.col("row").cast("string"))
    return join_hot(arrived, keepers, "digest", F.col("__hot"), spread).drop("__hot")


def _texts(rows: DataFrame, hits: DataFrame, body: str) -> DataFrame:
    """The hits with their whole texts, fetched by locator."""
    content = rows.select(
        F.col("__file").alias("file"), F.col("__row").alias("row"), whole(F.col(body)).alias("text")
    )
    return content.join(hits, ["file", "row"])


def _by_text(rows: DataFrame, hits: DataFrame, false: DataFrame, body: str) -> DataFrame:
    """Hits of digests that different texts share, grouped by text."""
    texts = cut(_texts(rows, hits.join(false.select("digest"), "digest", "left_semi"), body))
    groups = texts.groupBy("text").agg(
        F.count("*").alias("n"), F.max(F.struct("id", "file", "row")).alias("stays")
    )
    return texts.drop("n", "keep_id", "keep_file", "keep_row").join(groups, "text").select(
        "id", "digest", "file", "row", "n", F.col("stays.id").alias("keep_id"),
        F.col("stays.file").alias("keep_file"), F.col("stays.row").alias("keep_row"),
    )


def groups(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(id, digest, file, row, n, keep_id, keep_file, keep_row)``."""
    return _groups(located(docs), key, body)


def _groups(rows: DataFrame, key: str, body: str, digests=arrivals) -> DataFrame:
    spark = rows.sparkSession
    arrived = cut(digests(rows, key, body))
    checkpoint = scratch_path(spark, "state")
    absorb(spark, arrived.scratch, arrived.schema, checkpoint)
    assigned = _assigned(arrived, known(spark, checkpoint))
    hits = assigned.filter(F.col("n") > 1)
    differ = (
        _texts(rows, hits.select("file", "row", "digest"), body).groupBy("digest")
        .agg((F.min("text") != F.max("text")).alias("differ"))
        .filter("differ")
    )
    false = cut(differ)
    if false.isEmpty():
        return assigned
    true = assigned.join(false.select("digest"), "digest", "left_anti")
    return true.unionByName(_by_text(rows, hits, false, body))


def _stays():
    return F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))


def duplicates(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``: one row per row of ``docs``."""
    return groups(docs, key, body).select(
        F.col("id").alias(key), "keep_id", F.col("n").alias("group_size"),
        _stays().alias("kept"), F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts."""
    rows = located(docs)
    gone = _groups(rows, key, body).filter(~_stays()).select(
        F.col("file").alias("__file"), F.col("row").alias("__row")
    )
    return rows.join(gone, PLACE, "left_anti").select(*docs.columns)
