"""Table writers: snapshots, upserts, appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.session import cut, release, remove


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def upserted(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``incoming`` plus the existing rows whose key is not among them."""
    rest = existing.join(incoming.select(*key), key, "left_anti")
    return incoming.unionByName(rest, allowMissingColumns=True)


SHARDS = 64


def _shard_column(columns: list[str]) -> str | None:
    """A table's shard column, whose name tells how many shards there are."""
    return next((c for c in columns if c.startswith("shard_of_")), None)


def settled(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``, ties by the rest of the row as JSON."""
    rest = [c for c in rows.columns if c not in key]
    place = F.struct(*order, F.to_json(F.struct(*rest)))
    kept = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), place).alias("__row"))
    return kept.select(*key, "__row.*").select(*rows.columns)


def write_chunk_index(
    spark: SparkSession, incoming: DataFrame, path: str, key: list[str],
    partition_by: str = "source_type", exists: bool = True, order: tuple[str, ...] = (),
    shards: int = SHARDS,
) -> None:
    """Upsert into a table partitioned by ``partition_by`` and, below it, a hash shard of the key.

    The shard follows from the key alone, so a key is looked for in its shard of every
    ``partition_by`` value: only those folders are read, and of them only the ones that receive rows
    or held one of them before are rewritten; one that is left without rows goes. Of incoming rows
    with equal keys the last by ``order`` is written, ties by the row's contents. The new contents
    are checkpointed before the write, so no file is read while it is being replaced and a lost task
    can be run again. ``shards`` counts when the table is made; the table remembers it.
    """
    shard = f"shard_of_{shards}"
    if exists:
        held = spark.read.parquet(path)
        shard = _shard_column(held.columns)
        shards = int(shard.rsplit("_", 1)[1])
    incoming = settled(incoming, key, list(order)).withColumn(
        shard, F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))
    place = [partition_by, shard]
    if not exists:
        incoming.repartition(*place).write.mode("overwrite").partitionBy(*place).parquet(path)
        return
    incoming = cut(incoming)
    hit = [row[0] for row in incoming.select(shard).distinct().collect()]  # at most ``shards`` numbers
    held = held.filter(F.col(shard).isin(hit))
    left = held.select(*place, *key).join(incoming.select(*key), key, "left_semi")
    touched = cut(incoming.select(*place).unionByName(left.select(*place)).distinct())
    existing = held.join(F.broadcast(touched), place, "left_semi")  # at most shards x partitions rows
    merged = cut(upserted(existing, incoming, key))
    emptied = touched.join(merged.select(*place).distinct(), place, "left_anti").collect()
    (
        merged.repartition(*place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*place).parquet(path)
    )
    for row in emptied:
        remove(spark, f"{path}/{partition_by}={row[0]}/{shard}={row[1]}")
    release(incoming, touched, merged)


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """The table as it was written, without its shard."""
    rows = spark.read.parquet(path)
    return rows.drop(_shard_column(rows.columns) or "")


def write_snapshot(df: DataFrame, root: str, snapshot: str) -> str:
    """A full copy under a new name; readers switch to it when it is complete."""
    path = f"{root.rstrip('/')}/{snapshot}"
    df.write.mode("errorifexists").parquet(path)
    return path
