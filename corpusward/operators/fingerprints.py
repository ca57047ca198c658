"""Fingerprints of stored chunks, kept between loads and looked up, never joined as a whole.

A load writes its kept chunks' word sets and prefix blocks below ``batch_id``, each in folders by
shard: sets by key, blocks by block. A later load knows which shards its own blocks fall into and
reads only those; of the sets it reads the shards of the candidates. Equal word sets meet in a block
of their own, made from their print. The order of words that prefixes need is stored by the first
load and used by all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.operators import dedup
from corpusward.session import cut, exists, release, remove

SHARDS = 64
SETS = (
    "key BIGINT, words ARRAY<BIGINT>, n INT, print STRING, owner BIGINT, version BIGINT, "
    "batch_id BIGINT, shard INT"
)
BLOCKS = "block BIGINT, key BIGINT, n INT, pos INT, batch_id BIGINT, shard INT"
# The place of print blocks: their sets are equal, whatever their size.
EQUAL = -1


def shard(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SHARDS)).cast("int")


def blocks(sets: DataFrame, threshold: float, order: list[int]) -> DataFrame:
    """Prefix blocks, and the block of each print."""
    equal = sets.select(
        F.xxhash64("print").alias("block"), "key", F.col("n").cast("int").alias("n"), F.lit(EQUAL).alias("pos")
    )
    return dedup.blocks_from_prefixes(sets, threshold, order).unionByName(equal)


def _write(df: DataFrame, path: str, batch_id: int, by: str) -> None:
    # rows of a shard meet first: a load has one file a shard, not one a shard and task
    writer = df.withColumn("shard", shard(F.col(by))).repartition("shard").write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "static").partitionBy("shard")
    writer.parquet(f"{path}/batch_id={batch_id}")


def forget(spark: SparkSession, state: str, batch_id: int) -> None:
    """Remove what a load that stores nothing may have left when it ran before."""
    for name in ("blocks", "sets"):
        remove(spark, f"{state}/{name}/batch_id={batch_id}")


def any_stored(spark: SparkSession, state: str) -> bool:
    """Whether any load has stored word sets."""
    return exists(spark, f"{state}/sets") and exists(spark, f"{state}/blocks")


def word_order(spark: SparkSession, state: str, sets: DataFrame) -> list[int]:
    """The stored order; the first load's frequent words if there is none yet."""
    path = f"{state}/order"
    if exists(spark, f"{path}/_SUCCESS"):
        return [row["word"] for row in sorted(spark.read.schema("place INT, word BIGINT").parquet(path).collect())]
    order = dedup.word_order(sets)
    rows = spark.createDataFrame(list(enumerate(order)), "place INT, word BIGINT")
    rows.coalesce(1).write.mode("overwrite").parquet(path)
    return order


def remember(
    spark: SparkSession, sets: DataFrame, state: str, batch_id: int, threshold: float = dedup.THRESHOLD
) -> None:
    """Store the word sets of a load; a repeated load replaces what it stored before.

    ``owner`` and ``version``, numbers of a chunk's document, are stored where ``sets`` has them.
    """
    order = word_order(spark, state, sets)
    _write(blocks(sets, threshold, order), f"{state}/blocks", batch_id, "block")
    named = [
        (F.col(c) if c in sets.columns else F.lit(None)).cast("bigint").alias(c) for c in ("owner", "version")
    ]
    plain = sets.select("key", "words", F.col("n").cast("int").alias("n"), "print", *named)
    _write(plain, f"{state}/sets", batch_id, "key")


def _stored(spark: SparkSession, path: str, schema: str, batches: Column, shards: list[int]) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter(batches & F.col("shard").isin(shards)).drop("shard", "batch_id")


def _shards_of(rows: DataFrame, column: str) -> list[int]:
    """The shards that occur; at most ``SHARDS`` numbers."""
    return sorted(row[0] for row in rows.select(shard(F.col(column))).distinct().collect())


def matches(
    spark: SparkSession, fresh: DataFrame, state: str, batches: Column,
    threshold: float = dedup.THRESHOLD, alive: Callable[[DataFrame], DataFrame] = lambda known: known,
) -> DataFrame:
    """``(key, kept_key, jaccard)``: the smallest stored chunk each fresh one duplicates.

    ``fresh`` are word sets; ``batches`` says which loads count, by ``batch_id``; ``alive`` takes the
    candidates among the stored sets and gives back those that count. Only shards that the fresh
    sets hit are read.
    """
    made_here = None if hasattr(fresh, "scratch") else cut(fresh)
    fresh = made_here or fresh
    firsts = dedup.exact_first(fresh)
    distinct = fresh.join(firsts, "key", "left_semi")
    order = word_order(spark, state, fresh)
    mine = cut(blocks(fresh, threshold, order).join(firsts, "key", "left_semi"))
    met = mine.join(dedup.first_of_pair(
        _stored(spark, f"{state}/blocks", BLOCKS, batches, _shards_of(mine, "block"))
    ), "block")
    equal = met.filter((F.col("pos") == EQUAL) & (F.col("__pos") == EQUAL))
    others = dedup.possible(met.filter((F.col("pos") >= 0) & (F.col("__pos") >= 0)), threshold)
    pairs = cut(
        equal.select("first", F.col("key").alias("later"), F.lit(True).alias("print"))
        .unionByName(others.select("first", F.col("key").alias("later"), F.lit(False).alias("print")))
        .groupBy("first", "later").agg(F.max("print").alias("print"))
    )
    stored = _stored(spark, f"{state}/sets", SETS, batches, _shards_of(pairs, "first"))
    likely = dedup.plausible(pairs.filter(~F.col("print")), stored, fresh, threshold)
    candidates = pairs.filter("print").select("first").unionByName(likely.select("first")).distinct()
    known = cut(alive(dedup.picked(stored, candidates.withColumnRenamed("first", "key"))))
    near = dedup.verify_pairs(likely, known, fresh, threshold)
    # a block is a hash: equal prints are compared themselves
    same = (
        pairs.filter("print").join(known.select(F.col("key").alias("first"), F.col("print").alias("__p")), "first")
        .join(distinct.select(F.col("key").alias("later"), F.col("print").alias("__q")), "later")
        .filter(F.col("__p") == F.col("__q")).select("first", "later", F.lit(1.0).alias("jaccard"))
    )
    best = near.unionByName(same).groupBy("later").agg(
        F.min(F.struct(F.col("first").alias("kept_key"), "jaccard")).alias("m")
    )
    found = cut(dedup.to_copies(fresh, distinct, best.select("later", "m.kept_key", "m.jaccard")))
    release(mine, pairs, likely, known, made_here)
    return found
