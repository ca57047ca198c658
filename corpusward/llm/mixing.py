"""Mixing sources to target weights by Pareto order sampling.

1. *Targets.* Sources share a budget in proportion to their weights; no target exceeds
   ``max_copies`` times its source's size. The excess is shared again by weight until none is above,
   computed at once as the water level over sources sorted by size per weight.
2. *Certain copies.* Every document is taken ``floor(target / source size)`` times.
3. *Pareto order sampling* for the rest of a source's target. A document with inclusion probability
   ``p`` gets rank ``odds(u) / odds(p)``, ``u`` being uniform and fixed by id and seed. Documents are
   taken in rank order until their words reach the rest; the one at the cut is taken if that comes
   nearer to it. ``p`` is the rest's share of the source, times the document's own weight over the
   source's mean where a weight column is given (certain documents have rank zero).

A source's ranks are not sorted in one place: they are dealt to rank buckets, whose sums tell in
which bucket the cut lies, and only that bucket is sorted. The number of buckets follows the number
of rows, so a bucket stays small however hot its source is. Sources enter joins as one row each; hot
ones are broadcast (at most ``1 / HOT_SHARE``). The only unpartitioned window is over sources.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a null
id draws like an id of its own; of rows with the same id and size, which draw alike, any may be
taken; documents of size 0 take nothing and are in no mix, so a corpus without words has an empty
one; an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusward.llm.rows import PLACE, located
from corpusward.llm.words import n_words
from corpusward.operators.skew import join_hot
from corpusward.session import cut

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 10
BUCKET_ROWS = 50_000
LEAST_BUCKETS = 256
HOT_SHARE = 0.001
_BITS = 52


def sized(
    docs: DataFrame, key: str = "doc_id", body: str = "text", source: str = "source",
    weight: str | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, source, size, weight, *keep)``."""
    return docs.select(
        F.col(key).alias("id"), F.col(source).cast("string").alias("source"),
        n_words(F.col(body)).alias("size"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        *keep,
    )


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def targets(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES
) -> DataFrame:
    """Per source ``(source, n_docs, source_size, mean_weight, target)``.

    ``weights`` repeat over the sources in code-point order, null last.
    """
    sizes = rows.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("size").alias("source_size"),
        F.sum(F.col("weight") * F.col("size")).alias("__weighted"),
    )
    order = W.orderBy(F.asc_nulls_last("source"))
    share = F.element_at(
        F.array(*[F.lit(w) for w in weights]).cast("array<bigint>"),
        ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"),
    )
    shared = sizes.select("*", share.alias("__w"), (F.col("source_size") * max_copies).alias("__cap"))
    filling = W.orderBy(F.col("__cap") / F.col("__w"), F.asc_nulls_last("source"))
    before, everything = filling.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    zero = F.lit(0).cast("bigint")
    level = shared.select(
        "*",
        F.row_number().over(filling).alias("__k"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), zero))
        .alias("__left"),
        (F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), zero))
        .alias("__open"),
    )
    free = F.col("__left") * F.col("__w") <= F.col("__cap") * F.col("__open")
    first = F.min(F.when(free, F.struct("__k", "__left", "__open"))).over(everything)
    even = (F.col("__w") * F.col("__first.__left")).cast("double") / F.col("__first.__open")
    return level.withColumn("__first", first).select(
        "source", "n_docs", "source_size",
        F.when(F.col("source_size") > 0, F.col("__weighted") / F.col("source_size"))
        .otherwise(F.lit(1.0)).alias("mean_weight"),
        F.when(F.col("__k") < F.col("__first.__k"), F.col("__cap").cast("double"))
        .otherwise(even).alias("target"),
    )


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number strictly between 0 and 1, fixed by key and seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.md5(text), 1, _BITS // 4), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(1 << _BITS))


def pareto_rank(u: Column, p: Column) -> Column:
    """``odds(u) / odds(p)``; zero for certain documents, infinite for impossible ones."""
    return (
        F.when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(float("inf")))
        .otherwise((u / (1 - u)) / (p / (1 - p)))
    )


def sample(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES,
    seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``rows`` (from ``sized``) with ``source_size, target, copies``."""
    keep = [c for c in rows.columns if c != "weight"]
    rows = cut(rows)
    per_source = cut(targets(rows, weights, max_copies).withColumn("__source", _source_key()))
    total = per_source.select(F.coalesce(F.sum("n_docs"), F.lit(0))).scalar()
    hot = F.col("n_docs") >= F.greatest(total * HOT_SHARE, F.lit(1000))

    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(max_copies))).otherwise(0)
    plan = per_source.withColumn("__whole", whole.cast("bigint")).withColumn(
        "__rest", F.greatest(F.col("target") - F.col("__whole") * size, F.lit(0.0))
    )
    p = F.when(
        size > 0,
        F.col("__rest") / size * F.col("weight")
        / F.when(F.col("mean_weight") > 0, F.col("mean_weight")).otherwise(F.lit(1.0)),
    ).otherwise(F.lit(0.0))
    rank = F.col("__rank")
    buckets = F.greatest(F.lit(LEAST_BUCKETS), F.ceil(total / F.lit(bucket_rows))).cast("bigint")
    keyed = rows.withColumn("__source", _source_key())
    ranked = cut(
        join_hot(
            keyed,
            plan.select("__source", "source_size", "target", "mean_weight", "__whole", "__rest",
                        hot.alias("__hot")),
            "__source", F.col("__hot"), F.col("id"),
        )
        .withColumn("__rank", pareto_rank(uniform(F.col("id"), seed), p))
        # documents that can't be taken once more stand behind all buckets and are never sorted
        .withColumn("__bucket", F.when(
            (rank < float("inf")) & (F.col("size") > 0),
            F.least(F.floor(rank / (1 + rank) * buckets), buckets - 1),
        ).otherwise(buckets))
        .drop("weight", "mean_weight", "__hot")
    )

    sums = ranked.filter(F.col("__bucket") < buckets).groupBy("__source", "__bucket").agg(
        F.sum("size").alias("__words"), F.max("__rest").alias("__rest")
    )
    so_far = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    filled = sums.withColumn("__base", F.coalesce(F.sum("__words").over(so_far), F.lit(0)))
    crossing = filled.filter(F.col("__base") + F.col("__words") > F.col("__rest")).groupBy(
        "__source"
    ).agg(F.min(F.struct("__bucket", "__base")).alias("__cut"))
    found = per_source.join(crossing, "__source", "left").select(
        "__source", F.coalesce("__cut.__bucket", buckets).alias("__at"),
        F.coalesce("__cut.__base", F.lit(0)).alias("__base"), hot.alias("__hot"),
    )
    placed = join_hot(ranked, cut(found), "__source", F.col("__hot"), F.col("id"))

    columns = [*keep, "source_size", "target"]
    at_cut = (F.col("__bucket") == F.col("__at")) & (F.col("__bucket") < buckets)
    once_more = (F.col("__bucket") < F.col("__at")).cast("bigint")
    clear = placed.filter(~at_cut).select(
        *columns,
        F.when(F.col("size") > 0, F.col("__whole") + once_more).otherwise(0).alias("copies"),
    )
    inside = W.partitionBy("__source").orderBy("__rank", "id", "size").rowsBetween(
        W.unboundedPreceding, -1
    )
    before = F.col("__base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    near = 2 * before + F.col("size") <= 2 * F.col("__rest")
    sorted_out = placed.filter(at_cut).select(
        *columns, (F.col("__whole") + near.cast("bigint")).alias("copies")
    )
    return clear.unionByName(sorted_out)


def mix(
    docs: DataFrame, key: str = "doc_id", body: str = "text", source: str = "source",
    weight: str | None = None, **options,
) -> DataFrame:
    """``(key, size, source_size, target, taken, copies)`` per row; see the module text."""
    return sample(sized(docs, key, body, source, weight), **options).select(
        F.col("id").alias(key), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )


def repeated(
    docs: DataFrame, key: str = "doc_id", body: str = "text", source: str = "source",
    weight: str | None = None, **options,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    rows = located(docs)
    picked = sample(sized(rows, key, body, source, weight, tuple(PLACE)), **options).select(
        *PLACE, "copies"
    ).filter(F.col("copies") > 0).withColumnRenamed("copies", "__copies")
    return rows.join(picked, PLACE).withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))
    ).select(*docs.columns)
