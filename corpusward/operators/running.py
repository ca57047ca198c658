"""Running totals that a hot key cannot pull into one task.

A window over a key sends every row of that key to one task. Here the key's rows are cut into
order buckets; the window runs per (key, bucket), and what earlier buckets add is computed from
one row per bucket. Results equal the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusward.functions.times import micros

_FOLD = {"sum": F.sum, "max": F.max}


def id_bucket(order: Column, bits: int = 16) -> Column:
    """Bucket for a unique integer order: at most ``2**bits`` rows each."""
    return F.shiftright(order.cast("bigint"), bits)


def time_bucket(ts: Column, seconds: int = 3600) -> Column:
    """Bucket for a timestamp order."""
    return F.floor(micros(ts) / F.lit(seconds * 1000000)).cast("bigint")


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    inclusive: dict[str, tuple[str, Column]] | None = None,
    exclusive: dict[str, tuple[str, Column]] | None = None,
    overall: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running folds over each key in ``order``.

    Each dict maps an output name to ``("sum" | "max", expression)``: ``inclusive`` counts the
    current row, ``exclusive`` only earlier ones, ``overall`` every row of the key. A sum over no
    rows is 0, a max over no rows null. ``bucket`` must be monotone in ``order``; keys and bucket
    must not be null.
    """
    inclusive, exclusive, overall = inclusive or {}, exclusive or {}, overall or {}
    columns = df.columns
    groups = [*keys, "__bucket"]
    rows = df.withColumn("__bucket", bucket)

    folds = {**inclusive, **exclusive, **overall}
    per_bucket = rows.groupBy(*groups).agg(
        *[_FOLD[kind](value).alias(f"__b_{name}") for name, (kind, value) in folds.items()]
    )
    earlier = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_bucket.select(
        *groups,
        *[
            _FOLD[kind](f"__b_{name}").over(whole if name in overall else earlier).alias(f"__o_{name}")
            for name, (kind, _) in folds.items()
        ],
    )

    here = W.partitionBy(*groups).orderBy(*order)
    upto = here.rowsBetween(W.unboundedPreceding, 0)
    before = here.rowsBetween(W.unboundedPreceding, -1)

    def merged(name: str, kind: str, value: Column, frame) -> Column:
        local, offset = _FOLD[kind](value).over(frame), F.col(f"__o_{name}")
        if kind == "max":
            return F.greatest(local, offset).alias(name)
        return (F.coalesce(local, F.lit(0)) + F.coalesce(offset, F.lit(0))).alias(name)

    return rows.join(offsets, groups).select(
        *columns,
        *[merged(name, *fold, upto) for name, fold in inclusive.items()],
        *[merged(name, *fold, before) for name, fold in exclusive.items()],
        *[F.col(f"__o_{name}").alias(name) for name in overall],
    )
