"""Joins whose left key may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_hot(
    left: DataFrame, right: DataFrame, key: str, hot: Column, spread: Column
) -> DataFrame:
    """Inner join where ``right`` is unique per string ``key`` and ``left`` may be skewed.

    ``hot`` picks right rows whose key is frequent on the left. Callers define it as a share of
    all left rows, so no more than ``1 / share`` rows qualify and broadcasting them is safe at any
    scale. The other keys shuffle; left rows already matched get a key made from ``spread`` so
    that they spread evenly instead of meeting in one task.
    """
    values = [c for c in right.columns if c != key]
    fast = right.filter(hot).select(
        F.col(key), F.lit(True).alias("__fast"), *[F.col(c).alias(f"__h_{c}") for c in values]
    )
    slow = right.filter(~hot).select(
        F.col(key).alias("__key"), F.lit(True).alias("__slow"), *[F.col(c) for c in values]
    )
    probed = left.join(F.broadcast(fast), key, "left").withColumn(
        "__key",
        F.when(F.col("__fast"), F.concat(F.lit("\u0000"), spread.cast("string"))).otherwise(
            F.col(key)
        ),
    )
    return (
        probed.join(slow, "__key", "left")
        .filter(F.col("__fast") | F.col("__slow"))
        .select(
            *left.columns,
            *[F.when(F.col("__fast"), F.col(f"__h_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        )
    )
