"""Document versions: numbering, the active one, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.operators.running import with_running

KEY = ["source_type", "filename"]


def number_versions(arrivals: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Version 1..n per document in arrival order; only the newest is active."""
    counted = with_running(
        arrivals, KEY, order, bucket,
        inclusive={"version": ("sum", F.lit(1))},
        overall={"__n": ("sum", F.lit(1))},
    )
    return counted.withColumn("is_active", F.col("version") == F.col("__n")).drop("__n")


def latest(versions: DataFrame, *values: str) -> DataFrame:
    """Newest version of every document, with the given columns of that row."""
    return versions.groupBy(*KEY).agg(
        F.max("version").alias("version"),
        *[F.max_by(v, "version").alias(v) for v in values],
    )


def add_versions(
    existing: DataFrame, arrivals: DataFrame, order: list[str], bucket: Column
) -> DataFrame:
    """``existing`` versions plus ``arrivals`` numbered after them; older ones deactivated."""
    known = latest(existing).withColumnRenamed("version", "__known")
    fresh = (
        number_versions(arrivals, order, bucket)
        .join(known, KEY, "left")
        .withColumn("version", F.col("version") + F.coalesce("__known", F.lit(0)))
        .drop("__known")
    )
    touched = arrivals.select(*KEY).distinct().withColumn("__new", F.lit(True))
    old = (
        existing.join(touched, KEY, "left")
        .withColumn("is_active", F.col("is_active") & F.col("__new").isNull())
        .drop("__new")
    )
    return old.unionByName(fresh, allowMissingColumns=True)


def active(rows: DataFrame, active_only: bool = True) -> DataFrame:
    """Searchable rows; ``active_only=False`` keeps stale versions too."""
    return rows.filter("is_active") if active_only else rows


def as_of(versions: DataFrame, moment: Column, created: str = "created_at") -> DataFrame:
    """The version of each document that was current at ``moment``."""
    then = versions.filter(F.col(created) <= moment)
    newest = then.groupBy(*KEY).agg(F.max("version").alias("version"))
    return then.join(newest, [*KEY, "version"], "left_semi")
