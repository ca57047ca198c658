"""Connected components of a link table, without ever gathering links in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.session import cut, release

_STARS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links ``a - b`` as stars: every node but the smallest of its component, and that one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:  # hook larger roots below smaller ones, then flatten
        ra, rb = root[left], root[right]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if np.array_equal(low, high):
            break
        np.minimum.at(root, high, low)
        while True:
            flat = root[root]
            if np.array_equal(flat, root):
                break
            root = flat
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, root = forest(batch["a"].to_numpy(), batch["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], schema=_STARS)


def components(links: DataFrame) -> DataFrame:
    """``(a, b)``: for every linked node but the smallest of its component, that smallest node.

    ``links`` has two bigint columns ``a`` and ``b`` and any direction or repetition; links of a
    node to itself count for nothing. Alternates the large-star and small-star steps until all
    components are stars, a number of rounds that grows with the logarithm of the largest one.
    Minima combine before the shuffle; a node with very many links is a skewed join key, which
    adaptive execution splits. Tables of finished rounds are removed.
    """
    pairs = cut(links.select("a", "b").mapInArrow(_local_stars, "a BIGINT, b BIGINT"))
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.filter(F.col("b") > F.col("a")).join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        done, pairs = pairs, cut(small)
        release(done)
    return pairs


def _stars(pairs: DataFrame) -> bool:
    """Whether every node points to one centre, and no centre points anywhere."""
    ends = pairs.select(F.col("a").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("hub"))
    ends = ends.unionByName(
        pairs.select(F.col("b").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("hub"))
    )
    wrong = ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("hub").alias("hub"))
    return wrong.filter((F.col("leaf") > 1) | ((F.col("leaf") > 0) & (F.col("hub") > 0))).isEmpty()
