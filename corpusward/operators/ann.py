"""Approximate dense search: cells around fitted centroids, the nearest cells scored exactly.

Centroids come from a bounded sample; every vector is then put into the cell of its nearest
centroid. A question meets the chunks of its ``probes`` nearest cells by equi-join. Crowded cells,
on either side, are cut into blocks, so no group grows with the data. How many cells are probed is
measured: so many that, of the sampled vectors nearest to some questions, the wanted share lies in
them. Vectors that form groups need few cells, vectors without any structure most of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusward.operators.search import (
    CELL_ROWS, LEG_SCHEMA, QUESTION_BOUND, dense_topk, matrix, meet, unit_rows,
)
from corpusward.session import cut

# Bounds of the fitted part: vectors sampled, centroids, and questions that the probes are set by.
SAMPLE_ROWS = 20_000
MAX_CELLS = 4096
SAMPLE_QUESTIONS = 200


@dataclass
class Cells:
    """An index cut into cells: ``rows(chunk_key, dense, cell)`` in a table, the centroids, and the
    sampled vectors, of length 1, they were fitted on."""

    rows: DataFrame
    centroids: np.ndarray
    sample: np.ndarray


def drawn(rows: DataFrame, key: str, bound: int, seed: int = 7) -> DataFrame:
    """About ``bound`` rows, picked by the hash of their key; all where there are fewer."""
    share = min(1.0, bound / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20))


def fit_centroids(
    index: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """At most ``MAX_CELLS`` centroids of length 1, by default the square root of the rows, and the
    about ``sample_rows`` vectors they are fitted on; none where all vectors are zero."""
    cells = min(MAX_CELLS, cells or max(1, round(index.count() ** 0.5)))
    picked = cut(
        drawn(index, "chunk_key", sample_rows, seed).filter(F.exists("dense", lambda x: x != 0))
        .select("dense")
    )
    sample = unit_rows(matrix(picked.toArrow()["dense"]))
    if cells == 1 or not len(sample):
        return np.empty((0, 0)), sample
    vectors = picked.select(array_to_vector("dense").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(vectors)
    return unit_rows(np.array(model.clusterCenters())), sample


def _nearest(centroids: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of every vector; one cell holds all where there are no centroids."""
    if not len(centroids):
        return np.zeros((len(vectors), 1), np.int32)
    return np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def in_cells(rows: DataFrame, centroids: np.ndarray, n: int = 1) -> DataFrame:
    """``rows``, which have a column ``dense``, once for each of their ``n`` nearest cells."""
    spot = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _nearest(spot.value, matrix(batch["dense"]), n)
            bounds = np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]
            listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, listed], [*batch.schema.names, "cells"]
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    near = rows.mapInArrow(run, f"{kinds}, cells ARRAY<INT>")
    return near.withColumn("cell", F.explode("cells")).drop("cells")


def build_cells(index: DataFrame, **options) -> Cells:
    """The cell index of ``index(chunk_key, dense)``; rows without a vector are left out."""
    rows = index.select("chunk_key", "dense").filter(F.col("dense").isNotNull())
    centroids, sample = fit_centroids(rows, **options)
    return Cells(cut(in_cells(rows, centroids)), centroids, sample)


def probes_for(cells: Cells, questions: DataFrame, k: int, target: float) -> int:
    """The fewest cells per question that hold the share ``target`` of the sampled neighbours.

    Neighbours within the sample are farther away than those among all rows, so the number is
    rather too large than too small.
    """
    asked = drawn(questions, "query_id", SAMPLE_QUESTIONS).select("dense").toArrow()["dense"]
    asked = unit_rows(matrix(asked))
    if not len(cells.centroids) or not len(asked):
        return 1
    order = _nearest(cells.centroids, asked, len(cells.centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int32)[None, :], axis=1)
    top = np.argsort(-(asked @ cells.sample.T), axis=1, kind="stable")[:, :k]
    own = _nearest(cells.centroids, cells.sample, 1)[:, 0]
    needed = np.take_along_axis(place, own[top], axis=1) + 1
    return int(np.quantile(needed, target, method="higher"))


def _blocks(rows: DataFrame, bound: int, name: str) -> DataFrame:
    """Per cell, at most ``MAX_CELLS`` rows: in how many blocks of about ``bound`` rows it falls."""
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / bound).cast("int").alias(name))


def probe(
    cells: Cells, questions: DataFrame, k: int, probes: int,
    question_bound: int = QUESTION_BOUND, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(query_id, chunk_key, score)``: the best ``k`` of every probed block."""
    asked = cut(in_cells(questions.select("query_id", "dense"), cells.centroids, probes))
    counts = F.broadcast(
        _blocks(cells.rows, cell_rows, "__chunks").join(_blocks(asked, question_bound, "__asks"), "cell")
    )

    def every(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    def own(key: str, name: str):
        return F.pmod(F.xxhash64(key), F.col(name)).cast("int")

    left = (
        cells.rows.join(counts, "cell")
        .withColumn("__c", own("chunk_key", "__chunks")).withColumn("__q", every("__asks"))
        .select("cell", "__c", "__q", "chunk_key", "dense")
    )
    right = (
        asked.join(counts, "cell")
        .withColumn("__q", own("query_id", "__asks")).withColumn("__c", every("__chunks"))
        .select("cell", "__c", "__q", "query_id", "dense")
    )
    group = ("cell", "__c", "__q")
    return (
        left.groupBy(*group).cogroup(right.groupBy(*group))
        .applyInArrow(meet(("dense",), k), LEG_SCHEMA).drop("leg")
    )


def dense_topk_ann(
    index: DataFrame | Cells, questions: DataFrame, k: int, min_cosine: float = -1.0,
    probes: int | None = None, target: float = 0.97, **options,
) -> DataFrame:
    """Top ``k`` by cosine among the chunks of a question's nearest cells.

    ``index`` is a chunk table or cells built before. Recall rises with ``probes``, by default as
    many as ``probes_for`` finds for the recall ``target``; scores are exact. Questions whose cells hold fewer than ``k`` chunks are
    searched in the whole index. Results below ``min_cosine`` are left out at the end.
    """
    cells = index if isinstance(index, Cells) else build_cells(index, **options)
    questions = questions.select("query_id", "dense").filter(F.col("dense").isNotNull())
    probes = probes or probes_for(cells, questions, k, target)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_key")

    def best(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = cut(best(probe(cells, questions, k, probes)))
    full = near.filter(F.col("rank") == k).select("query_id")
    short = cut(questions.join(full, "query_id", "left_anti"))
    rest = dense_topk(cells.rows.drop("cell"), short, k)
    found = near.join(full, "query_id", "left_semi").unionByName(rest)
    return found.filter(F.col("score") >= min_cosine)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(n_exact, n_found, recall)``: how many of the exact results were found."""
    hit = found.select("query_id", "chunk_key").withColumn("__hit", F.lit(1))
    return exact.join(hit, ["query_id", "chunk_key"], "left").agg(
        F.count("*").alias("n_exact"), F.count("__hit").alias("n_found"),
        F.try_divide(F.count("__hit"), F.count("*")).alias("recall"),
    )


def pair_share(cells: Cells, questions: DataFrame, probes: int) -> float:
    """Share of all question-chunk pairs that a search with so many probes scores."""
    asked = in_cells(questions.select("query_id", "dense"), cells.centroids, probes)
    met = (
        cells.rows.groupBy("cell").agg(F.count("*").alias("n"))
        .join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell")
        .agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    )
    return (met or 0) / max(1, cells.rows.count() * questions.count())
