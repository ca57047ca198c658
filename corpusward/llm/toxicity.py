"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models. Each model sees the words
of the text and, as further features, the probabilities that the earlier models of the chain give it,
less those of a text that says nothing. In training these come from *out-of-fold* models, fitted on the
other folds, so a later model meets earlier predictions as wrong as they will be on unseen text.

Training reads at most ``max_rows`` labelled rows, half of them from rows with the rarest-first
category, picked by a hash of their ids and weighted back to the shares in the whole label table.
Word statistics of these rows are counted by Spark; at most ``max_features`` words, those whose
presence is most closely bound to a category, enter the models. Fitting is numpy on the driver over these
bounded tables. Every document is scored, whole, in place, without a shuffle; what each task gets is
the model, at most ``max_features`` words.

Defined results: a null or empty text has no words and gets each category's share; labels with a
null id are ignored, of repeated ones the largest value of each category counts, a null value counts
as 0, of a labelled id's several texts the first in order is read; a label table without both values of a category gives that category its share; rows with a
null or repeated id are scored like any other; an empty table gives an empty result; columns other
than those named are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.session import cut

MAX_ROWS = 8_000
MAX_FEATURES = 20_000
LEAST_RATIO = 25.0
FOLDS = 3
ROUNDS = 120
PENALTY = 1e-3
THRESHOLD = 0.5
STEMS = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    """Distinct lower-case words, and their beginnings (marked by a star), so that forms of one
    stem count together."""
    found = set(_WORD.findall((text or "").lower()))
    out = set(found)
    for size in STEMS:
        out.update([f"{word[:size]}*" for word in found if len(word) > size])
    return out


def probability(log_odds):
    return 1 / (1 + np.exp(-log_odds))


# --- fitting -----------------------------------------------------------------------------------

@dataclass
class Rows:
    """Binary word features as sorted ``(row, column)`` pairs."""

    n: int
    row: np.ndarray
    column: np.ndarray

    def of(self, chosen: np.ndarray) -> Rows:
        place = np.full(self.n, -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[self.row] >= 0
        return Rows(len(chosen), place[self.row[keep]], self.column[keep])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.n)

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, values[self.row], width)


@dataclass
class Linear:
    """``intercept + words . x + earlier . e``, ``e`` being earlier probabilities over those of an empty text."""

    intercept: float
    words: np.ndarray
    earlier: np.ndarray

    def log_odds(self, word_sum: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.clip(self.intercept + word_sum + earlier @ self.earlier, -30, 30)

    def told(self, log_odds: np.ndarray) -> np.ndarray:
        """What later models of the chain are given."""
        return probability(log_odds) - probability(self.intercept)


def fit(
    rows: Rows, earlier: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int,
    rounds: int = ROUNDS, penalty: float = PENALTY,
) -> Linear:
    """Weighted logistic regression by Adam over all rows at once."""
    weight = weight / weight.sum() if weight.sum() else weight
    share = float(np.clip((weight * target).sum(), 1e-6, 1 - 1e-6))
    model = Linear(math.log(share / (1 - share)), np.zeros(width), np.zeros(earlier.shape[1]))
    if not 0 < target.sum() < len(target):
        return model
    theta = np.concatenate([[model.intercept], model.earlier, model.words])
    cut = 1 + earlier.shape[1]
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        odds = theta[0] + earlier @ theta[1:cut] + rows.dot(theta[cut:])
        error = weight * (probability(np.clip(odds, -30, 30)) - target)
        slope = np.concatenate([[error.sum()], error @ earlier, rows.back(error, width)])
        slope[1:] += penalty * theta[1:] / len(target)
        slope[0] = 0.0  # a text that says nothing keeps the category's share
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta -= 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Linear(float(theta[0]), theta[cut:], theta[1:cut])


def fit_chain(
    rows: Rows, targets: np.ndarray, weight: np.ndarray, fold: np.ndarray, width: int,
    folds: int = FOLDS, rounds: int = ROUNDS,
) -> list[Linear]:
    """One model per column of ``targets``, in order."""
    earlier, chain = np.zeros((rows.n, 0)), []
    for c in range(targets.shape[1]):
        target = targets[:, c]
        chain.append(fit(rows, earlier, target, weight, width, rounds))
        if c + 1 == targets.shape[1]:
            break
        unseen = np.zeros(rows.n)
        for k in range(folds):
            others, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(others) and len(held):
                part = rows.of(others)
                model = fit(part, earlier[others], target[others], weight[others], width, rounds)
                odds = model.log_odds(rows.of(held).dot(model.words), earlier[held])
                unseen[held] = model.told(odds)
        earlier = np.column_stack([earlier, unseen])
    return chain


# --- training data -----------------------------------------------------------------------------

@dataclass
class Model:
    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    chain: list[Linear]

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        """One row per text, one column per category."""
        found = [[self.vocabulary[w] for w in words(t) & self.vocabulary.keys()] for t in texts]
        rows = Rows(
            len(texts), np.repeat(np.arange(len(texts)), [len(f) for f in found]),
            np.array([c for f in found for c in f], np.int64),
        )
        earlier, out = np.zeros((len(texts), 0)), []
        for model in self.chain:
            out.append(model.log_odds(rows.dot(model.words), earlier))
            earlier = np.column_stack([earlier, model.told(out[-1])])
        return np.column_stack(out)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(words(t.as_py())) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(found, pa.list_(pa.string()))], ["id", "words"]
        )


def _picked(labels: DataFrame, key: str, categories: dict[str, str], max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids with 0/1 per category and a weight; rows of the last
    category, the rarest, make up to half."""
    names = list(categories)
    rows = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[
        F.max(F.coalesce(F.expr(test).cast("int"), F.lit(0))).alias(name)
        for name, test in categories.items()
    ])
    parts = []
    for value in (0, 1):
        side = rows.filter(F.col(names[-1]) == value)
        n = side.count()
        taken = min(n, max_rows // 2)
        parts.append(
            side.orderBy(F.xxhash64("id"), "id").limit(max_rows // 2)
            .withColumn("weight", F.lit(n / taken if taken else 1.0))
        )
    return parts[0].unionByName(parts[1])


def _vocabulary(worded: DataFrame, names: list[str], most: int, least_ratio: float) -> dict[str, int]:
    """The words bound most closely to any category, by the log-likelihood ratio of their counts.

    Ratios below ``least_ratio`` are what many thousands of unrelated words reach by chance.
    """
    totals = worded.agg(*[F.avg(c).alias(c) for c in names]).first()
    seen = worded.select(F.explode("words").alias("word"), *names).groupBy("word").agg(
        F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in names]
    )
    rows, ratios = F.col("rows"), [F.lit(0.0)]
    for name in names:
        share = totals[name] or 0.0
        if 0 < share < 1:
            def term(count, part):
                return F.when(count > 0, count * F.ln(count / (rows * part))).otherwise(0.0)

            ratios.append(2 * (term(F.col(name), share) + term(rows - F.col(name), 1 - share)))
    ratio = F.greatest(*ratios, F.lit(0.0))
    top = seen.withColumn("ratio", ratio).filter(F.col("ratio") >= least_ratio)
    top = top.orderBy(F.desc("ratio"), "word").limit(most)
    return {r.word: i for i, r in enumerate(top.select("word").collect())}


def train(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], key: str = "doc_id",
    body: str = "text", label_key: str = "doc_id", max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES, least_ratio: float = LEAST_RATIO, folds: int = FOLDS,
    rounds: int = ROUNDS,
) -> Model:
    """A chain over ``categories``: names in chain order, each with its test in SQL over ``labels``."""
    names = list(categories)
    picked = cut(_picked(labels, label_key, categories, max_rows))
    texts = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(picked.select("id")), "id", "left_semi")
    chosen = chosen.groupBy("id").agg(F.min("text").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    worded = cut(
        chosen.withColumn("id", F.col("id").cast(kind))
        .mapInArrow(_word_rows, f"id {kind}, words ARRAY<STRING>").join(picked, "id")
    )
    vocabulary = _vocabulary(worded, names, max_features, least_ratio)
    known = pa.array(list(vocabulary), pa.string())

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(known.to_pylist())}
        for batch in batches:
            found = [[place[w] for w in ws if w in place] for ws in batch["words"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), batch["weight"], batch["fold"],
                 pa.array(found, pa.list_(pa.int32()))],
                [*names, "weight", "fold", "columns"],
            )

    ordered = worded.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(folds)))
    schema = ", ".join([*(f"{c} INT" for c in names), "weight DOUBLE", "fold BIGINT", "columns ARRAY<INT>"])
    table = ordered.select("words", *names, "weight", "fold", "id").orderBy("id").mapInArrow(
        indexed, schema
    ).toArrow()
    columns = table["columns"].to_pylist()
    rows = Rows(
        len(columns), np.repeat(np.arange(len(columns)), [len(c) for c in columns]),
        np.array([i for c in columns for i in c], np.int64),
    )
    targets = np.column_stack([table[c].to_numpy().astype(float) for c in names])
    chain = fit_chain(
        rows, targets, table["weight"].to_numpy(), table["fold"].to_numpy(), len(vocabulary), folds,
        rounds,
    )
    return Model(tuple(names), vocabulary, chain)


def score(docs: DataFrame, model: Model, key: str = "doc_id", body: str = "text") -> DataFrame:
    """``(key, p_<category> ...)`` for every row."""
    names = [f"p_{c}" for c in model.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = model.log_odds([t.as_py() for t in batch["text"]])
            shares = np.round(probability(odds), 6)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], *(pa.array(column) for column in shares.T)], ["id", *names]
            )

    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("text"))
    schema = ", ".join([f"id {kind}", *(f"{name} DOUBLE" for name in names)])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)


def flagged(scores: DataFrame, category: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``scores`` with a boolean column named like the category."""
    return scores.withColumn(category, F.col(f"p_{category}") >= threshold)
