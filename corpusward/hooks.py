"""Optional models. Each hook wraps a loader; the model is loaded once per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENCODED = "dense ARRAY<DOUBLE>, tokens ARRAY<INT>, weights ARRAY<DOUBLE>"


def embed(load: Callable[[], Callable[[pd.Series], pd.DataFrame]]):
    """Column function ``text -> struct<dense, tokens, weights>``: both vectors from one call.

    ``load()`` returns a function from a series of texts to a frame with those three columns.
    """

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            yield model(texts)

    return run


def reranker(load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]):
    """Column function ``(query, text) -> double`` for ``operators.search.rerank``."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, text in batches:
            yield model(query, text)

    return run


def person_detector(load: Callable[[], Callable[[pd.Series], pd.Series]]):
    """Column function ``text -> array<struct<start, end>>`` (0-based, end exclusive)."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield model(texts)

    return run


def mask_spans(text: Column, spans: Column, tag: str = "<PERSON>") -> Column:
    """Replace non-overlapping spans by ``tag``; they are applied from the right."""
    ordered = F.sort_array(spans, asc=False)
    return F.aggregate(
        ordered,
        text,
        lambda acc, s: F.concat(
            F.substring(acc, F.lit(1), s["start"]),
            F.lit(tag),
            F.substring(acc, s["end"] + 1, F.length(acc)),
        ),
    )
