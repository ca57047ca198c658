"""Small inputs and brute-force twins shared by these tests."""

from __future__ import annotations

import re


def word_list(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def docs(spark, rows, extra: bool = False):
    """``documents`` rows from ``(doc_id, text)``; ``extra`` adds columns with clashing names."""
    full = [(i, text, "en", "src0", None) for i, text in rows]
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    df = spark.createDataFrame(full, schema)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "fp", "comp", "node", "size", "kept", "failed", "n_words", "part",
                     "digest", "n", "key", "ids", "__m", "component_id", "keep_id", "target"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def smallest_reachable(n: int, linked) -> list[int]:
    """For positions ``0..n-1``: the smallest position reachable over ``linked(i, j)``."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
