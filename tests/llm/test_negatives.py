"""Hard negatives against a loop over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusward.llm import negatives

SCHEMA = "vec_id BIGINT, label INT, embedding ARRAY<DOUBLE>, row STRING, key BINARY"


def brute(rows, positives=5, k=10, low=30, high=90):
    rows = [
        (i, label, v) for i, label, v in rows
        if label is not None and v is not None
        and all(x is not None and abs(x) < float("inf") for x in v)
    ]
    order = lambda r: (-r[0], r[1] is not None, r[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = [
            (sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), j, other == label)
            for m, (j, other, w) in enumerate(rows) if m != n and len(w) == len(v)
        ]
        own = sorted([s for s in scored if s[2]], key=order)[:positives]
        rest = sorted([s for s in scored if not s[2]], key=order)
        for p, j, _ in own:
            fits = [s for s in rest if low * p <= 100 * s[0] <= high * p][:k]
            out += [(i, j, rank, s[1], p, s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(5)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **options)
    return sorted([tuple(r) for r in got.collect()], key=str)


def random_rows(n, size, seed, spread=40):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [float(rng.randint(-spread, spread)) for _ in range(size)]) for i in range(n)]
    return rows, rng


@pytest.mark.parametrize("elements", [negatives.BLOCK_ELEMENTS, 12])
def test_equals_all_pairs(spark, elements):
    rows, rng = random_rows(420, 4, 1)
    # one vector shared by a third of all rows, repeated ids, repeated rows, repeated anchors
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(140)]
    rows += rows[:60]  # negatives that stand there twice
    rows += [rows[100], rows[200], (100, 2, rows[5][2]), (7, 1, rows[7][2])]
    got = mined(spark, rows, block_elements=elements)
    assert got == brute(rows) and len(got) > 100


def test_odd_rows(spark):
    rows, _ = random_rows(120, 3, 2, spread=4)
    odd = [
        (200, None, [1.0, 2.0, 3.0]), (300, 1, None), (400, 1, [1.0, None, 2.0]),
        (500, 1, [float("nan"), 1.0, 1.0]), (600, 1, [float("inf"), 1.0, 1.0]),
        (None, 1, [4.0, 4.0, 4.0]), (700, 0, []), (701, 0, []), (702, 1, []),
        (800, 1, [0.0, 0.0, 0.0]), (900, 1, [5.0, 1.0]), (901, 1, [4.0, 1.0]), (902, 2, [3.0, 1.0]),
    ]
    assert mined(spark, rows + odd) == brute(rows + odd)


def test_large_components_and_saturation(spark):
    rows, _ = random_rows(60, 2, 3, spread=10**9)
    assert mined(spark, rows) == brute(rows)
    huge = [(0, 0, [2.0**40]), (1, 0, [2.0**40]), (2, 1, [2.0**22]), (3, 1, [2.0**23 - 1])]
    top = (1 << 63) - 1
    assert mined(spark, huge) == [(0, 1, 1, 2, top, 2**62)]


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
