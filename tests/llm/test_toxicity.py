from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusward.llm import toxicity
from corpusward.llm.catalog import TOXIC_CHAIN
from tests.llm.helpers import docs

SF = "/root/testdata/sf0.1"


def _by_hand(model, text):
    """The chain's probabilities for one text, from its definition."""
    found, told, out = toxicity.words(text), [], []
    for one in model.chain:
        odds = one.intercept + sum(one.words[model.vocabulary[w]] for w in found if w in model.vocabulary)
        odds += sum(a * b for a, b in zip(one.earlier, told, strict=True))
        out.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        told.append(out[-1] - 1 / (1 + np.exp(-one.intercept)))
    return out


def test_held_out_accuracy(spark):
    """Trained on four fifths of the labels, measured on the rest."""
    table, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = toxicity.train(table, labels.filter(~held), TOXIC_CHAIN)
    known = labels.filter(held).withColumnRenamed("toxic", "truth")
    made = toxicity.flagged(toxicity.score(table.join(known, "doc_id", "left_semi"), model)).join(known, "doc_id")
    pairs = [(bool(r.truth), r.toxic) for r in made.collect()]
    # a twin of the chain, row by row, gives the same probabilities
    sample = table.join(known, "doc_id", "left_semi").select("doc_id", "text").limit(20).collect()
    want = {r.doc_id: _by_hand(model, r.text) for r in sample}
    for r in made.filter(F.col("doc_id").isin(list(want))).collect():
        assert np.allclose([r[f"p_{c}"] for c in model.categories], want[r.doc_id], atol=2e-6)
    hits, truth = sum(t and p for t, p in pairs), sum(t for t, _ in pairs)
    wrong = sum(p and not t for t, p in pairs)
    assert hits >= 0.85 * truth and wrong <= 0.02 * len(pairs)


def test_chain_uses_earlier_categories():
    """The second category is decided by the first one alone; only the chain can see it."""
    rng = np.random.default_rng(1)
    n, width = 400, 30
    dense = rng.random((n, width)) < 0.2
    row, column = np.nonzero(dense)
    first = (dense[:, 0] | dense[:, 1]).astype(float)
    targets = np.column_stack([first, first])
    chain = toxicity.fit_chain(toxicity.Rows(n, row, column), targets, np.ones(n), np.arange(n) % 3, width)
    assert chain[0].earlier.size == 0 and chain[1].earlier[0] > 0.1


def test_edges(spark):
    rows = [(i, f"plain words here {i}") for i in range(60)] + [(100 + i, f"awful nasty words {i}") for i in range(40)]
    rows += [(500, None), (501, ""), (None, "awful nasty"), (100, "awful nasty again"), (502, "awful " * 60_000)]
    labels = spark.createDataFrame(
        [(i, 1, int(i >= 100)) for i, _ in rows[:100]] + [(None, 1, 1), (3, None, None), (3, 1, 0)],
        "doc_id BIGINT, quality INT, toxic INT",
    )
    df = docs(spark, rows, extra=True)
    model = toxicity.train(df, labels, TOXIC_CHAIN)
    got = [(r.doc_id, r.toxic) for r in toxicity.flagged(toxicity.score(df, model)).collect()]
    assert len(got) == len(rows)
    wrong = [(i, flag) for i, flag in got if flag != (i is None or 100 <= i < 500 or i == 502)]
    assert not wrong
    none = toxicity.train(df, labels.limit(0), TOXIC_CHAIN)
    assert toxicity.score(df, none).count() == len(rows)
    assert toxicity.score(df.limit(0), model).count() == 0
