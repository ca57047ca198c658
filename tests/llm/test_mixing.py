from __future__ import annotations

import pytest

from corpusward.llm import mixing
from tests.llm.helpers import docs, word_list

LONG = "w " * 50_000


def water_levels(sizes, weights=(5, 2, 1), most=3):
    """Share, cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and rest * weight[s] > most * sizes[s] * open_weight}
        if not over:
            return {s: most * sizes[s] if s in capped else rest * weight[s] / open_weight for s in sizes}
        capped |= over


def check(rows, got):
    """``rows`` of ``(id, text, source)`` against the mix."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(word_list(text))
    want = water_levels(sizes)
    assert len(got) == len(rows)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 3
        assert r.copies - int(want[r.source] // max(1, sizes[r.source])) in (0, 1) or not r.size
        assert r.size or not r.copies
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1e-6


def mixed(spark, rows, **options):
    df = docs(spark, [(i, t) for i, t, _ in rows], extra=True)
    df = df.drop("source").join(
        spark.createDataFrame([(i, s) for i, _, s in rows], "doc_id BIGINT, source STRING"), "doc_id"
    ) if len({i for i, _, _ in rows}) == len(rows) else spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    return mixing.sample(mixing.sized(df), **options).collect()


@pytest.mark.parametrize("bucket_rows", [1, 50_000])
def test_targets_are_met(spark, bucket_rows):
    rows = [(i, "w " * (i * 37 % 91), f"s{i % 7}" if i % 11 else None) for i in range(1, 400)]
    rows += [(1000 + i, "w " * 5, "é") for i in range(300)] + [(2000, LONG, "s1")]
    check(rows, mixed(spark, rows, bucket_rows=bucket_rows))


@pytest.mark.parametrize("rows", [
    [], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "one two", "a")], [(1, "a b c", "a"), (2, "d", None)],
    [(1, "a b", "a"), (1, "a b", "a"), (None, "c d", "a"), (None, "e", "b")],
    [(i, "w " * 100, "a") for i in range(5)] + [(9, "w", "b"), (10, "w w", "c")],
])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    check(rows, mixing.sample(mixing.sized(df)).collect())


def test_empty_documents_and_capped_sources(spark):
    """Copies as the registered SQL has them, where a source is capped, empty or both."""
    import duckdb

    from corpusward.llm import catalog

    rows = [(i, "w " * (i % 4), "tiny") for i in range(60)] + [(100 + i, "", "none") for i in range(20)]
    rows += [(200 + i, "w " * 90, "big") for i in range(50)] + [(300 + i, None, "big") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    got = {r.doc_id: (r.size, r.taken, r.copies) for r in mixing.mix(df, weights=(1, 2, 5)).collect()}
    frame = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM frame")
    sql = catalog.SQL["op10_mix_sources"].replace("WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END", "WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 5 END")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, taken, copies FROM ({sql})").fetchall()}
    assert got == want and {c for i, (size, _, c) in got.items() if 100 > i and size} == {3}
    assert mixing.repeated(df).filter("source = 'none'").isEmpty()


def test_a_source_that_cannot_grow_is_not_sorted(spark):
    """Only rows of a cut bucket reach the window: none of a source that is taken whole."""
    rows = [(i, "w", "a") for i in range(3000)] + [(9000 + i, "w " * 900, "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    got = mixing.mix(df, bucket_rows=10).collect()
    assert {r.copies for r in got if r.doc_id < 9000} == {3}
    check(rows, [_with_source(r, rows) for r in got])


def _with_source(row, rows):
    from types import SimpleNamespace

    return SimpleNamespace(**row.asDict(), source=dict((i, s) for i, _, s in rows)[row.doc_id])


def test_reruns_agree_and_stage_repeats(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {r.doc_id: r.copies for r in mixing.mix(table).collect()}
    assert first == {r.doc_id: r.copies for r in mixing.mix(table.repartition(5)).collect()}
    made = mixing.repeated(table)
    assert made.columns == table.columns
    counts = {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert counts == {k: c for k, c in first.items() if c}


def test_weights_raise_the_odds(spark):
    rows = [(i, "w " * 10, "a", 9.0 if i % 2 else 1.0) for i in range(2000)] + [(9999, "w " * 30_000, "b", 1.0)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, quality DOUBLE")
    got = mixing.mix(df, weight="quality", weights=(1, 3)).filter("doc_id < 9999").collect()
    odd, even = (sum(r.copies % 1 + (r.copies > r.target // r.source_size) for r in got if r.doc_id % 2 == k) for k in (1, 0))
    assert odd > 2 * even
