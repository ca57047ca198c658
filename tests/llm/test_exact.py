from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from corpusward.llm import exact
from corpusward.llm.words import whole
from corpusward.session import cut, scratch_path
from tests.llm.helpers import docs

LONG = "lorem ipsum " * 80_000
ROWS = [
    (1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, " a"), (7, LONG), (8, LONG), (8, LONG),
    (None, "a"), (None, "only"), (9, "á"), (10, "á"),
]


def expected(rows):
    out = []
    for key, text in rows:
        same = [k for k, t in rows if (t or "") == (text or "")]
        keep = max((k for k in same if k is not None), default=None)
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((str(key), keep, len(same), digest))
    return sorted(out, key=str)


def test_groups(spark):
    df = docs(spark, ROWS, extra=True)
    got = exact.duplicates(df).collect()
    assert sorted(
        ((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got), key=str
    ) == expected(ROWS)
    # one row of every group stays, also where ids repeat
    assert sum(r.kept for r in got) == len({t or "" for _, t in ROWS})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_stage_and_empty(spark):
    df = docs(spark, ROWS, extra=True)
    kept = exact.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        ["2", "3", "5", "6", "8", "None", "9", "10"]
    )
    assert exact.duplicates(df.limit(0)).count() == 0
    assert exact.keep_one(cut(df.limit(0))).count() == 0


def test_lying_digest(spark):
    """With a digest of one hex digit nearly all groups mix texts; bytes decide."""
    def short(rows, key, body):
        return exact.arrivals(rows, key, body).withColumn("digest", F.substring("digest", 1, 1))

    rows = [(i, f"text {i % 23}") for i in range(120)]
    got = exact._groups(exact.located(docs(spark, rows)), "doc_id", "text", short).collect()
    assert len(got) == 120
    for r in got:
        same = [k for k, t in rows if t == f"text {r.id % 23}"]
        assert (r.keep_id, r.n) == (max(same), len(same))


def test_state_outlives_runs(spark):
    """A second batch meets the first one's entries."""
    first = cut(exact.arrivals(exact.located(docs(spark, [(1, "a"), (2, "b")]))))
    state = scratch_path(spark, "state")
    exact.absorb(spark, first.scratch, first.schema, state)
    more = exact.arrivals(exact.located(docs(spark, [(7, "a"), (8, "c")])))
    more.write.mode("append").parquet(first.scratch)
    exact.absorb(spark, first.scratch, first.schema, state)
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in "abc"}
    got = {r.digest: (r.n, r.id) for r in exact.known(spark, state).collect()}
    assert got == {digest["a"]: (2, 7), digest["b"]: (1, 2), digest["c"]: (1, 8)}


def test_whole(spark, one):
    assert one(whole(F.lit(None).cast("string"))) == ""
