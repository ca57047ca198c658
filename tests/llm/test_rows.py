"""Row identity where rows were doubled, joined or share ids."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusward.llm import chat, exact, mixing, simhash
from corpusward.llm.rows import PLACE, located
from corpusward.session import cut
from tests.llm.helpers import docs

TEXTS = [
    (1, "one two three four five six seven"), (2, "one two three four five six seven"),
    (8, "alpha beta gamma delta epsilon zeta"), (None, "lorem ipsum dolor sit amet"),
]


def shapes(spark):
    table = cut(docs(spark, TEXTS))
    twice = table.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    return {
        "exploded": twice, "unioned": table.unionByName(table),
        "joined": table.crossJoin(spark.range(2)).drop("id"), "in memory": docs(spark, TEXTS * 2),
    }


@pytest.mark.parametrize("shape", ["exploded", "unioned", "joined", "in memory"])
def test_no_row_is_lost_or_doubled(spark, shape):
    frame = shapes(spark)[shape]
    assert located(frame).select(*PLACE).distinct().count() == 8
    got = exact.duplicates(frame).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 3
    assert Counter(r.text for r in exact.keep_one(frame).collect()) == Counter(t for _, t in TEXTS[1:])
    near = simhash.keep_representatives(frame).collect()
    assert sorted(r.text for r in near) == sorted(t for _, t in TEXTS[1:])
    copies = sorted((str(r.doc_id), r.copies) for r in mixing.mix(frame).collect())
    mixed = Counter(str(r.doc_id) for r in mixing.repeated(frame).collect())
    assert sum(mixed.values()) == sum(c for _, c in copies)


def test_a_scan_is_not_copied(spark):
    table = cut(docs(spark, TEXTS))
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    shaped = table.filter("doc_id > 0").withColumn("more", F.upper("text"))
    files = {r["__file"].rsplit("/", 1)[0] for r in located(shaped).collect()}
    assert {f.split(":")[-1].lstrip("/") for f in files} == {path.split(":")[-1].lstrip("/")}


def test_near_copies_under_one_id(spark):
    """The different text stays, though another row of its id is a near copy; null ids come last."""
    base = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, base), (8, base + " extra"), (8, "quite another text that nobody else has written so far"),
        (None, base + " more"), (None, "a text of its own without any id"),
    ]
    got = sorted((str(r.doc_id), r.text[:12]) for r in simhash.keep_representatives(docs(spark, rows)).collect())
    assert got == [("1", base[:12]), ("8", "quite anothe"), ("None", "a text of it")]


def test_conversations_doubled_by_a_generator(spark):
    turns = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi there")]
    table = cut(spark.createDataFrame(turns, "conv_id BIGINT, turn BIGINT, role STRING, text STRING"))
    twice = table.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("again")
    plain = chat.repair(table.unionByName(table)).collect()
    assert sorted(map(str, chat.repair(twice).collect())) == sorted(map(str, plain))
