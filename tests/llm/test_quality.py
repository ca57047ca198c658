from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusward.llm import quality
from tests.llm.helpers import docs, word_list


def measures(text):
    text = text or ""
    words = word_list(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if word_list(line)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), text.count("!"),
        len(lines), len(lines) - len(set(lines)), len(covered),
    )


def ledger(df):
    return {(r.doc_id, r[1:-1]): r.failed for r in quality.ledger(df).collect()}


def check(spark, rows):
    got = quality.ledger(docs(spark, rows, extra=True)).collect()
    assert sorted((str(r.doc_id), *r[1:-1]) for r in got) == sorted(
        (str(key), *measures(text)) for key, text in rows
    )


def test_measurements(spark):
    phrase = "one two three four five six"
    check(spark, [
        (1, None), (2, ""), (3, " \t\r\n\x0b\x0c "), (4, "word"), (5, phrase), (5, phrase),
        (6, f"{phrase} {phrase}"), (7, "a " * 5), (8, "a " * 6), (9, "a a a a a a b a a a a a"),
        (10, "x\ny\nx\n\n \ny"), (11, "# * $ % & | < > !"), (12, "é𝄞  x y"),
        (None, f"{phrase} seven {phrase} eight {phrase}"), (13, " ".join(map(str, range(30_000)))),
        (14, ("lorem ipsum dolor sit amet " * 4000)),
    ])
    assert quality.ledger(docs(spark, []).limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n!#", max_size=60), min_size=20, max_size=20))
def test_measurements_of_any_text(spark, texts):
    check(spark, list(enumerate(texts)))


def test_policies_and_ablations(spark):
    rows = [
        (1, "a fine text with more than ten words in it for all to read"), (2, "short"),
        (3, "## ## ##"), (4, "same words again and again " * 5), (5, "wow! " * 12), (6, None),
    ]
    made = quality.ledger(docs(spark, rows))
    bits = {r.doc_id: r.failed for r in made.collect()}
    kept = {r.doc_id for r in quality.verdicts(made).filter("`kept_strict-1`").collect()}
    assert kept == {key for key, failed in bits.items() if failed == 0} == {1}
    got = {(r.version, r.rule): r for r in quality.ablations(made).collect()}
    for policy in quality.POLICIES:
        mask = policy.mask()
        for name in policy.rules:
            bit = 1 << [rule.name for rule in quality.RULES].index(name)
            row = got[policy.version, name]
            assert row.failing == sum(b & bit > 0 for b in bits.values())
            assert row.only == sum(b & mask == bit for b in bits.values())
            assert row.dropped == sum(b & mask > 0 for b in bits.values())
            assert row.kept_without == sum(b & (mask ^ bit) == 0 for b in bits.values())


@pytest.mark.parametrize("policy", quality.POLICIES)
def test_stage_agrees_with_ledger(spark, policy):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = table.withColumn("n_words", F.lit("clash"))
    kept = quality.keep_passing(table, policy=policy)
    assert kept.columns == table.columns
    want = quality.ledger(table).filter(quality.passes(F.col("failed"), policy))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in want.collect()}
