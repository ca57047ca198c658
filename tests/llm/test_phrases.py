"""Phrase collocations against counting with plain dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusward.llm import phrases

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, n BIGINT, phrase STRING, w1 STRING, size INT"


def brute(rows, least=10, share=50, best=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        listed = []
        for p, a in candidates.items():
            if len(p) == 2 and any(
                len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in candidates.items()
            ):
                continue
            score, _, left, right = min(
                (10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))
            )
            listed.append((-score, -a, " ".join(p).encode(), left, right))
        out += [
            (lang, rank, p.decode(), -a, left, right, totals[lang], -s)
            for rank, (s, a, p, left, right) in enumerate(sorted(listed)[:best], 1)
        ]
    return sorted(out)


def found(spark, rows, parts=4, **options):
    df = spark.createDataFrame([(i, t, g, 1, "x", "x", 9) for i, (t, g) in enumerate(rows)], SCHEMA)
    got = phrases.collocations(df.repartition(parts), **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted([tuple(r) for r in got.collect()])


def texts(n, seed, vocabulary="the The of a É x in\x01to to\x00 # ß 東京 und"):
    rng = random.Random(seed)
    words = vocabulary.split(" ")
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]
    out = []
    for _ in range(n):
        body = "".join(rng.choice(words[: rng.randint(2, len(words))]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        out.append((body, rng.choice(["en", "en", "en", "de", None, "und"])))
    return out


def test_equals_plain_counting(spark):
    rows = texts(300, 1) + [(None, "en"), ("", "de"), (" .,\n", None), ("one", "fr"), ("a b", "a\nb")]
    rows += [("same words here again. ", "en")] * 40  # repeated rows count as often
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("entries, word_bytes", [(50, 1 << 20), (10**6, 40)])
def test_spills_change_nothing(spark, monkeypatch, entries, word_bytes):
    rows = texts(200, 2)
    assert found(spark, rows, entries=entries, word_bytes=word_bytes, least=3) == brute(rows, least=3)


def test_containers_burst():
    trie, plain = phrases.HatTrie(burst=16), phrases.HatTrie(burst=10**6)
    rng = np.random.default_rng(3)
    for _ in range(40):
        w = np.stack([rng.integers(1, 5, 60), rng.integers(0, 4, 60), rng.integers(0, 40, 60)])
        w[0, :10] = rng.integers(5, 500, 10)  # rare first words stay together
        trie.add(*w)
        plain.add(*w)
    assert trie.nodes and trie.shared and not plain.nodes and not plain.flat
    assert sum(trie.sizes().values()) == sum(plain.sizes().values())
    rows = [sorted(zip(*(c.tolist() for c in t.cut_off(list(t.sizes()))), strict=True)) for t in (trie, plain)]
    assert rows[0] == rows[1] and sum(r[3] for r in rows[0]) == 2400
    assert not any(t.flat or t.nodes or t.shared for t in (trie, plain))


def test_hot_prefix_over_many_partitions(spark):
    """One word pair before very many different words; ranges cut its prefix in several places."""
    rows = [("of the " + " . of the ".join(f"w{j}" for j in range(i, i + 150)), "en") for i in range(0, 600, 30)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(spark, rows, parts=6, least=4) == brute(rows, least=4)
        assert found(spark, rows, parts=6, least=4, part_words=100, entries=700) == brute(rows, least=4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ties_and_limit(spark):
    rows = [(". ".join(f"{a}{b} x{b}" for a in "abc" for b in "dé~Z"), None)] * 10
    got = found(spark, rows, best=5)
    assert got == brute(rows, best=5) and len(got) == 5


def test_long_text(spark):
    rows = [(" ".join(f"w{i % 50} v{i % 7}" for i in range(40_000)), "en"), ("x" * 3_000_000 + " y", "en")]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), ("", "en")]) == []
