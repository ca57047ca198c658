"""Benchmark passages against comparing all windows at all positions."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from corpusward.llm import leaks

DOCS = "doc_id BIGINT, text STRING, id STRING, item STRING, n_words INT, spans STRING"
ITEMS = "item_id BIGINT, text STRING, item STRING"


def listed(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    windows = []
    for name, text in items:
        w = listed(text)
        windows += [(str(name).lower() if name is None else str(name), w[i : i + width]) for i in range(max(1, len(w) - width + 1)) if w]
    windows = [("null" if n == "none" else n, w) for n, w in windows]
    out = []
    for doc, text in docs:
        w, hit, names = listed(text), set(), set()
        for name, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    names.add(name)
                    hit.update(range(i, i + len(window)))
        out.append((doc, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", "x", 1, "x") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    out = []
    for row in leaks.contaminated(d, b, **options).collect():
        spans = [(s["start"], s["end"]) for s in row["spans"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # merged, in order
        out.append((row["doc_id"], row["n_words"], [i for a, b in spans for i in range(a, b)], row["items"]))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "a1", "é", "東京", "x", "y", "zz", "rare"]
    text = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "\n", "-", "\x7f"]) for _ in range(k))
    items = [(i, text(rng.choice([0, 1, 2, 5, 9, 10, 11, 30]) if i else 14)) for i in range(25)]
    docs = []
    for i in range(n):
        body = text(rng.randint(0, 60))
        if i % 3:
            part = listed(items[rng.randrange(25)][1])
            body += " ".join(part[rng.randint(0, 3) :]).upper() + " . " + text(5)
        docs.append((i, body))
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_words": 40}, {"block_words": 30}])
def test_equals_all_windows(spark, options):
    docs, items = corpus(1)
    docs += [(None, None), (5, ""), (5, docs[4][1]), (None, docs[4][1]), (7, docs[7][1]), (7, docs[7][1])]
    items += [(None, items[3][1]), (None, None), (3, "zz zz zz zz"), (99, ""), (100, " . ")]
    got = found(spark, docs, items, **options)
    assert got == brute(docs, items)
    assert sum(bool(r[2]) for r in got) > 20


def test_common_passage_and_long_text(spark):
    rng = random.Random(2)
    passage = [f"w{rng.randrange(300)}" for _ in range(40)]
    items = [(1, " ".join(passage)), (2, " ".join(passage[5:20])), (10, "solo")]
    filler = [f"v{i % 97}" for i in range(3000)]
    docs = [(i, " ".join(filler[: i % 50] + passage[i % 30 :] + filler[:3])) for i in range(400)]
    docs += [(1000, " ".join(filler + passage + filler * 8 + ["SOLO"] + passage[:12]))]
    for options in ({}, {"shard_words": 500}):
        assert found(spark, docs, items, **options) == brute(docs, items)


def test_empty(spark):
    docs, items = corpus(3, 5)
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == brute(docs, [])
    assert found(spark, docs, [(1, None)]) == brute(docs, [])


def test_index_against_plain_search():
    rng = np.random.default_rng(4)
    for size, n in ((3, 1), (3, 400), (40, 2000), (2, 300), (700, 1500)):
        line = rng.integers(0, size, n).astype(np.int32)
        line[n // 2 :] = line[: n - n // 2]  # a long repeat
        order = leaks.suffix_order(np.append(line.astype(np.int64) + 1, 0))
        closed = np.append(line + 1, 0).tolist()
        assert order.tolist() == sorted(range(n + 1), key=lambda i: closed[i:])
        index = leaks.FmIndex(line, size)
        lengths = rng.integers(1, 5, 60)
        phrases = np.zeros((60, 4), np.int64)
        for row, k in zip(phrases, lengths, strict=True):
            row[4 - k :] = rng.integers(min(1, size - 1), size, k)
        want = sorted(
            (p, i) for p in range(60) for i in range(n - lengths[p] + 1)
            if line[i : i + lengths[p]].tolist() == phrases[p, 4 - lengths[p] :].tolist()
        )
        got = [pair for a, b in index.occurrences(phrases, lengths) for pair in zip(a.tolist(), b.tolist(), strict=True)]
        assert sorted(got) == want
