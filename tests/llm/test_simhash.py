from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from corpusward.llm import simhash
from corpusward.llm.graph import components, forest
from tests.llm.helpers import docs, smallest_reachable, word_list

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text, width=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = word_list(lowered)
    if not words:
        return 0
    parts = [words[i : i + width] for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = smallest_reachable(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for (key, _), root in zip(rows, roots, strict=True):
        if key is not None:
            least[root] = min(least.get(root, key), key)
    return sorted(
        (str(key), f"{p:016x}", least.get(root))
        for (key, _), p, root in zip(rows, prints, roots, strict=True)
    )


def found(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert found(simhash.near_duplicates(table)) == expected(rows)


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "a b c d"),
        (7, long), (8, long), (8, long), (None, "x y z"), (None, None), (9, "é É ÀB c d e"),
    ]
    assert found(simhash.near_duplicates(docs(spark, rows, extra=True))) == expected(rows)
    empty = docs(spark, rows).limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_representatives(docs(spark, rows, extra=True))
    assert kept.columns == docs(spark, rows, extra=True).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "7", "9", "None"]


@pytest.mark.parametrize("cell", [8, 4096])
@pytest.mark.parametrize("ahead", [1, 4])
def test_links_are_exact(spark, cell, ahead):
    """Loners, chains of near fingerprints, and one dense cluster, against all pairs."""
    rng = random.Random(cell + ahead)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for start in list(prints)[:12]:
        for _ in range(12):  # a chain drifting away in steps of 1 to 6 bits
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                start ^= 1 << bit
            prints.add(start)
    centre = rng.getrandbits(64)
    for _ in range(250):
        value = centre
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            value ^= 1 << bit
        prints.add(value)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in prints)
    roots = smallest_reachable(
        len(values), lambda i, j: ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 4
    )
    want = {v: values[r] for v, r in zip(values, roots, strict=True)}
    df = spark.createDataFrame([(v,) for v in values], "fp BIGINT")
    got = {r.fp: r.comp for r in simhash.link_components(df, cell=cell, ahead=ahead).collect()}
    assert got == want


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    noise = np.uint64(1) << rng.integers(0, 64, (40, 30)).astype(np.uint64)
    values = np.unique((base[:, None] ^ noise).ravel())
    members = values[np.argsort(simhash.gray_rank(values))]
    q, m = simhash.tree_pairs(values, members, 4)
    want = np.argwhere(np.bitwise_count(values[:, None] ^ members[None, :]) <= 4)
    assert sorted(zip(q.tolist(), m.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)]
    links += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)] + [(5, 5)]
    rng.shuffle(links)
    nodes = sorted({n for link in links for n in link})
    linked = set(links)
    roots = smallest_reachable(
        len(nodes), lambda i, j: (nodes[i], nodes[j]) in linked or (nodes[j], nodes[i]) in linked
    )
    want = {n: nodes[r] for n, r in zip(nodes, roots, strict=True) if nodes[r] != n}
    df = spark.createDataFrame(links, "a BIGINT, b BIGINT").repartition(4)
    assert {r.a: r.b for r in components(df).collect()} == want
    a, b = forest(*map(np.array, zip(*links, strict=True)))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == want
