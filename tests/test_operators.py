from __future__ import annotations

import math
import random
from datetime import datetime, timedelta
from functools import partial

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusward.catalog import relational
from corpusward.operators import admin, ann, cache, chunking, dedup, reports, search, versions, weights
from corpusward.operators.running import id_bucket, with_running
from corpusward.operators.skew import join_hot


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_running_equals_window(spark):
    data = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id"), ((F.col("id") * 7919) % 101).alias("x"),
    )
    got = with_running(
        data, ["k"], ["id"], id_bucket(F.col("id"), 6),
        inclusive={"s": ("sum", F.col("x")), "m": ("max", F.col("x"))},
        exclusive={"before": ("sum", F.col("x")), "prev": ("max", F.col("id"))},
        overall={"n": ("sum", F.lit(1))},
    )
    w = W.partitionBy("k").orderBy("id")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    want = data.select(
        "k", "id", "x", F.sum("x").over(upto).alias("s"), F.max("x").over(upto).alias("m"),
        F.coalesce(F.sum("x").over(before), F.lit(0)).alias("before"), F.lag("id").over(w).alias("prev"),
        F.count("*").over(W.partitionBy("k")).alias("n"),
    )
    assert got.exceptAll(want.select(got.columns)).count() == 0
    assert got.count() == 3000


def test_join_hot_equals_join(spark):
    left = spark.range(500).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k")
    )
    right = spark.range(30).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"), F.lit(False).alias("h"))
    right = right.unionByName(spark.range(1).select(F.lit("hot").alias("k"), F.lit(99).alias("v"), F.lit(True).alias("h")))
    got = join_hot(left, right, "k", F.col("h"), F.col("id"))
    assert rows(got, "id", "k", "v") == rows(left.join(right, "k"), "id", "k", "v")


def test_sessions_split_at_exactly_one_gap(spark):
    start = datetime(2024, 1, 1, 23, 55)
    offsets = [0, 599.999999, 1199.999998, 1799.999998, 1800, 90000]
    data = [("c", i, start + timedelta(seconds=s), f"u{i}", "hi") for i, s in enumerate(offsets)]
    messages = spark.createDataFrame(data, "channel string, pos int, ts timestamp, user string, text string")
    got = chunking.sessionize(messages)
    assert rows(got, "pos", "thread_no", "nth") == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 1, 1), (5, 2, 0)]
    chunks = chunking.thread_chunks(got, per_part=2)
    assert rows(chunks, "chunk_index", "part", "text")[:2] == [(0, 0, "User u0: hi\nUser u1: hi"), (0, 1, "User u2: hi")]


def test_table_chunks_keep_every_row(spark):
    table = spark.range(50).select(F.lit("salary.csv").alias("filename"), F.col("id").alias("row_no"), F.concat(F.lit("row "), "id").alias("row_text"))
    got = chunking.table_chunks(table, id_bucket(F.col("row_no"), 3), budget=40).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    assert "\n".join(r["text"] for r in got).split("\n") == [f"row {i}" for i in range(50)]
    assert got[0]["allowed_groups"] == ["HR", "Management", "Finance"]


def test_versions_continue(spark):
    old = spark.createDataFrame([("md", "a", 1, True), ("md", "b", 1, True)], "source_type string, filename string, version long, is_active boolean")
    new = spark.createDataFrame([("md", "a", 5), ("md", "a", 6), ("md", "c", 7)], "source_type string, filename string, n int")
    got = versions.add_versions(old, new, ["n"], id_bucket(F.col("n")))
    assert rows(got, "filename", "version", "is_active") == [
        ("a", 1, False), ("a", 2, False), ("a", 3, True), ("b", 1, True), ("c", 1, True)]


# --- duplicates ---------------------------------------------------------------------------------

def greedy(texts: dict[int, str], threshold=0.9):
    kept: dict[int, set] = {}
    match = {}
    for key in sorted(texts):
        words = set(texts[key].split())
        near = [k for k, w in kept.items() if (len(w & words) / len(w | words) if w | words else 1.0) >= threshold]
        if near:
            match[key] = min(near)
        else:
            kept[key] = words
    return sorted(kept), match


def corpus(seed: int, n: int) -> dict[int, str]:
    """Families of near copies, one with a third of all rows, plus tiny and empty texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [rnd.sample(words, rnd.choice([9, 10, 12, 20, 60, 150])) for _ in range(12)]
    out = {}
    for key in range(n):
        base = list(bases[0] if rnd.random() < 0.33 else rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 9])):
            spot = rnd.randrange(len(base))
            base[spot] = rnd.choice(words)
        if rnd.random() < 0.1:
            base = base[: rnd.randrange(4)]
        rnd.shuffle(base)
        out[key] = " ".join(base)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_keep_first_equals_brute_force(spark, seed):
    texts = corpus(seed, 400)
    df = spark.createDataFrame(list(texts.items()), "chunk_key long, text string")
    kept, match = greedy(texts)
    assert sorted(r[0] for r in dedup.keep_first(df).select("chunk_key").collect()) == kept
    found = {r["key"]: r["kept_key"] for r in dedup.duplicate_matches(df).collect()}
    assert found == match


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_other_thresholds(spark, threshold):
    texts = corpus(4, 150)
    df = spark.createDataFrame(list(texts.items()), "chunk_key long, text string")
    kept, match = greedy(texts, threshold)
    assert sorted(r[0] for r in dedup.keep_first(df, threshold=threshold).select("chunk_key").collect()) == kept
    found = {r["key"]: r["kept_key"] for r in dedup.duplicate_matches(df, threshold=threshold).collect()}
    assert found == match


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_sketches_lose_no_pair_and_spare_the_words(spark):
    """All pairs at the threshold pass, unrelated ones that meet in a block do not."""
    texts = {k: v for k, v in corpus(6, 200).items() if len(set(v.split())) >= 9}
    texts |= {1000 + k: " ".join(f"u{k}_{i}" for i in range(80)) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "chunk_key long, text string")
    sets = dedup.word_sets(df).localCheckpoint()
    keys = sets.select("key")
    pairs = keys.withColumnRenamed("key", "first").crossJoin(keys.withColumnRenamed("key", "later")).filter("first < later")
    passed = {(r[0], r[1]) for r in dedup.plausible(pairs, sets, sets, 0.9).collect()}
    words = {k: set(v.split()) for k, v in texts.items()}
    close = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.9 * len(words[a] | words[b])}
    assert close and close <= passed
    assert not [p for p in passed if p[0] >= 1000]
    # the order of words counts every set, whatever the batches
    order = dedup.word_order(spark.createDataFrame([(i, "all " + f"w{i % 7}") for i in range(60)], "chunk_key long, text string").transform(dedup.word_sets))
    assert order[-1] == spark.range(1).select(F.xxhash64(F.lit("all"))).first()[0]


def test_templates_cost_no_rounds(spark):
    """Different texts of one template: as many jobs for 8 of them as for 512, and no pairs formed."""
    template, counts = [f"t{i}" for i in range(60)], []
    for n in (8, 64, 512):
        texts = {k: " ".join(template + [f"v{k}_{i}" for i in range(20)]) for k in range(n)}
        texts[n] = texts[0] + " more"
        df = spark.createDataFrame(list(texts.items()), "chunk_key long, text string")
        kept, jobs = _jobs(spark, f"templates{n}", lambda: dedup.keep_first(df).count())  # noqa: B023
        assert kept == n
        counts.append(jobs)
    assert max(counts) - min(counts) <= 3, counts  # adaptive execution may add a job


@pytest.mark.parametrize("frequent", [0, 40, 50_000])
def test_blocks_meet_every_pair(spark, frequent):
    """No pair at or above the threshold may miss a common block, whatever order words have."""
    made = lambda sets: dedup.blocks_from_prefixes(sets, order=dedup.word_order(sets, frequent) if frequent else [])
    for blocks_of in (made, dedup.blocks_from_parts):
        _meet(spark, blocks_of)


def _meet(spark, blocks_of):
    rnd = random.Random(5)
    pairs = []
    for key in range(0, 600, 2):
        n = rnd.randrange(9, 130)
        a = rnd.sample(range(10000), n)
        b = list(a)
        for _ in range(rnd.randrange(1, 8)):
            if rnd.random() < 0.5 and len(b) > 8:
                b.pop(rnd.randrange(len(b)))
            else:
                b.append(rnd.randrange(20000, 30000))
        pairs.append((key, a, b))
    data = [(k, " ".join(map(str, a))) for k, a, _ in pairs] + [(k + 1, " ".join(map(str, b))) for k, _, b in pairs]
    sets = dedup.word_sets(spark.createDataFrame(data, "chunk_key long, text string"))
    blocks = {}
    for r in blocks_of(sets).collect():
        blocks.setdefault(r["key"], set()).add(r["block"])
    close = [k for k, a, b in pairs if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.9]
    assert len(close) > 100
    assert all(blocks[k] & blocks[k + 1] for k in close)


def test_bands_as_option(spark):
    texts = corpus(3, 120)
    df = spark.createDataFrame(list(texts.items()), "chunk_key long, text string")
    got = [r[0] for r in dedup.keep_first(df, blocks=dedup.blocks_from_bands).select("chunk_key").collect()]
    assert set(got) >= set(greedy(texts)[0])


def test_unverified_bands_drop_on_any_hit(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:99] + ["x"])), (3, " ".join(f"v{i}" for i in range(100)))]
    df = spark.createDataFrame(texts, "chunk_key long, text string")
    got = dedup.keep_first(df, blocks=partial(dedup.blocks_from_bands, bands=(40, 2)), verify=False)
    assert rows(got, "chunk_key") == [(1,), (3,)]


# --- search -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tables(spark):
    rnd = np.random.default_rng(3)
    names = ["Public", "HR", "Management", "Eng"]
    index, asked = [], []
    for key in range(300):
        tokens = sorted({0} | set(map(int, rnd.integers(1, 60, 8)))) if key % 3 else [0, 77]
        index.append((key, [names[key % 4]], tokens, [float(w) for w in rnd.random(len(tokens)) + 0.1],
                      [float(x) for x in rnd.normal(size=6)]))
    for q in range(23):
        tokens = sorted({0} | set(map(int, rnd.integers(1, 90, 4))))
        asked.append((q, names[1 : 1 + q % 3], tokens, [float(w) for w in rnd.random(len(tokens)) + 0.1],
                      [float(x) for x in rnd.normal(size=6)]))
    vectors = "tokens array<int>, weights array<double>, dense array<double>"
    return (
        index, asked,
        spark.createDataFrame(index, f"chunk_key long, allowed_groups array<string>, {vectors}").repartition(3),
        spark.createDataFrame(asked, f"query_id long, groups array<string>, {vectors}"),
    )


def brute(index, asked, k):
    out = []
    for q, groups, qt, qw, qd in asked:
        mine = set(groups) | {"Public"}
        legs = {"dense": [], "sparse": []}
        for key, allowed, ct, cw, cd in index:
            if not mine & set(allowed):
                continue
            cos = np.dot(qd, cd) / np.linalg.norm(qd) / np.linalg.norm(cd)
            legs["dense"].append((-round(float(cos), 9), key))
            weights_of = dict(zip(ct, cw))
            shared = [w * weights_of[t] for t, w in zip(qt, qw) if t in weights_of]
            if shared:
                legs["sparse"].append((-round(sum(shared), 9), key))
        for leg, found in legs.items():
            out += [(leg, q, key, i + 1) for i, (_, key) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_legs_equal_brute_force_on_both_paths(tables):
    index, asked, index_df, asked_df = tables
    want = brute(index, asked, 10)
    columns = ("leg", "query_id", "chunk_key", "rank")
    assert rows(search.legs_topk(index_df, asked_df, 10), *columns) == want
    grid = search.legs_topk(index_df, asked_df, 10, question_bound=5, cell_rows=40)
    assert rows(grid, *columns) == want


def test_grid_by_elements_and_no_questions(tables, monkeypatch):
    index, asked, index_df, asked_df = tables
    monkeypatch.setattr(search, "QUESTION_ELEMENTS", 60)
    monkeypatch.setattr(search, "CELL_ELEMENTS", 900)
    assert rows(search.legs_topk(index_df, asked_df, 10), "leg", "query_id", "chunk_key", "rank") == brute(index, asked, 10)
    assert search.legs_topk(index_df, asked_df.limit(0), 10).count() == 0


def test_null_and_unknown_groups(spark):
    schema = "chunk_key long, allowed_groups array<string>, dense array<double>"
    index = spark.createDataFrame([(1, None, [1.0]), (2, [None, "HR"], [1.0]), (3, ["Public"], [1.0]), (4, ["X"], [1.0])], schema)
    asked = spark.createDataFrame([(1, ["HR", None, "HR"], [1.0]), (2, None, [1.0])], "query_id long, groups array<string>, dense array<double>")
    assert rows(search.dense_topk(index, asked, 5), "query_id", "chunk_key") == [(1, 2), (1, 3), (2, 3)]


def test_search_leaves_replaced_versions_out(spark):
    schema = "chunk_key long, filename string, allowed_groups array<string>, text string, is_active boolean"
    chunks = spark.createDataFrame([(1, "a", ["Public"], "old leave rules", False), (2, "a", ["Public"], "new leave rules", True)], schema)
    asked = spark.createDataFrame([(1, "leave rules", ["Public"])], "query_id long, query string, groups array<string>")
    vocab = weights.vocabulary(chunks)
    index = weights.encode(chunks, vocab, 8).join(chunks.select("chunk_key", "allowed_groups"), "chunk_key")
    encoded = weights.encode(asked, vocab, 8, "query_id", "query")
    found = lambda **options: rows(search.search(index, chunks, asked, encoded, **options), "chunk_key")
    assert found() == [(2,)]
    assert found(active_only=False) == [(1,), (2,)]


def test_cells_find_neighbours_with_few_pairs(spark):
    rnd = np.random.default_rng(4)
    middles = rnd.normal(size=(30, 8))
    # a third of all vectors in one place; some zero
    spot = np.where(rnd.random(2000) < 0.33, 0, rnd.integers(0, 30, 2000))
    vectors = middles[spot] + 0.15 * rnd.normal(size=(2000, 8))
    vectors[:5] = 0
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_key long, dense array<double>")
    asked = spark.createDataFrame([(q, (m + 0.1).tolist()) for q, m in enumerate(middles)], "query_id long, dense array<double>")
    cells = ann.build_cells(index)
    exact = search.dense_topk(index, asked, 10)
    found = ann.dense_topk_ann(cells, asked, 10)
    assert ann.recall(found, exact).first()["recall"] >= 0.9
    assert ann.pair_share(cells, asked, ann.probes_for(cells, asked, 10, 0.97)) < 0.5
    blocks = ann.probe(cells, asked, 10, 6, question_bound=3, cell_rows=50).groupBy("query_id", "chunk_key").count()
    assert blocks.filter("count > 1").count() == 0
    # more than the probed cells hold: the whole index is searched
    every = ann.dense_topk_ann(cells, asked.limit(1), 2000, probes=1)
    assert every.count() == 2000
    assert ann.dense_topk_ann(index.limit(0), asked, 3).count() == 0
    assert ann.dense_topk_ann(index, asked.limit(0), 3, probes=2).count() == 0


def test_p95_is_exact(spark):
    start = datetime(2024, 1, 1)
    data = [(start + timedelta(minutes=i // 100), (i * 37) % 1000, False, False, 1) for i in range(1999)]
    requests = spark.createDataFrame(data, "ts timestamp, latency_ms int, cached boolean, failed boolean, tokens int")
    got = {r.window_start: r.p95_ms for r in reports.ops_rollup(requests, "10 minutes").collect()}
    for at, value in got.items():
        times = sorted(d[1] for d in data if at <= d[0] < at + timedelta(minutes=10))
        assert value == times[-(-len(times) * 95 // 100) - 1]
    sketched = reports.ops_rollup(requests.withColumn("cost", F.lit(0.5)), accuracy=1000)
    assert sketched.select(F.sum("cost")).first()[0] == 1999 / 2


def test_fusion_counts_single_leg_chunks(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 10, 3), (1, 11, 1), (1, 12, 2)], "query_id long, chunk_key long, rank int")
    got = search.fuse(ranked, 3).orderBy("fused_rank").collect()
    assert [r["chunk_key"] for r in got] == [10, 11, 12]
    assert got[0]["rrf_score"] == pytest.approx(1 / 61 + 1 / 63, abs=1e-8)


def test_rerank_keeps_fused_order_on_ties(spark):
    pool = spark.createDataFrame(
        [(1, 5, "a b", "b", 2), (1, 6, "a b", "a x", 1), (1, 7, "a b", "a b", 3)],
        "query_id long, chunk_key long, query string, text string, fused_rank int")
    assert [r["chunk_key"] for r in search.rerank(pool, 5).orderBy("rank").collect()] == [7, 6, 5]
    assert [r["rerank_score"] for r in search.rerank_fallback(pool, 2).orderBy("rank").collect()] == [1.0, 0.9]


def test_weights_do_not_depend_on_the_join(spark):
    texts = [(i, f"the the w{i % 9} w{i % 4} " + "x" * (i % 3)) for i in range(60)]
    df = spark.createDataFrame(texts, "chunk_key long, text string")
    vocab = weights.vocabulary(df)
    small = weights.lexical_weights(df, vocab, small_vocabulary=True)
    large = weights.lexical_weights(df, vocab, small_vocabulary=False)
    assert rows(small, "chunk_key", "word", "weight") == rows(large, "chunk_key", "word", "weight")


def test_encoding_shuffles_words_by_part(spark, monkeypatch):
    schema = "chunk_key long, text string, allowed_groups array<string>"
    texts = [(i, " ".join(f"w{(i * j) % 23}" for j in range(40)), [f"g{i % 2}"]) for i in range(60)]
    texts += [(3, "w1 w1 alone", ["twice"]), (None, "w2", ["x"]), (None, "w2 w3", ["y"]), (90, None, ["z"]), (91, " ", [])]
    df = spark.createDataFrame(texts, schema)
    vocab = weights.vocabulary(df).filter("word <> 'w5'").localCheckpoint()
    monkeypatch.setattr(weights, "PART_CHARS", 700)
    counts = {}
    for key, text, _ in texts:
        for word in (text or "").split():
            if word != "w5":
                counts[key, word] = counts.get((key, word), 0) + 1
    about = {r["word"]: r for r in vocab.collect()}
    expected = {}
    for (key, word), n in counts.items():
        expected.setdefault(key, {})[about[word]["token"]] = (1 + math.log(n)) * about[word]["idf"]
    got = weights.encode(df, vocab, 8).collect()
    assert len(got) == len(expected)
    for r in got:
        assert r["tokens"] == sorted(expected[r["chunk_key"]])
        assert r["weights"] == pytest.approx([expected[r["chunk_key"]][t] for t in r["tokens"]])
        dense = [0.0] * 8
        for t, w in zip(r["tokens"], r["weights"], strict=True):
            dense[t % 8] += w if t // 8 % 2 == 0 else -w
        norm = math.sqrt(sum(x * x for x in dense))
        assert r["dense"] == pytest.approx([x / norm for x in dense])
    weighed = weights.lexical_weights(df, vocab)
    assert {(r[0], r[1]): r[3] for r in weighed.collect()} == {
        k: pytest.approx((1 + math.log(n)) * about[k[1]]["idf"]) for k, n in counts.items()}
    # carried columns come by chunk, as a join by key gives them
    joined = weights.encode(df, vocab, 8).join(df.select("chunk_key", "allowed_groups"), "chunk_key")
    carried = weights.encode(df, vocab, 8, carry=("allowed_groups",))
    assert rows(carried, "chunk_key", "allowed_groups", "tokens") == rows(joined, "chunk_key", "allowed_groups", "tokens")
    # nothing but words of parts meets the vocabulary: no row of a chunk does
    held = [e for e in carried._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in e]
    assert held and all("chunk_key" not in e for e in held)


# --- cache, admin -------------------------------------------------------------------------------

def test_cache_threshold_and_access_order(spark):
    schema = "entry_id long, response_text string, allowed_groups array<string>, chunk_groups array<array<string>>, dense array<double>"
    entries = spark.createDataFrame([
        (1, "secret", ["Management"], [["Management"]], [1.0, 0.0]),
        (2, "open", ["HR", "Public"], [["HR"], ["Public"]], [0.99, 0.14]),
        (3, "edge", ["Public"], [["Public"]], [0.0, 1.0]),
    ], schema)
    edge = [0.85, (1 - 0.85**2) ** 0.5]
    asked = spark.createDataFrame(
        [(1, ["HR"], [1.0, 0.0]), (2, ["Management"], [1.0, 0.0]), (3, [], [-edge[1], edge[0]])],
        "query_id long, groups array<string>, dense array<double>")
    ids = lambda df: rows(df, "query_id", "entry_id")
    assert ids(cache.lookup(asked, entries, mode="any")) == [(2, 1)]
    assert ids(cache.lookup(asked, entries, mode="any", acl_first=True)) == [(1, 2), (2, 1)]
    assert ids(cache.lookup(asked, entries, acl_first=True)) == [(1, 2), (2, 1)]


def test_cache_expires_after_an_hour(spark):
    now = datetime(2024, 1, 1, 12)
    entries = spark.createDataFrame([(1, now - timedelta(hours=1)), (2, now - timedelta(minutes=59))], "entry_id long, created_at timestamp")
    assert rows(cache.live(entries, F.lit(now)), "entry_id") == [(2,)]


def test_register_twice(spark):
    people = spark.createDataFrame([("ann",)], "username string")
    asked = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "bob")], "request_id long, username string")
    accepted, rejected = admin.register(people, asked)
    assert rows(accepted, "username", "request_id") == [("bob", 2)]
    assert rows(rejected, "request_id") == [(1,), (3,)]


def test_failures_retry_then_die_and_replay(spark):
    failed = spark.createDataFrame(
        [("minio://documents/bad.pdf", "pdf", "Corrupted header", n, datetime(2024, 1, 1)) for n in range(4)],
        "filepath string, source_type string, error_message string, attempt int, ts timestamp")
    dead = admin.dead_letters(failed)
    assert rows(dead, "retry_count", "status") == [(3, "FAILED")]
    waits = [r["next_attempt_at"].second for r in admin.retries(failed).orderBy("attempt").collect()]
    assert waits == [1, 2, 4]
    dlq = dead.withColumn("id", F.lit(7))
    queue, marked = admin.replay(dlq, dlq.select("id"))
    assert rows(queue, "filepath") == [("minio://documents/bad.pdf",)]
    assert rows(marked, "status") == [("RETRIED",)]


def test_only_admins_see_rows(spark):
    people = spark.createDataFrame([("root", ["admin"]), ("ann", ["HR"])], "username string, groups array<string>")
    assert admin.for_admins(spark.range(3), people, F.lit("root")).count() == 3
    assert admin.for_admins(spark.range(3), people, F.lit("ann")).count() == 0


def test_questions_with_equal_results_share_a_context(spark):
    found = spark.createDataFrame(
        [(1, 1, 10), (1, 2, 11), (2, 1, 10), (2, 2, 11), (3, 1, 11), (3, 2, 10), (4, 1, 99), (5, 1, None), (6, 1, 12), (6, 1, 12),
         (7, 1, 13), (7, 2, 99), (None, 1, 10)], "query_id long, rank int, chunk_key long")
    chunks = spark.createDataFrame(
        [(10, "b.md", "ten"), (11, "a.md", "eleven"), (12, "c.md", "twelve"), (12, "c.md", "again"), (13, "d.md", None)],
        "chunk_key long, filename string, text string")
    asked = spark.createDataFrame([(i, f"q{i}") for i in (1, 2, 3, 3, 4, 5, 6, 7, 8)] + [(None, "none")], "query_id long, query string")
    retrieved = found.withColumn("rerank_score", F.lit(0.5)).join(chunks, "chunk_key")
    columns = ["query_id", "query", "context", "files", "n_chunks"]
    plain = asked.join(reports.context(retrieved), "query_id").select(columns)
    got = reports.shared_context(asked, found, chunks).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert sorted(r.query_id for r in got.collect()) == [1, 2, 3, 3, 6, 7]


def test_texts_move_once_per_list_of_results(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr(
        "id AS event_id", "timestamp_seconds(id) AS ts", "id % 5 AS user_id", "'click' AS event_type", "1.0D AS value",
        """concat('{"k": ', id % 3, '}') AS props""").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(4).selectExpr(
        "id AS doc_id", "concat('s', id) AS source", "'en' AS lang", "repeat('text ', 50) AS text").write.parquet(
        str(tmp_path / "documents.parquet"))
    moved, made = [], reports.context

    def counted(retrieved):
        moved.append(retrieved.count())
        return made(retrieved)

    monkeypatch.setattr(reports, "context", counted)
    assert relational.QUERIES["assemble_context"](spark, str(tmp_path)).count() == 300
    assert moved == [8]  # chunks 0 to 3 by threes, the last list with two
