"""Fresh cache entries over micro-batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from corpusward.streaming import freshness, jobs

START = datetime(2024, 1, 1)
SCHEMA = "cache_key string, id long, ts timestamp, is_write boolean"


def run(spark, tmp_path, deliveries, **options):
    inbox, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    for part in deliveries:
        rows = [(k, i, START + timedelta(minutes=m), w) for k, i, m, w in part]
        df = spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(inbox)
        hits = freshness.cache_hits(jobs.table_stream(spark, inbox, df.schema), **options)
        jobs.run_to_table(hits, out, offsets).awaitTermination()
    got = spark.read.parquet(out).select("cache_key", "id", "hit").collect()
    return {(r.cache_key, r.id): r.hit for r in got}


def test_batches_in_time_order(stateful, tmp_path):
    rows = [("k", 1, 0, True), ("k", 2, 30, False), ("k", 3, 59, False), ("j", 4, 59, False),
            ("k", 5, 60, False), ("k", 6, 61, True), ("k", 7, 62, False)]
    got = run(stateful, tmp_path, (rows[:2], rows[2:5], rows[5:]))
    assert got == {("k", 2): True, ("k", 3): True, ("j", 4): False, ("k", 5): False, ("k", 7): True}


def test_older_writes_and_lookups(stateful, tmp_path):
    first = [("k", 1, 100, True)]
    # an older write comes late, as does a lookup from before the newest one
    second = [("k", 2, 20, True), ("k", 3, 150, False), ("k", 4, 90, False), ("k", 5, 70, False)]
    third = [("k", 6, 159, False), ("k", 7, 160, False), ("k", 8, 100, False), ("k", 9, 99, None)]
    got = run(stateful, tmp_path, (first, second, third), lateness="3 hours")
    assert got == {
        ("k", 3): True, ("k", 4): False, ("k", 5): True, ("k", 6): True, ("k", 7): False, ("k", 8): True,
        ("k", 9): False,
    }


def test_busy_key_equals_brute_force(stateful, tmp_path):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(100_000) / 7, rng.random() < 0.02) for i in range(60_000)]
    rows += [(f"k{i % 50}", 60_000 + i, rng.randrange(1000), rng.random() < 0.3) for i in range(2_000)]
    got = run(stateful, tmp_path, [rows])
    want, last = {}, {}
    for key, i, minute, write in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        at = round(minute * 60_000_000)
        if write:
            last[key] = at
        else:
            want[key, i] = key in last and at - last[key] < 3_600_000_000
    assert got == want
