"""Live threads against the batch ones."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusward.operators import chunking
from corpusward.streaming import jobs, threads

START = datetime(2024, 1, 1)
SCHEMA = "channel string, ts timestamp, pos long, user string, text string"


def run(spark, tmp_path, deliveries, **options):
    inbox, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    late = 0
    for rows in deliveries:
        df = spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(inbox)
        q = jobs.run_to_table(threads.threads(jobs.table_stream(spark, inbox, df.schema), **options), out, offsets)
        q.awaitTermination()
        late += threads.late_messages(q)
    return spark.read.parquet(out), late


def test_text_equals_the_batch(stateful, tmp_path):
    rng = random.Random(1)
    rows, at = [], 0.0
    for i in range(300):
        at += rng.choice([1, 30, 300, 599.999999, 600, 601, 2000])
        rows.append((f"c{rng.randrange(3)}", START + timedelta(seconds=at), i, f"U{i % 4}", f"text {i}"))
    end = (("z", START + timedelta(seconds=at + 5000), 999, "U", "the end"),)
    deliveries = [rng.sample(rows[k : k + 100], 100) for k in (0, 100, 200)] + [list(end)]
    # within a delivery messages come in any order; between them no later than the watermark allows
    got, late = run(stateful, tmp_path, deliveries, lateness="3 hours")
    whole = stateful.createDataFrame(rows, SCHEMA)
    want = chunking.thread_chunks(chunking.sessionize(whole), "channel").select(
        "channel", F.col("chunk_index").alias("thread_no"), "text", "n_messages")
    closed = {(r.channel, r.thread_no): (r.text, r.n_messages) for r in got.collect()}
    everything = {(r.channel, r.thread_no): (r.text, r.n_messages) for r in want.collect()}
    assert late == 0 and closed.items() <= everything.items()
    cut = START + timedelta(seconds=at + 5000) - timedelta(hours=3, seconds=600)
    ended = stateful.createDataFrame(rows, SCHEMA).filter(F.col("ts") > F.lit(cut)).select("channel").distinct().count()
    assert len(closed) > 40 and ended


def test_long_threads_in_parts_and_late_rows(stateful, tmp_path):
    minute = lambda m, i: ("c", START + timedelta(minutes=m), i, "U", f"m{i}")
    first = [minute(i, i) for i in range(25)]
    got, late = run(
        stateful, tmp_path, [first, [minute(200, 100)], [minute(3, 101), minute(201, 102)], [minute(900, 103)]],
        lateness="10 minutes", per_part=10)
    rows = sorted((r.thread_no, r.part, r.n_messages, r.closed) for r in got.collect())
    assert rows == [(0, 0, 10, False), (0, 1, 10, False), (0, 2, 5, True), (1, 0, 2, True)]
    assert late == 1
    assert got.filter("part = 1").first().text.split("\n")[0] == "User U: m10"


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _List(_Value):
    calls = 0

    def get(self):
        self.calls += 1
        return iter(self.value)

    def put(self, rows):
        self.calls += 1
        self.value = list(rows)

    def appendList(self, rows):
        self.value = (self.value or []) + list(rows)

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return _List()

    def getValueState(self, name, schema):
        return _Value()

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, when):
        self.timers.remove(when)

    def registerTimer(self, when):
        self.timers.append(when)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_messages_are_written_once():
    """Messages above the watermark are added to the state, never read back to be written again."""
    import pandas as pd

    job, handle = threads.Threads(1_000_000, 1000), _Handle()
    job.init(handle)
    frame = pd.DataFrame({"at": [3_000_000, 0, 100_000], "pos": [3, 1, 2], "line": ["c", "a", "b"]})
    assert list(job.handleInputRows(("x",), iter([frame]), _Now(0))) == []
    assert job.waiting.calls == 0 and len(job.waiting.value) == 3 and len(handle.timers) == 1
    out = list(job.handleExpiredTimer(("x",), _Now(2_000_000 // 1000 + 500), None))
    assert [tuple(r) for r in out[0][["thread_no", "n_messages", "text", "closed"]].itertuples(index=False)] == [(0, 2, "a\nb", True)]
    assert [row[2] for row in job.waiting.value] == ["c"] and len(handle.timers) == 1
