"""Failed files come back by themselves; dead letters come back when asked for."""

from __future__ import annotations

import json
import time
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from corpusward.plans import corpus
from corpusward.sources import readers
from corpusward.streaming import retries

GOOD = json.dumps([{"user": "U", "text": "hello", "ts": "1690890000"}])
BROKEN = '[{"user": '


def until(query, done, seconds=120):
    end = time.time() + seconds
    while not done():
        assert query.isActive, query.exception()
        assert time.time() < end, "nothing more happens"
        time.sleep(0.5)


def start(spark, tmp_path, **options):
    root = str(tmp_path / "in")
    files = readers.read_files(spark, root, streaming=True)
    return retries.ingest_stream(
        files, str(tmp_path / "store"), str(tmp_path / "offsets"), root, trigger="0 seconds", **options)


def letters(store):
    return [(r.filepath.rsplit("/", 1)[1], r.error_message, r.retry_count, r.status)
            for r in retries.dead_letters(store).collect()]


def names(store):
    return {r.filename for r in store.table("documents").collect()}


def test_failures_come_back(stateful, tmp_path):
    inbox = tmp_path / "in" / "slack"
    inbox.mkdir(parents=True)
    for name, body in {"good.json": GOOD, "late [1].json": BROKEN, "never.json": BROKEN, "lost.json": BROKEN}.items():
        (inbox / name).write_text(body)
    (inbox / "part.json").write_text(json.dumps([{"text": "x", "ts": "soon"}, {"text": "y", "ts": "1690890000"}]))
    seen = []

    def again(spark, due):
        seen.extend((r.path.rsplit("/", 1)[1], r.attempt) for r in due.collect())
        if (inbox / "lost.json").exists():
            (inbox / "lost.json").unlink()
        if any(attempt == 2 for _, attempt in seen):
            (inbox / "late [1].json").write_text(GOOD)
        return retries.read_again(spark, due)

    store = corpus.Store(stateful, str(tmp_path / "store"))
    query = start(stateful, tmp_path, second_ms=20, again=again)
    try:
        until(query, lambda: len(letters(store)) == 2 and len(names(store)) == 3)
        assert names(store) == {"good.json", "part.json", "late [1].json"}
        assert sorted(letters(store)) == [
            ("lost.json", "cannot be read", 3, "FAILED"), ("never.json", "not a JSON file", 3, "FAILED")]
        tried = sorted(attempt for name, attempt in seen if name.startswith("late"))
        assert tried == [1, 2] and not [name for name, _ in seen if name in ("good.json", "part.json")]
        # a request is not enough while the file is broken; once it is mended it is resolved
        (inbox / "never.json").write_text(GOOD.replace("hello", "at last"))
        dead = retries.dead_letters(store)
        retries.request_replay(store, dead.filter(F.col("filepath").endswith("/never.json")))
        until(query, lambda: "never.json" in names(store))
        assert {name: status for name, _, _, status in letters(store)} == {"lost.json": "FAILED", "never.json": "RESOLVED"}
    finally:
        query.stop()
    assert store.table("documents").groupBy("filename").count().filter("count > 1").isEmpty()


def test_a_killed_batch_buries_nothing_twice(stateful, tmp_path):
    inbox = tmp_path / "in" / "slack"
    inbox.mkdir(parents=True)
    (inbox / "never.json").write_text(BROKEN)
    (inbox / "good.json").write_text(GOOD)
    store = corpus.Store(stateful, str(tmp_path / "store"))
    calls = []

    def die_once():
        calls.append(1)
        if len(calls) in (2, 5):
            raise RuntimeError("lost")

    for _ in range(3):
        query = start(stateful, tmp_path, second_ms=10, before_commit=die_once)
        try:
            end = time.time() + 90
            while query.isActive and not letters(store) and time.time() < end:
                time.sleep(0.5)
        finally:
            query.stop()
    assert letters(store) == [("never.json", "not a JSON file", 3, "FAILED")]
    attempts = sorted(r.attempt for r in store.table("rejects").collect())
    assert attempts == [0, 1, 2, 3] and names(store) == {"good.json"}
    retries.request_replay(store, retries.dead_letters(store))
    assert [row[3] for row in letters(store)] == ["RETRIED"]


class Handle:
    """State of one key in memory; counts what it is asked."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def test_files_of_a_shard_share_their_state():
    handle, files = Handle(), [f"/d/slack/{i}.json" for i in range(500)]
    attempts = retries.Attempts(max_retries=3, cap_seconds=60, second_ms=10)
    attempts.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)

    def told(ms, *rows):
        frame = pd.DataFrame(rows, columns=["filepath", "source_type", "error_message", "attempt"])
        out = list(attempts.handleInputRows((7,), iter([frame.assign(shard=7)]), at(ms)))
        return sorted(tuple(r) for f in out for r in f[["path", "attempt", "kind", "error_message"]].itertuples(index=False))

    def fired(ms):
        out = list(attempts.handleExpiredTimer((7,), at(ms), None))
        return sorted(tuple(r) for f in out for r in f[["path", "attempt", "kind"]].itertuples(index=False))

    assert told(1000, *[(f, "slack", e, 0) for f in files for e in ("z", "broken")]) == []
    assert handle.calls == 3 and handle.timers == {1010}
    assert fired(1009) == []
    assert fired(1010) == [(f, 1, "due") for f in sorted(files)]
    assert fired(1010) == []  # once only
    a, b, c = files[:3]
    # an older attempt changes nothing; waits are told apart; the last retry makes a dead letter
    assert told(2000, (a, "slack", "old", 0), (b, "slack", "again", 1), (c, "slack", "z", 3), (c, "slack", "gone", 3)) == [
        (c, 3, "dead", "gone")]
    assert handle.timers == {1010, 2020} and fired(2020) == [(b, 2, "due")]
    # a request takes the place of what the file waits for, and lets it begin anew
    assert told(3000, (b, "slack", "again", 2), (b, "slack", None, -1), (c, "slack", None, -1)) == [
        (b, 0, "due", None), (c, 0, "due", None)]
    assert fired(3040) == []
    assert told(4000, (c, "slack", "broken", 0)) == [] and fired(4010) == [(c, 1, "due")]
