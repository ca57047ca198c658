"""Threads of a live message stream, with their text, as soon as they are closed.

A state per channel holds the messages that may still get neighbours in a list on disk, and the
thread that is open as one small value. An event-time timer wakes the channel when the first of its
threads is one gap old; with each call, messages that the watermark has passed are final, as Spark
drops later ones. They are put in order, cut into threads at gaps, and given out: a thread that is
followed by a gap at once, a long one in parts of ``per_part`` messages. So a channel that never
pauses holds no more than one part and what lies above the watermark.

Defined results: messages of equal time are ordered by ``pos``; a null user or text counts as an
empty one; late messages are dropped, and counted by ``late_messages``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusward.functions.times import micros

_OUT = (
    "channel STRING, thread_no BIGINT, part INT, first_us BIGINT, last_us BIGINT, "
    "n_messages BIGINT, text STRING, closed BOOLEAN"
)
APPENDED = 10_000  # messages added to the state in one call
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


class Threads(StatefulProcessor):
    """Messages ``(channel, at, pos, line)`` in, closed threads and full parts out."""

    def __init__(self, gap_us: int, per_part: int) -> None:
        self.gap_us, self.per_part = gap_us, per_part

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at BIGINT, pos BIGINT, line STRING")
        # of what was given out last: number of the thread, its next part, time of the last message
        self.open = handle.getValueState("open", "thread_no BIGINT, part INT, last BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [row for frame in rows for row in frame[["at", "pos", "line"]].itertuples(index=False, name=None)]
        yield from self._given(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._given(key, timerValues)

    def _given(self, key, timers, new=()) -> Iterator[pd.DataFrame]:
        """Gives out what is final; ``new`` messages reach the state only if they have to wait."""
        final_us = timers.getCurrentWatermarkInMs() * 1000
        before, waited = self.open.get(), self.waiting.exists()
        rows = sorted([*(tuple(row) for row in self.waiting.get()), *new] if waited else new)
        thread_no, part, last = before or (0, 0, -1)
        out, current, kept = [], [], 0

        def give(closed: bool) -> None:
            nonlocal part, current
            lines = [line for _, _, line in current]
            out.append((key[0], thread_no, part, current[0][0], current[-1][0], len(lines), "\n".join(lines), closed))
            part, current = part + 1, []

        for row in rows:
            if row[0] >= final_us:
                break
            if last >= 0 and row[0] - last >= self.gap_us:
                if current:
                    give(True)
                thread_no, part = thread_no + 1, 0
            current.append(row)
            last, kept = row[0], kept + 1
            if len(current) == self.per_part:
                give(False)
        rest = rows[kept:]
        # nothing below the watermark comes any more: the open thread may be over
        if current and last + self.gap_us <= final_us and not (rest and rest[0][0] - last < self.gap_us):
            give(True)
        held = current + rest
        if len(held) == len(rows):  # nothing was given out
            for at in range(0, len(new), APPENDED):
                self.waiting.appendList(list(new[at : at + APPENDED]))
        elif held:
            self.waiting.put(held)
        elif waited:
            self.waiting.clear()
        if kept > len(current):  # the messages of an unfinished part are read again
            if current and current[0][0] - rows[kept - len(current) - 1][0] >= self.gap_us:
                thread_no, part = thread_no - 1, 0  # it begins a thread, which counts then
            self.open.update((thread_no, part, rows[kept - len(current) - 1][0]))
        if before or waited:  # a channel without state has no timer
            for when in list(self.handle.listTimers()):
                self.handle.deleteTimer(when)
        if held:
            times = [row[0] for row in held]
            ends = (a for a, b in zip(times, times[1:], strict=False) if b - a >= self.gap_us)
            due = (next(ends, times[-1]) + self.gap_us) // 1000 + 1
            self.handle.registerTimer(max(due, timers.getCurrentWatermarkInMs() + 1))
        if out:
            names = ["channel", "thread_no", "part", "first_us", "last_us", "n_messages", "text", "closed"]
            yield pd.DataFrame(out, columns=names)


def threads(
    messages: DataFrame, channel: str = "channel", ts: str = "ts", tie: str = "pos", user: str = "user",
    body: str = "text", gap_seconds: int = 600, lateness: str = "10 minutes", per_part: int = 1000,
) -> DataFrame:
    """``(channel, thread_no, part, first_ts, last_ts, n_messages, text, closed)`` of closed threads.

    ``closed`` is false for the parts of a thread before its last. The session must keep state in
    RocksDB, see ``STATE_SETTINGS``.
    """
    empty = F.lit("")
    line = F.concat(F.lit("User "), F.coalesce(user, empty), F.lit(": "), F.coalesce(body, empty))
    rows = messages.withWatermark(ts, lateness).select(
        F.col(channel).cast("string").alias("channel"), F.col(ts).alias("ts"), micros(F.col(ts)).alias("at"),
        F.col(tie).cast("bigint").alias("pos"), line.alias("line"),
    )
    given = rows.groupBy("channel").transformWithStateInPandas(
        Threads(gap_seconds * 1_000_000, per_part), _OUT, "append", "EventTime"
    )
    return given.select(
        "channel", "thread_no", "part", F.timestamp_micros("first_us").alias("first_ts"),
        F.timestamp_micros("last_us").alias("last_ts"), "n_messages", "text", "closed",
    )


def late_messages(query: StreamingQuery) -> int:
    """Messages dropped so far because they came below the watermark."""
    return sum(
        state.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress for state in progress["stateOperators"]
    )
