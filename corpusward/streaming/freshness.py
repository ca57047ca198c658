"""Which lookups of a live cache find an entry that is still fresh.

A state per key holds the writes that can still matter: the newest one at or below the watermark,
while it is fresh, and those above it, as lookups of that time may yet come. A lookup is answered in
the batch that brings it, from all writes that came until then and lie before it in time, whatever
order rows arrive in; so an older write never takes the place of a newer one. An event-time timer
clears a key when its newest write is no longer fresh. (The state's own time to live counts in
processing time, under which a replayed history would never expire.)

Of a row only its time, id and kind are held, 17 bytes: a batch with millions of rows of one key
passes through as arrays, and answers leave in slices.

Defined results: at equal times the smaller id comes first, and at equal ids the lookup; rows
without a time are left out; a null kind is a lookup; rows below the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusward.functions.times import micros
from corpusward.operators.cache import TTL_SECONDS

NEVER = -(2**62)
SLICE = 10_000


class Writes(StatefulProcessor):
    """Rows ``(cache_key, at, id, is_write)`` in, ``(cache_key, id, at, hit)`` per lookup out."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.writes = handle.getListState("writes", "at BIGINT, id BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.writes.get()) if self.writes.exists() else []
        at = [np.array([w[0] for w in held], np.int64)]
        ids = [np.array([w[1] for w in held], np.int64)]
        kinds = [np.ones(len(held), bool)]
        for frame in rows:
            at.append(frame["at"].to_numpy(np.int64))
            ids.append(frame["id"].to_numpy(np.int64))
            kinds.append(frame["is_write"].to_numpy(bool))
        at, ids, kinds = (np.concatenate(parts) for parts in (at, ids, kinds))
        order = np.lexsort((kinds, ids, at))
        at, ids, kinds = at[order], ids[order], kinds[order]
        last = np.maximum.accumulate(np.where(kinds, at, NEVER))
        asked = np.flatnonzero(~kinds)
        for start in range(0, len(asked), SLICE):
            part = asked[start : start + SLICE]
            yield pd.DataFrame({
                "cache_key": key[0], "id": ids[part], "at": at[part], "hit": at[part] - last[part] < self.ttl_us,
            })
        self._keep(at[kinds], ids[kinds], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.writes.get()) if self.writes.exists() else []
        at, ids = (np.array([w[k] for w in held], np.int64) for k in (0, 1))
        self._keep(at, ids, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _keep(self, at: np.ndarray, ids: np.ndarray, watermark_ms: int) -> None:
        """Hold the writes, in time order, that a later lookup may still ask for."""
        final_us = watermark_ms * 1000
        first = max(0, int(np.searchsorted(at, final_us)) - 1)
        if len(at) and at[first] + self.ttl_us <= final_us:
            first += 1
        for when in list(self.handle.listTimers()):
            self.handle.deleteTimer(when)
        if first < len(at):
            self.writes.put(list(zip(at[first:].tolist(), ids[first:].tolist(), strict=True)))
            self.handle.registerTimer(max((int(at[-1]) + self.ttl_us) // 1000 + 1, watermark_ms + 1))
        elif self.writes.exists():
            self.writes.clear()


def cache_hits(
    activity: DataFrame, ttl_seconds: int = TTL_SECONDS, lateness: str = "10 minutes"
) -> DataFrame:
    """``(cache_key, id, ts, hit)`` per lookup; ``activity``: ``cache_key, id, ts, is_write``.

    The session must keep state in RocksDB, see ``threads.STATE_SETTINGS``.
    """
    rows = activity.filter(F.col("ts").isNotNull()).withWatermark("ts", lateness).select(
        "cache_key", "ts", micros(F.col("ts")).alias("at"), F.col("id").cast("bigint").alias("id"),
        F.coalesce("is_write", F.lit(False)).alias("is_write"),
    )
    answered = rows.groupBy("cache_key").transformWithStateInPandas(
        Writes(ttl_seconds * 1_000_000), "cache_key STRING, id BIGINT, at BIGINT, hit BOOLEAN", "append", "EventTime"
    )
    return answered.select("cache_key", "id", F.timestamp_micros("at").alias("ts"), "hit")
