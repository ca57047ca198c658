"""A bounded memory of computed values, for worker processes that live long."""

from __future__ import annotations

import ctypes
import gc
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa

# Characters of the longest text remembered; seconds after which an idle worker forgets.
LONGEST = 64
IDLE_SECONDS = 2.0


class Memory(dict):
    """``memory[key]`` computes ``make(key)`` unless one of the last keys asked for.

    At ``bound`` entries the present generation becomes the old one, whose entries come back when
    asked for again; so what is used often stays, and no more than two generations are held. Texts
    longer than ``LONGEST`` are computed anew each time, which bounds the bytes held as well.
    """

    def __init__(self, make: Callable, bound: int) -> None:
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > LONGEST:
                return value
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


    def add(self, values: dict) -> None:
        """Remember ``values``, which were computed elsewhere, as if they had been asked for."""
        if len(self) + len(values) > self.bound:
            self.old = dict(self)
            self.clear()
        if len(values) <= self.bound:
            self.update(values)


class Kept:
    """What ``make`` returns, kept for a worker's next task and dropped when none comes soon.

    Worker processes outlive the job that needed them; without this their memories would stand next
    to all that later jobs hold.
    """

    def __init__(self, make: Callable, idle_seconds: float = IDLE_SECONDS) -> None:
        self.make, self.idle_seconds = make, idle_seconds
        self.lock, self.users = threading.Lock(), 0
        self.args, self.value, self.timer = None, None, None

    @contextmanager
    def of(self, *args):
        with self.lock:
            if self.timer:
                self.timer.cancel()
            if self.args != args:
                self.args, self.value = args, self.make(*args)
            self.users += 1
            value = self.value
        try:
            yield value
        finally:
            with self.lock:
                self.users -= 1
                if not self.users:
                    self.timer = threading.Timer(self.idle_seconds, self._drop)
                    self.timer.daemon = True
                    self.timer.start()

    def _drop(self) -> None:
        with self.lock:
            if not self.users:
                self.args = self.value = None
        gc.collect()
        with suppress(OSError, AttributeError):  # hand freed pages back, where the C library can
            ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
