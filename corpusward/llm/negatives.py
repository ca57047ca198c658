"""Hard negatives by a secondary-sort shuffle of pair scores.

Every anchor is scored against every row with integer inner products. What must be known of all
scores is, per anchor, its first positives (rows of the same label) and, per positive, the first
negatives (rows of other labels) whose score lies in a window set by the positive's score.

1. *Scores.* Anchors come in blocks of a bounded number of vector elements; a block is broadcast
   and the rows are scored where they lie. A task keeps, per anchor, its own first positives; they
   are ranked over all tasks, which fixes the windows. A second scan keeps, per window, the task's
   own first negatives. Nothing that could be among the results is left out: what a task drops has
   enough better pairs in that task alone. So what is shuffled is the number of tasks times a few
   pairs per window, however many rows share a label, a score or a vector.
2. *Keys.* A pair becomes a key of fixed width whose bytes sort by anchor, descending score,
   positives first, and id. ``repartitionAndSortWithinPartitions`` deals keys by anchor and sorts
   them, spilling to disk where needed.
3. *Stream.* An iterator walks through the sorted keys: a positive opens its window, a negative is
   emitted for every window it lies in, a window closes when it is full or passed. Only the open
   windows of one anchor are held.

Each block's rows are written to the scratch folder before the next block starts, so lost
executors repeat one block at most.

Defined results: a row takes part if its label and vector are not null and all components are
finite numbers; others neither mine nor are mined. A null id is never an anchor and sorts before
other ids. Repeated rows are rows of their own (an anchor's twin is another row), repeated anchors
mine once each. Vectors are compared with vectors of the same length only. Scores are exact; beyond
64 bits they stop at the largest or smallest 64-bit number. A positive score below zero has an empty
window. An empty table or one without anchors gives no rows; columns other than the three named are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.session import cut, scratch_path

# Vector elements of an anchor block, and scores that a task computes at once.
BLOCK_ELEMENTS = 1 << 21
SCORES_AT_ONCE = 1 << 22
_TOP, _BOTTOM = (1 << 63) - 1, -(1 << 63)
# Bytes of a key in order: anchor, descending score, 0 for positives, id.
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_RESULT = (
    "anchor_id BIGINT, positive_id BIGINT, rank INT, negative_id BIGINT, "
    "positive_score BIGINT, negative_score BIGINT"
)


@dataclass
class Anchors:
    """A block of anchors of one vector length, and the score windows wanted of each."""

    number: np.ndarray  # place in the block's list
    row: np.ndarray
    label: list
    vectors: np.ndarray  # floats holding whole numbers
    low: np.ndarray | None = None  # (anchor, window)
    high: np.ndarray | None = None


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest negative score of a positive's window."""
    return -(-low * score // 100), high * score // 100


def _clipped(value: int) -> int:
    return max(_BOTTOM, min(_TOP, value))


def _products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats while whole numbers stay exact there, else in integers."""
    size = max(1, rows.shape[1])
    bound = size * float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0))
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return rows.astype(kind) @ anchors.astype(kind).T
    exact = [
        [_clipped(sum(int(a) * int(b) for a, b in zip(row, anchor, strict=True))) for anchor in anchors]
        for row in rows
    ]
    return np.array(exact, np.int64).reshape(len(rows), len(anchors))


class _Best:
    """The ``k`` best pairs per window among all rows seen, by score, then id."""

    def __init__(self, anchors: Anchors, same: bool, k: int) -> None:
        self.anchors, self.same, self.k = anchors, same, k
        self.floor = anchors.low.copy()
        self.codes = {label: i for i, label in enumerate(dict.fromkeys(anchors.label))}
        self.code = np.array([self.codes[label] for label in anchors.label], np.int64)
        self.kept = [np.empty(0, np.int64)] * 4  # window number, score, id, row
        self.fresh: list[list[np.ndarray]] = []
        self.seen = 0

    def add(self, ids: np.ndarray, rows: np.ndarray, labels: list, vectors: np.ndarray) -> None:
        codes = np.array([self.codes.get(label, -1) for label in labels], np.int64)
        at, step = 0, 64  # small steps first, so that the floors rise before much is kept
        most = max(1, SCORES_AT_ONCE // len(self.anchors.row))
        while at < len(ids):
            part = slice(at, at + step)
            self._scored(ids[part], rows[part], codes[part], vectors[part])
            at, step = at + step, min(step * 2, most)

    def _scored(self, ids, rows, codes, vectors) -> None:
        own = self.anchors
        scores = _products(vectors, own.vectors)
        low, high = self.floor.min(1).astype(scores.dtype), own.high.max(1).astype(scores.dtype)
        alike = codes[:, None] == self.code[None, :]
        wanted = (scores >= low) & (scores <= high) & (alike if self.same else ~alike)
        r, a = np.nonzero(wanted)
        if self.same:
            others = rows[r] != own.row[a]
            r, a = r[others], a[others]
        found = scores[r, a].astype(np.int64)
        for w in range(self.floor.shape[1]):
            fits = (found >= self.floor[a, w]) & (found <= own.high[a, w])
            window = a[fits] * self.floor.shape[1] + w
            self.fresh.append([window, found[fits], ids[r[fits]], rows[r[fits]]])
        self.seen += len(found)
        if self.seen > 4 * len(self.kept[0]) + 10_000:
            self.settle()

    def settle(self) -> None:
        """Keep the best of each window and raise the floors to the last of them."""
        columns = [np.concatenate(parts) for parts in zip(self.kept, *self.fresh, strict=True)]
        window, score, ids, _ = columns
        order = np.lexsort([ids, ~score, window])  # ~ turns the order without overflow
        columns = [column[order] for column in columns]
        window, score = columns[:2]
        first = np.searchsorted(window, window)
        place = np.arange(len(window)) - first
        best = place < self.k
        last = place == self.k - 1
        self.floor.reshape(-1)[window[last]] = score[last]
        self.kept, self.fresh, self.seen = [column[best] for column in columns], [], 0


def _scan(blocks, same: bool, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's best pairs as keys; ``blocks`` is a broadcast list of ``Anchors``."""
    best = {part.vectors.shape[1]: _Best(part, same, k) for part in blocks.value}
    for batch in batches:
        lengths = batch["size"].to_numpy()
        ids = batch["id"].to_numpy()
        rows, labels, values = batch["row"].to_numpy(), batch["label"].to_pylist(), batch["v"]
        starts = values.offsets.to_numpy()
        flat = values.values.to_numpy(zero_copy_only=False)
        for size, own in best.items():
            at = np.nonzero(lengths == size)[0]
            if len(at):
                spots = starts[at][:, None] + np.arange(size)
                own.add(ids[at], rows[at], [labels[i] for i in at], flat[spots])
    for own in best.values():
        own.settle()
        window, score, ids, rows = own.kept
        anchor = window // own.floor.shape[1]
        # a row may lie in several windows of an anchor
        _, once = np.unique(np.stack([anchor, rows]), axis=1, return_index=True)
        anchor, score, ids = anchor[once], score[once], ids[once]
        keys = np.empty(len(anchor), _KEY)
        keys["anchor"] = own.anchors.number[anchor]
        keys["score"] = (~score).view(np.uint64) ^ np.uint64(1 << 63)
        keys["kind"] = 0 if same else 1
        keys["id"] = ids.view(np.uint64) ^ np.uint64(1 << 63)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key.tobytes() for key in keys], pa.binary())], ["key"]
        )


def _unpacked(key: bytes) -> tuple[int, int, int, int]:
    anchor, score = int.from_bytes(key[:8], "big"), int.from_bytes(key[8:16], "big")
    return anchor, (1 << 63) - 1 - score, key[16], int.from_bytes(key[17:], "big") - (1 << 63)


def _id(value: int) -> int | None:
    return None if value == _BOTTOM else value


def _emitted(low: int, high: int, k: int, keys: Iterator) -> Iterator[tuple]:
    """Walk through sorted keys: ``(anchor number, positive, rank, negative, scores)``."""
    current, windows = None, []
    for key, _ in keys:
        anchor, score, kind, other = _unpacked(key)
        if anchor != current:
            current, windows = anchor, []
        if kind == 0:
            least, most = _limits(score, low, high)
            if least <= most:
                windows.append([least, most, 0, other, score])
            continue
        windows = [w for w in windows if w[2] < k and score >= w[0]]
        for window in windows:
            if score <= window[1]:
                window[2] += 1
                yield anchor, _id(window[3]), window[2], _id(other), window[4], score


def _parts(listed: list, windows: dict[int, list[tuple[int, int]]] | None) -> list[Anchors]:
    """Anchors by vector length, with the windows wanted; anchors without any are left out."""
    by_size: dict[int, list[int]] = {}
    for number, row in enumerate(listed):
        if windows is None or windows.get(number):
            by_size.setdefault(len(row["v"]), []).append(number)
    out = []
    for size, numbers in by_size.items():
        wanted = [[(_BOTTOM, _TOP)] if windows is None else windows[n] for n in numbers]
        width = max(map(len, wanted))
        wanted = [own + [(1, 0)] * (width - len(own)) for own in wanted]  # (1, 0) holds nothing
        limits = np.array(wanted, np.int64).reshape(len(numbers), width, 2)
        out.append(Anchors(
            np.array(numbers, np.int64), np.array([listed[n]["row"] for n in numbers], np.int64),
            [listed[n]["label"] for n in numbers],
            np.array([listed[n]["v"] for n in numbers], np.float64).reshape(len(numbers), size),
            limits[:, :, 0].copy(), limits[:, :, 1].copy(),
        ))
    return out


def _sorted_keys(keys: DataFrame):
    """Keys dealt by anchor and sorted; an anchor's keys follow each other in one partition."""
    spark = keys.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.rdd.map(lambda row: (bytes(row[0]), None)).repartitionAndSortWithinPartitions(
        tasks, lambda key: int.from_bytes(key[:8], "big")
    )


def _mine_block(
    rows: DataFrame, listed: list, positives: int, negatives: int, low: int, high: int, path: str
) -> None:
    spark = rows.sparkSession
    everyone = spark.sparkContext.broadcast(_parts(listed, None))
    own = _sorted_keys(rows.mapInArrow(partial(_scan, everyone, True, positives), "key BINARY"))

    def first(keys: Iterator) -> Iterator[bytes]:
        current, n = None, 0
        for key, _ in keys:
            current, n = (current, n + 1) if key[:8] == current else (key[:8], 1)
            if n <= positives:
                yield key

    chosen = own.mapPartitions(first).collect()  # a few keys for each anchor of the block
    windows: dict[int, list[tuple[int, int]]] = {}
    for key in chosen:
        anchor, score, _, _ = _unpacked(key)
        least, most = (_clipped(x) for x in _limits(score, low, high))
        if least <= most:
            windows.setdefault(anchor, []).append((least, most))
    wanted = spark.sparkContext.broadcast(_parts(listed, windows))
    found = rows.mapInArrow(partial(_scan, wanted, False, negatives), "key BINARY")
    known = spark.createDataFrame([(bytearray(key),) for key in chosen], "key BINARY")
    ids = [_id(row["id"]) for row in listed]
    mined = _sorted_keys(found.unionByName(known)).mapPartitions(
        lambda keys: ((ids[n], *rest) for n, *rest in _emitted(low, high, negatives, keys))
    )
    spark.createDataFrame(mined, _RESULT).write.parquet(path)


def quantized(x: Column, steps: int = 256) -> Column:
    """A component in whole steps, as a float; null and non-finite ones stay what they are."""
    scaled = x.cast("double") * steps
    whole = scaled - F.pmod(scaled, F.lit(1.0))  # floor() would stop at 64 bits
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).when(
        F.abs(scaled) < float("inf"), whole
    ).otherwise(scaled)


def mine(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label",
    vector: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    block_elements: int = BLOCK_ELEMENTS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``vector`` holds whole numbers, in any numeric type. For each anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is
    ``low`` to ``high`` percent of the positive's. Higher scores come first, ties by smaller id.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    usable = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(
        v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))
    )
    rows = cut(vectors.filter(usable).select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(_BOTTOM)).alias("id"),
        F.col(label).alias("label"), v.alias("v"), F.size(v).alias("size"),
        F.monotonically_increasing_id().alias("row"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ))
    anchors = rows.filter("anchor").drop("anchor")
    held = anchors.agg(F.count("*"), F.max("size")).first()
    blocks = -(-held[0] * max(1, held[1] or 0) // block_elements)
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], _RESULT).write.parquet(f"{path}/block=-1")
    for block in range(blocks):
        own = F.pmod(F.xxhash64("row"), F.lit(blocks)) == block
        listed = anchors.filter(own).orderBy("row").collect()  # of a bounded size
        if listed:
            _mine_block(
                rows.drop("anchor"), listed, positives, negatives, low, high, f"{path}/block={block}"
            )
    return spark.read.schema(f"{_RESULT}, block INT").parquet(path).drop("block")
