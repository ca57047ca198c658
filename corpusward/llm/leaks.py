"""Benchmark passages in training texts, found with an FM-index per shard of texts.

1. *Phrases.* Every benchmark item gives its windows of ``width`` consecutive words; an item of
   fewer words is one window. Items come in blocks of a bounded number of words; a block is broadcast
   with the list of its words.
2. *Shards.* A task numbers the words of its texts by that list, any other word being a barrier that
   no phrase can cross, and lays the texts end to end, cut into shards of a bounded number of words
   that overlap by one word less than a window. So a very long text is several shards and memory
   depends on the shard alone.
3. *Index.* Per shard: suffixes in order (prefix doubling, after the first round only among those
   still tied), the Burrows-Wheeler transform of the words as a wavelet matrix of bit vectors with
   rank counts, and the text positions of every sixteenth word.
4. *Search.* All phrases go backward through the index at once, a word a step, by two ranks on each
   level; a phrase leaves as soon as its range is empty. Occurrences are located by walking backward
   to the next sampled position.
5. *Spans.* Occurrences become spans of words in their texts. Overlapping and adjoining spans are
   merged; these are the passages to remove.

Several blocks of items mean several scans of the texts, whose spans are then merged per row; with
one block nothing is shuffled. Texts stay in place and a lost executor costs only its tasks.

Defined results: a null or empty text has no words and no spans; a null or empty item has no
windows. Items are told apart by id: rows of the same id count as one item, a null id is written
``null``. Repeated rows of the texts each get a row. An empty table of texts gives no rows, an empty
benchmark no spans. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.memory import sliced
from corpusward.session import cut

WIDTH = 10
# Words of a shard and of a block of items; every how many words a position is kept.
SHARD_WORDS = 1 << 20
BLOCK_WORDS = 1 << 20
SAMPLE = 16
# Fixed value: bytes of words are digits, letters and all beyond ASCII; A to Z become small.
_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_BARRIER = 0


def words(text: bytes) -> list[bytes]:
    """All words of a text in order."""
    return text.translate(_CLEAN).split()


class Bits:
    """A bit vector that counts the ones before any position."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        part = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """Wavelet matrix over small whole numbers: ``rank`` of a number, and ``step`` by position."""

    def __init__(self, numbers: np.ndarray, size: int) -> None:
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        numbers = numbers.astype(np.int32)
        for shift in range(self.depth - 1, -1, -1):
            bits = (numbers >> shift & 1).astype(bool)
            self.levels.append(Bits(bits))
            self.zeros.append(len(bits) - int(np.count_nonzero(bits)))
            numbers = np.concatenate([numbers[~bits], numbers[bits]])
        starts, every = np.zeros(1 << self.depth, np.int64), np.arange(1 << self.depth)
        self.starts = self._down(every, starts)

    def _down(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (number >> (self.depth - 1 - i) & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``number`` stands before position ``at``."""
        return self._down(number, at) - self.starts[number]

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at each position, and how often it stands before."""
        number = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(at), bits.rank(at)
            number = number << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return number, at - self.starts[number]


def suffix_order(numbers: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; the last number must be the only smallest one."""
    n, bits = len(numbers), max(1, int(numbers.max()).bit_length())
    reach = max(1, 62 // bits)  # words that one 64-bit key holds
    key = numbers.astype(np.int64)
    for i in range(1, min(reach, n)):
        key = (key << bits) | np.append(numbers[i:], np.zeros(i, np.int64))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.empty(n, np.int64)
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = heads  # a tied group has the place of its first member
    width = reach
    while True:
        single = new & np.append(new[1:], True)
        open_places = np.flatnonzero(~single)
        if not len(open_places):
            return order
        at = order[open_places]
        follow = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        group = rank[at]
        inner = np.lexsort([follow, group])  # groups keep their places
        at, group, follow = at[inner], group[inner], follow[inner]
        order[open_places] = at
        fresh = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        new[open_places] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, open_places, 0))
        width *= 2


class FmIndex:
    """Occurrences of many phrases of numbers in one sequence of numbers below ``size``.

    Number 0 is a barrier: it may stand anywhere in the sequence but in no phrase.
    """

    def __init__(self, sequence: np.ndarray, size: int) -> None:
        closed = np.append(sequence.astype(np.int64) + 1, 0)  # the end sorts before all
        order = suffix_order(closed)
        transformed = closed[order - 1]
        self.wavelet = Wavelet(transformed, size + 1)
        self.smaller = np.cumsum(np.append(0, np.bincount(closed, minlength=size + 1)))
        sampled = order % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), order[sampled].astype(np.int32)
        self.n = len(closed)

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(phrase, low, high)`` of the phrases found; row ``i`` holds ``lengths[i]`` numbers, right-aligned."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for back in range(width):
            more = np.flatnonzero(lengths[which] > back)
            number = phrases[which[more], width - 1 - back] + 1
            both = self.wavelet.rank(
                np.concatenate([number, number]), np.concatenate([low[more], high[more]])
            )
            start = self.smaller[number]
            low[more], high[more] = start + both[: len(more)], start + both[len(more) :]
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order."""
        out, todo, rows = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(todo):
            here = self.sampled.get(rows)
            out[todo[here]] = self.positions[self.sampled.rank(rows[here])] + steps
            todo, rows = todo[~here], rows[~here]
            if len(todo):
                number, before = self.wavelet.step(rows)
                rows = self.smaller[number] + before
                steps += 1
        return out

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(phrase, position)`` of every occurrence, a bounded number at a time."""
        which, low, high = self.ranges(phrases, lengths)
        counts = high - low
        ends = np.cumsum(counts)
        at, total = 0, int(ends[-1]) if len(ends) else 0
        while at < total:
            some = np.arange(at, min(at + (1 << 20), total))
            phrase = np.searchsorted(ends, some, side="right")
            yield which[phrase], self.locate(low[phrase] + some - (ends[phrase] - counts[phrase]))
            at += len(some)


class Block:
    """Some items' windows as numbers of the block's words."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WIDTH) -> None:
        self.width, self.number, self.names = width, {}, []
        seen: dict[tuple[int, ...], int] = {}
        owners: list[tuple[int, int]] = []
        known: dict[str, int] = {}
        for name, text in items:
            listed = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            item = known.setdefault(name, len(known))
            for at in range(max(1, len(listed) - width + 1) if listed else 0):
                window = tuple(listed[at : at + width])
                owners.append((seen.setdefault(window, len(seen)), item))
        self.names = list(known)
        self.lengths = np.array([len(w) for w in seen], np.int64)
        self.phrases = np.zeros((len(seen), width), np.int64)
        for row, window in enumerate(seen):
            self.phrases[row, width - len(window) :] = window
        pairs = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
        self.items = pairs[:, 1]
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(seen) + 1))

    def owners(self, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, item)``: the items of the phrase at each place of ``phrase``."""
        first, n = self.first[phrase], self.first[phrase + 1] - self.first[phrase]
        place = np.repeat(np.arange(len(phrase)), n)
        return place, self.items[first[place] + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]


class _Shelf:
    """Texts laid end to end, and what was found in them."""

    def __init__(self, block: Block, shard_words: int) -> None:
        self.block, self.shard_words = block, max(shard_words, 2 * block.width)
        self.numbers: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.n = 0

    def add(self, text: bytes) -> None:
        listed = words(text)
        numbers = np.fromiter(map(self.block.number.get, listed, repeat(_BARRIER)), np.int32, len(listed))
        self.numbers += [numbers, np.zeros(1, np.int32)]
        self.sizes.append(len(listed))
        self.n += len(listed) + 1

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """``(text, start, end)`` of merged spans, and the items found per text."""
        block, sizes = self.block, np.array(self.sizes, np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        line = np.concatenate(self.numbers) if self.numbers else np.zeros(0, np.int32)
        edge = np.zeros(len(line) + 1, np.int32)
        pairs: list[np.ndarray] = []
        # one barrier says as much as several in a row
        kept = np.flatnonzero((line != _BARRIER) | (np.append(1, line[:-1]) != _BARRIER))
        step = self.shard_words - block.width + 1
        for at in range(0, len(kept) if len(block.lengths) else 0, step):
            index = FmIndex(line[kept[at : at + self.shard_words]], len(block.number) + 1)
            for phrase, position in index.occurrences(block.phrases, block.lengths):
                position = kept[position + at]
                np.add.at(edge, position, 1)
                np.add.at(edge, position + block.lengths[phrase], -1)
                place, item = block.owners(phrase)
                text = np.searchsorted(starts, position[place], side="right") - 1
                pairs.append(np.unique(text * len(block.names) + item))
            if at + self.shard_words >= len(kept):
                break
        hit = np.append(np.cumsum(edge[:-1]) > 0, False)
        change = np.flatnonzero(np.diff(hit, prepend=False))
        begin, end = change[::2], change[1::2]
        text = np.searchsorted(starts, begin, side="right") - 1
        items: list[list[str]] = [[] for _ in self.sizes]
        for pair in np.unique(np.concatenate(pairs)) if pairs else ():
            items[pair // len(block.names)].append(block.names[pair % len(block.names)])
        return text, begin - starts[text], end - starts[text], items


def _searched(block, shard_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their number of words, merged spans and items found; ``block`` is a broadcast."""
    shelf, held = _Shelf(block.value, shard_words), []
    for batch in sliced(batches, 128):
        for text in batch["text"]:
            shelf.add(text.as_buffer().to_pybytes() if text.is_valid else b"")
        held.append(batch.select([0]))
        if shelf.n >= shard_words:
            yield _row_batch(shelf, held)
            shelf, held = _Shelf(block.value, shard_words), []
    if held:
        yield _row_batch(shelf, held)


def _row_batch(shelf: _Shelf, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    text, begin, end, items = shelf.spans()
    bounds = np.searchsorted(text, np.arange(len(shelf.sizes) + 1)).astype(np.int32)
    span = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["start", "end"])
    ids = pa.concat_batches(held).column(0)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.array(shelf.sizes, np.int64)),
         pa.ListArray.from_arrays(pa.array(bounds), span), pa.array(items, pa.list_(pa.string()))],
        ["id", "n_words", "spans", "items"],
    )


def _items(benchmark: DataFrame, item: str, body: str, most: int) -> tuple[DataFrame, int]:
    """``(item, text)``, and the number of blocks that hold about ``most`` words each."""
    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(body).cast("string"), F.lit("")).alias("text"),
    )
    # a word takes two bytes with the blank behind it
    return rows, max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // (2 * most)))


_SPANS = "n_words BIGINT, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, items ARRAY<STRING>"


def _merged_spans(lists) -> F.Column:
    """Spans of several lists, overlapping and adjoining ones made one."""
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def step(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(
            (F.size(done) > 0) & (last["end"] >= span["start"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(F.flatten(lists)), empty, step)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", body: str = "text",
    item: str = "item_id", item_body: str = "text", width: int = WIDTH,
    shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(key, n_words, spans, items)``: one row per row of ``docs``.

    ``spans`` are the passages to remove, as ``[start, end)`` in words; ``items`` the ids, as text,
    of the items with a window in the text, in order.
    """
    spark = docs.sparkSession
    kind = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("text"))
    items, blocks = _items(benchmark, item, item_body, block_words)
    ordered = lambda c: F.array_sort(F.array_distinct(c))

    def scanned(source: DataFrame, number: int, schema: str) -> DataFrame:
        own = F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == number
        listed = [(r["item"], r["text"].encode()) for r in items.filter(own).collect()]
        block = spark.sparkContext.broadcast(Block(listed, width))
        return source.mapInArrow(partial(_searched, block, shard_words), f"{schema}, {_SPANS}")

    if blocks == 1:
        return scanned(rows, 0, f"id {kind}").select(
            F.col("id").alias(key), "n_words", "spans", ordered("items").alias("items")
        )
    # a number of its own tells equal rows apart while their blocks' results are joined
    rows = cut(rows.select(
        F.struct("id", F.monotonically_increasing_id().alias("row")).alias("id"), "text"
    ))
    kind = rows.schema["id"].dataType.simpleString()
    parts = [cut(scanned(rows, number, f"id {kind}")) for number in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("id").agg(
        F.max("n_words").alias("n_words"), _merged_spans(F.collect_list("spans")).alias("spans"),
        ordered(F.flatten(F.collect_list("items"))).alias("items"),
    ).select(F.col("id.id").alias(key), "n_words", "spans", "items")


def n_hit(spans) -> F.Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
