"""Token ids as Parquet list columns, in id order, readable in part.

*Encoding* runs with the tokenizers library. Byte-level BPE never joins a blank to a character before
it, so a text falls into units at these places; each worker remembers the ids of units it has met,
within a bound, and asks the library for the others. Texts whose blanks are lone spaces and line ends
are cut together, a few million characters at a time, and each of their distinct words is looked up
once; the others are cut one by one. Texts that hold a special token, and tokenizers of another make,
go through the library whole.

*Files.* Documents are dealt to shards by id range and sorted, so that files and the rows in them
ascend by id; nulls first, repeated ids in the order of their texts' hashes. A row holds its ids as a list
(dictionary-encoded) next to its place: ``shard``, the ``offset`` inside it and ``n_tokens``, which
are delta-encoded. Row groups and pages are small and carry column indexes, so reading a range of
documents skips the other pages, and reading places touches no token. ``with_start`` turns places
into positions in the whole token stream by adding up one total per shard.

The range boundaries come from a sample of ids that Spark draws; all rows are written. Spark's
writer commits tasks, so lost executors leave no half-written shard.

Defined results: a null or empty text is the end id alone; an empty table gives no rows; columns
other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from contextlib import AbstractContextManager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusward.llm.memory import LONGEST, Kept, Memory, sliced

# Units that a generation of a worker's memory holds.
REMEMBERED = 500_000
# Bytes of the texts that are cut together, if they are more than one.
TOGETHER = 4 << 20
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary#id": "false",
    "parquet.enable.dictionary#shard": "false",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
# A unit starts at a blank that follows another character; \S excludes every kind of blank.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])")
# Marks that never join the word before them, nor split a run of themselves.
_MARKS = ".,;:!?#$%&*|()"
_IRREGULAR = re.compile(r"\s\s|\A\s")


def _plain(text: str) -> bool:
    """Whether all blanks are lone spaces and line ends; False may also mean that it is unclear."""
    return text[0] not in " \n" and text.replace("\n", "").isprintable() and not any(
        pair in text for pair in ("  ", " \n", "\n ", "\n\n")
    )


def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(other)}}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes with one tokenizer file; remembers units within a bound."""

    def __init__(self, spec: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.library = Tokenizer.from_str(spec)
        form = json.loads(spec)
        before, model = form.get("pre_tokenizer") or {}, form["model"]
        self.by_unit = (
            form.get("normalizer") is None and model.get("type", "BPE") == "BPE"
            and not model.get("dropout") and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space") and before.get("use_regex", True)
        )
        self.special = [token["content"] for token in form.get("added_tokens") or []]
        self.names = _byte_names()
        self.tokenize, self.blank = self.library.model.tokenize, self.names[32]
        self.packed = [_packed([i]) for i in range(1 + max(self.library.get_vocab().values()))]
        self.words = Memory(self._word, remembered)  # units without their leading blank
        self.units = Memory(self._unit, remembered // 20)
        self.parts = Memory(self._part, remembered // 20)

    def _part(self, mapped: str) -> bytes:
        """Ids of one pre-token, given in byte characters."""
        packed, tokens = self.packed, self.tokenize(mapped)
        return packed[tokens[0].id] if len(tokens) == 1 else b"".join([packed[t.id] for t in tokens])

    def _mapped(self, part: str) -> bytes:
        if part.isascii():
            return self._part(part.replace(" ", self.blank))
        return self._part(part.encode().decode("latin-1").translate(self.names))

    def _unit(self, text: str) -> bytes:
        """Ids of a unit; the common forms are cut here, others by the library.

        A line end, a word with or without a blank, and marks behind it are a pre-token each.
        """
        word = text.rstrip(_MARKS)
        lead = word[:1] == "\n"
        bare = word[1:] if lead or word[:1] == " " else word
        if bare.isalpha():
            ids = self.parts[self.names[10]] + self._mapped(bare) if lead else self._mapped(word)
            return ids + self.parts[text[len(word) :]] if len(word) < len(text) else ids
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return b"".join([self.parts[mapped] for mapped, _ in pieces])

    def _whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_unit or any(token in text for token in self.special):
            return self._whole(text)
        if not _plain(text) and _IRREGULAR.search(text):
            return b"".join([self.units[unit] for unit in _CUT.split(text)])
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.units[first] + b"".join(map(self.words.__getitem__, rest))

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """``(counts, ids)``: ids of every text and ``end`` after it, all in one row, and how many."""
        signs = ("\n\n", *self.special)
        body = [
            "" if not text or not self.by_unit or any(sign in text for sign in signs) else text
            for text in texts.to_pylist()
        ]
        cut = pc.split_pattern(pc.replace_substring(pa.array(body, pa.large_string()), "\n", " \n"), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        kinds, code = coded.dictionary, coded.indices.to_numpy().copy()
        words = kinds.to_numpy(zero_copy_only=False).tolist()
        del body, cut, coded
        first, last = bounds[:-1], bounds[1:] - 1
        # a piece without a letter stands for blanks in a row, unless the text ends with it
        odd = np.zeros(len(words) + 1, bool)
        if not "".join(words).replace("\n", "").isprintable():
            odd[:-1] = [not word.replace("\n", "").isprintable() for word in words]
        bare = np.zeros(len(words) + 1, bool)
        bare[:-1] = pc.is_in(kinds, pa.array(["", "\n"], kinds.type)).to_numpy(zero_copy_only=False)
        at = odd[code] | bare[code]
        at[last] = odd[code[last]]
        at[first] |= bare[code[first]]
        single = np.unique(np.searchsorted(bounds, np.flatnonzero(at), "right") - 1)
        # every text's first piece and those that go alone get values of their own
        values = self._values(words)
        heads = [self.units[words[c]] if words[c] else b"" for c in code[first].tolist()]
        for row in single.tolist():
            heads[row] = self.encode(texts[row].as_py())
            code[bounds[row] : bounds[row + 1]] = len(words)
        code[first] = np.arange(len(first)) + len(words) + 2
        values += [b"", end, *heads]
        code = np.insert(code, bounds[1:], len(words) + 1)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        n = sizes[code]
        counts = np.add.reduceat(n, first + np.arange(len(first))) if len(first) else n
        shift = (np.cumsum(sizes) - sizes)[code] - (np.cumsum(n) - n)
        total = int(counts.sum())
        kind = np.int32 if total + int(sizes.sum()) < 2**31 else np.int64
        place = np.repeat(shift.astype(kind), n)
        place += np.arange(total, dtype=kind)
        return counts, np.frombuffer(b"".join(values), np.int32)[place]

    def _values(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each behind a blank; the way of most new words is spelled out."""
        known, older = self.words, self.words.old
        values = list(map(known.get, words))
        new, packed, tokenize, blank, names = {}, self.packed, self.tokenize, self.blank, self.names
        for i, value in enumerate(values):
            if value is not None:
                continue
            word = words[i]
            value = older.get(word)
            if value is None:
                bare = word if word.isalpha() else word.rstrip(_MARKS)
                if not bare.isalpha():
                    value = self._word(word)
                else:
                    same = bare is word
                    value = None if same else known.get(bare) or older.get(bare)
                    if value is None:
                        mapped = bare if bare.isascii() else bare.encode().decode("latin-1").translate(names)
                        tokens = tokenize(blank + mapped)
                        value = packed[tokens[0].id] if len(tokens) == 1 else b"".join([packed[t.id] for t in tokens])
                    if not same:
                        value += self.parts[word[len(bare) :]]
            values[i] = value
            if len(word) <= LONGEST:
                new[word] = value
        known.add(new)
        return values

    def _word(self, text: str) -> bytes:
        if text.isalpha():
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.names)
            return self._part(self.blank + text)
        word = text.rstrip(_MARKS)
        if word.isalpha():
            return self._word(word) + self.parts[text[len(word) :]]
        return self._unit(text if text[:1] == "\n" else f" {text}")


_KEPT = Kept(Encoder)


def encoder(spec: str) -> AbstractContextManager[Encoder]:
    """The worker process's encoder, for the tokenizer that its task names."""
    return _KEPT.of(spec)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices whose texts have ``TOGETHER`` bytes at most, or one row."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + TOGETHER, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _encoded(spec: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        with encoder(spec) as own:
            for batch in _together(batches):
                yield batch, *own.encode_all(batch.column(1), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, offset = TaskContext.get().partitionId(), 0
        for batch, counts, flat in encoded(batches):
            ends = np.cumsum(counts)
            bounds = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(counts), shard, np.int64)),
                 pa.array(offset + ends - counts), pa.array(counts),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))],
                ["id", "shard", "offset", "n_tokens", "ids"],
            )
            offset += int(counts.sum())

    return run


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id",
    body: str = "text", writer: dict[str, str] | None = None,
) -> None:
    """Write ``(id, shard, offset, n_tokens, ids)`` below ``path``; ``tokenizer`` names a file."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    order = ["id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(
        _encoded(spec, end_id),
        f"id {kind}, shard BIGINT, offset BIGINT, n_tokens BIGINT, ids ARRAY<INT>",
    ).write.options(**(writer or WRITER)).parquet(path)


def read_tokens(spark: SparkSession, path: str, low=None, high=None) -> DataFrame:
    """Rows with ids from ``low`` to ``high``; the scan skips row groups and pages without any."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.filter(F.col("id") >= low)
    return rows if high is None else rows.filter(F.col("id") <= high)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, base)``: tokens before each shard; reads places only, one row per shard remains."""
    totals = spark.read.parquet(path).groupBy("shard").agg(
        F.max(F.col("offset") + F.col("n_tokens")).alias("total")
    )
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        "shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")
    )


def with_start(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` with ``start``: tokens of all documents before, in the order of the files."""
    return rows.join(starts, "shard").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        ids = batch["ids"]
        bounds = ids.offsets.to_numpy()
        flat = ids.values.to_numpy().astype("<u4")
        sums = [zlib.crc32(flat[a:b].data) for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("id", "shard", "offset", "n_tokens")), pa.array(sums, pa.int64())],
            ["id", "shard", "offset", "n_tokens", "ids_crc32"],
        )


def checksums(rows: DataFrame) -> DataFrame:
    """``(id, shard, offset, n_tokens, ids_crc32)``: CRC-32 of the ids as unsigned 32-bit words."""
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "shard", "offset", "n_tokens", "ids").mapInArrow(
        _checksums, f"id {kind}, shard BIGINT, offset BIGINT, n_tokens BIGINT, ids_crc32 BIGINT"
    )
