"""SentencePiece (BPE) encoding by a table of last tokens.

Every prefix of a text has one BPE encoding, hence one last token. The table is filled from left to
right: an automaton lists the pieces ending at each character, longest first, and a piece is the
last token there iff it is compatible with the last token of the prefix before it, i.e. the two
alone are encoded as these two. Ids are then read off backwards. Time is linear in the text; pair
tests are remembered. Characters without a piece are barriers and become their UTF-8 bytes.

No piece goes on behind a blank mark that follows another character, so a text falls into words at
these places; each worker remembers words it has encoded, within a bound. Encoding is row by row in
place: no shuffle, nothing kept between tasks but these bounded memories, so a lost executor costs
only its tasks. The library gives the pieces, the normalised text and the decoding.

Defined results: a null or empty text has no tokens and decodes to the empty text; rows with a null
or repeated id are encoded like any other; an empty table gives an empty result; columns other than
id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import AbstractContextManager
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.memory import Kept, Memory, sliced

MARK = "▁"
# Words, and pairs of pieces, that a generation of a worker's memory holds.
REMEMBERED = 100_000
_PAIR = 1 << 24
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Encoder:
    """Encodes and decodes with one model; holds bounded memories of words and pairs."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        library, size = self.library, self.library.get_piece_size()
        kinds = {
            i: library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)
            for i in range(size)
        }
        self.pieces = {library.id_to_piece(i): i for i in range(size) if not kinds[i]}
        self.names = [library.id_to_piece(i) for i in range(size)]
        self.scores = {piece: library.get_score(i) for piece, i in self.pieces.items()}
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.known = {piece for piece in self.pieces if len(piece) == 1}
        if not all(library.is_byte(i) for i in self.bytes):
            raise ValueError("the model must fall back to bytes")
        for piece in self.pieces:
            if MARK in piece.lstrip(MARK) or not self.known.issuperset(piece):
                raise ValueError(f"piece {piece!r} breaks the word cut")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.pieces.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs = Memory(self._compatible, remembered)
        # Words after a blank mark are remembered without it; a line start stands for itself.
        self.words = Memory(lambda w: self.word(w if w.startswith("\n") else MARK + w), remembered)
        self.others = Memory(self.word, remembered // 10)

    def merged(self, text: str) -> list[str]:
        """Plain BPE: again and again the best-scored adjacent pair, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        """Whether two pieces in a row are encoded as themselves; number 0 is the text's start.

        ``pair`` holds the left piece's id plus one in its upper bits, the right one's id below.
        """
        left, right = divmod(pair, _PAIR)
        wanted = [*([self.names[left - 1]] if left else []), self.names[right]]
        return self.merged("".join(wanted)) == wanted

    def run(self, text: str) -> list[int]:
        """Ids of a text of known characters only."""
        last = [-1] * (len(text) + 1)
        begin = [0] * (len(text) + 1)
        pairs = self.pairs
        for end, (piece, width) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - width
            if pairs[(last[start] + 1) * _PAIR + piece]:
                last[end], begin[end] = piece, start
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at = begin[at]
        return ids[::-1]

    def word(self, text: str) -> tuple[tuple[int, ...], str]:
        """Ids of a word, and the same as decimal text."""
        if self.known.issuperset(text):
            ids = self.run(text)
        else:
            ids, at = [], 0
            for i, char in enumerate(text):
                if char not in self.known:
                    ids += self.run(text[at:i])
                    ids += [self.bytes[b] for b in char.encode()]
                    at = i + 1
            ids += self.run(text[at:])
        return tuple(ids), ",".join(map(str, ids))

    def entries(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """One entry per word of the text."""
        if not text:
            return []
        text = self.library.normalize(text)
        if text.startswith(MARK) and MARK * 2 not in text and f"{MARK}\n" not in text:
            known = self.words
            return [known[w] for w in text.replace("\n", f"{MARK}\n").split(MARK)[1:]]
        return [self.others[w] for w in _WORD.findall(text)]

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(e[0] for e in self.entries(text or "")))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_KEPT = Kept(Encoder)


def encoder(model: bytes, remembered: int = REMEMBERED) -> AbstractContextManager[Encoder]:
    """The worker process's encoder, for the model and the size of its memory that its task names."""
    return _KEPT.of(model, remembered)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str, key: str = "doc_id", body: str = "text") -> DataFrame:
    """``(key, ids)``; ``path`` names the model file, read by the driver."""
    model = _read(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(model) as own:
            for batch in sliced(batches):
                ids = pa.array([own.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    kind, rows = _keyed(docs, key, body)
    return rows.mapInArrow(run, f"id {kind}, ids ARRAY<INT>").withColumnRenamed("id", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` of ``(key, ids)``; a null list is an empty one."""
    model = _read(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(model) as own:
            for batch in sliced(batches):
                texts = pa.array([own.decode(v.as_py() or []) for v in batch.column(1)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])

    kind = encoded.select(key).schema[0].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text STRING").withColumnRenamed("id", key)


def _keyed(docs: DataFrame, key: str, body: str) -> tuple[str, DataFrame]:
    kind = docs.select(key).schema[0].dataType.simpleString()
    return kind, docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("text"))


def round_trip(
    docs: DataFrame, path: str, key: str = "doc_id", body: str = "text", with_ids: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: encoded, decoded, and both digested.

    Digests are lower-case hex: of the ids in decimal joined by commas, and of the decoded text.
    ``with_ids`` adds the ids themselves. ``remembered`` trades memory for time, never results: a
    job whose workers do nothing else can afford more than the last stage of a long one.
    """
    model = _read(path)
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(model, remembered) as own:
            for batch in sliced(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), *digested(own, batch.column(1))], names)

    def digested(own: Encoder, texts: pa.Array) -> list[pa.Array]:
        counts, of_ids, of_text, kept = [], [], [], []
        for text in texts:
            entries = own.entries(text.as_py() or "")
            ids = list(chain.from_iterable(e[0] for e in entries))
            line = ",".join([e[1] for e in entries if e[1]])
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(line.encode()).hexdigest())
            of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            if with_ids:
                kept.append(pa.array(ids, pa.int32()))
        arrays = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return arrays + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])

    kind, rows = _keyed(docs, key, body)
    schema = f"id {kind}, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"
    schema += ", ids ARRAY<INT>" if with_ids else ""
    return rows.mapInArrow(run, schema).withColumnRenamed("id", key)
