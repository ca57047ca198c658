from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from corpusward.llm import pieces, tokens
from corpusward.session import scratch_path
from tests.llm.helpers import docs

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "aeinrst \n\t  ▁.,'s'll A0123é中𝄞　\x00\x1c\x85 \r!?-_²Ⅷ"
LONG = "Ein langer Text, mit Wörtern. " * 20_000
ROWS = [
    (5, "the quick brown fox"), (3, None), (4, ""), (9, " \n lead and  double  blanks \t\n"), (1, LONG),
    (7, "<|endoftext|> inside <|endoftext|>"), (8, "same"), (8, "same"), (None, "no id"), (2, "日本語 ünï"),
]


def random_texts(n=3000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 24))) for _ in range(n)]


@pytest.mark.parametrize("remembered", [7, 100_000])
def test_byte_ids_equal_the_library(spark, remembered):
    own = tokens.Encoder(open(BYTES, encoding="utf-8").read(), remembered)
    library = Tokenizer.from_file(BYTES)
    texts = random_texts() + [t for _, t in ROWS if t]
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts += [r.text for r in table.collect()]
    for text in texts:
        got = np.frombuffer(own.encode(text), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text[:80]


@pytest.mark.parametrize("remembered", [17, 100_000])
def test_piece_ids_equal_the_library(spark, remembered):
    own = pieces.Encoder(open(PIECES, "rb").read(), remembered)
    names = [p.replace(pieces.MARK, " ") for p in own.pieces]
    rng = random.Random(2)
    texts = random_texts(seed=3) + ["".join(rng.choice(names) for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert own.encode(text) == own.library.encode(text), text[:80]


def test_files_and_places(spark):
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(docs(spark, ROWS, extra=True).repartition(3), path, BYTES, end_id=2)
    rows = tokens.with_start(tokens.checksums(tokens.read_tokens(spark, path)), tokens.shard_starts(spark, path))
    got = sorted((r.start, r.n_tokens, r.ids_crc32, str(r.id)) for r in rows.collect())
    library, start, want = Tokenizer.from_file(BYTES), 0, []
    for key, text in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), str(key)))
        start += len(ids)
    assert got == want
    # files ascend, and so do the rows inside
    names = sorted(p for p in spark.read.parquet(path).inputFiles())
    ids = [i for n in names for i in pq.read_table(n.removeprefix("file:"), columns=["id"])["id"].to_pylist()]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    picked = tokens.read_tokens(spark, path, 3, 5)
    assert sorted(r.id for r in picked.collect()) == [3, 4, 5]
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,3)" in picked._jdf.queryExecution().toString()
    scan = tokens.shard_starts(spark, path)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<shard:bigint,offset:bigint,n_tokens:bigint>" in scan


def test_file_layout(spark):
    path = scratch_path(spark, "tokens")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens.write_tokens(table, path, BYTES, end_id=2, writer={**tokens.WRITER, "parquet.block.size": "100000"})
    file = pq.ParquetFile(next(iter(spark.read.parquet(path).inputFiles())).removeprefix("file:"))
    assert file.metadata.num_row_groups > 1
    group = file.metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["offset"].encodings
    assert columns["id"].has_column_index and columns["id"].has_offset_index


def test_empty(spark):
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(docs(spark, ROWS).limit(0), path, BYTES, end_id=2)
    assert tokens.read_tokens(spark, path).count() == 0
    assert pieces.round_trip(docs(spark, ROWS).limit(0), PIECES).count() == 0


def test_piece_round_trip(spark):
    import hashlib

    own = pieces.Encoder(open(PIECES, "rb").read()).library
    df = docs(spark, ROWS, extra=True)
    got = pieces.round_trip(df, PIECES, with_ids=True).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = r.ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()
    by_id = {r.doc_id: r.ids for r in got}
    assert all(by_id[key] == own.encode(text or "") for key, text in ROWS)
    decoded = pieces.decode(pieces.encode(df, PIECES), PIECES).collect()
    assert {r.doc_id: r.text for r in decoded} == {key: text or "" for key, text in ROWS}


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("remembered", [7, 100_000])
def test_texts_cut_together_equal_the_library(remembered, kind):
    own = tokens.Encoder(open(BYTES, encoding="utf-8").read(), remembered)
    library = Tokenizer.from_file(BYTES)
    texts = [None, "", " ", "\n", "a ", "a\n", " a", "\na", "a\n\nb", "a \nb", "a\n b", "a  b", "a\t b", "a\n\tb", "a\xa0b", "a,.\nb!"]
    texts += random_texts() + [t for _, t in ROWS]
    end = np.array([2], "<u4").tobytes()
    for some in (texts, texts[:1], [], texts[5:9]):
        counts, ids = own.encode_all(pa.array(some, kind), end)
        want = [(library.encode(t, add_special_tokens=False).ids if t else []) + [2] for t in some]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    sliced = own.encode_all(pa.array(["x", "a b", "c"], kind).slice(1))
    assert sliced[1].tolist() == library.encode("a b").ids + library.encode("c").ids
    other = tokens.Encoder(Tokenizer.from_file(BYTES).to_str().replace('"use_regex":true', '"use_regex":false'))
    assert not other.by_unit and other.encode_all(pa.array(["a b", None], kind))[0].tolist()[1] == 0


def test_a_word_is_looked_up_once_for_texts_cut_together():
    # hardly anything is remembered from one cut to the next
    own, asked = tokens.Encoder(open(BYTES, encoding="utf-8").read(), 2), []
    own.tokenize = lambda text, tokenize=own.tokenize: asked.append(text) or tokenize(text)
    counts, _ = own.encode_all(pa.array(["start " + "zyxwv, qponm " * 500, "start zyxwv"] * 3))
    assert len(counts) == 6 and len(asked) <= 10


def test_slices_hold_a_bounded_number_of_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 10)
    texts = ["aaaa", "bbbb", None, "éé", "c" * 30, "d", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    got = [part.column(1).to_pylist() for part in tokens._together([batch, batch.slice(0, 0)])]
    assert got == [["aaaa", "bbbb", None], ["éé"], ["c" * 30], ["d", ""]]
