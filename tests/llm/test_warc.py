from __future__ import annotations

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from corpusward.llm import warc
from corpusward.session import scratch_path

LONG = "<p>lang</p>" * 30_000
BIG = "x" * 1000
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3\r\nX: y", BIG + "y"), (4, None, None),
    (5, "http://a/5", ""), (6, "http://a/6", "short"), (7, "http://a/7", "short"), (8, "u", LONG), (9, "u", LONG),
    (None, "u", LONG), (10, "u", "é" * 500), (11, "u", "é" * 500), (12, "u", "same id" * 200),
    (12, "u", "same id" * 200), (13, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
]


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    return df.withColumn("digest", F.lit("clash")).withColumn("keeper", F.lit("clash")).withColumn("offset", F.lit(1))


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        keep = max(same) if len(data) >= 1000 else page
        out.append((str(page), len(data), hashlib.sha1(data).hexdigest(),
                    "response" if page == keep else "revisit", None if page == keep else keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1, 1 << 24])
def test_round_trip(spark, most):
    root = scratch_path(spark, "warc")
    index = warc.write_archives(pages(spark, ROWS).repartition(3), root, roll_bytes=2000)
    got = warc.read_records(index, root, most=most).collect()
    assert sorted(
        ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str
    ) == expected(ROWS)
    texts = {p: (h or "").encode() for p, _, h in ROWS}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    some = warc.read_records(index.filter("page_id IN (3, 13)"), root).collect()
    assert sorted(r.page_id for r in some) == [3, 13]
    # archives are plain gzip members, one record each
    places = index.filter("page_id = 3").first()
    with open(f"{root.removeprefix('file:')}/archives/{places.file}", "rb") as file:
        file.seek(places.offset)
        data = gzip.decompress(file.read(places.length))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"http://a/3%0D%0AX:%20y\r\n" in data


def test_empty(spark):
    root = scratch_path(spark, "warc")
    index = warc.write_archives(pages(spark, ROWS).limit(0), root)
    assert warc.read_records(index, root).count() == 0


def test_damage_is_noticed():
    data = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    assert warc.parsed(data)[4:6] == (7, hashlib.sha1(b"payload").hexdigest())
    with pytest.raises(ValueError):
        warc.parsed(data.replace(b"payload", b"paXload"))


def test_spans():
    places = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 5), ("b", 105, 5)]
    assert list(warc.spans(places, 1000, 5)) == [("a", 0, 30, 0, 3), ("a", 100, 5, 3, 4), ("b", 105, 5, 4, 5)]
    assert list(warc.spans(places[:3], 20, 5)) == [("a", 0, 20, 0, 2), ("a", 25, 5, 2, 3)]
    assert list(warc.spans([], 20)) == []
