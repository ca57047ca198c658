"""WARC archives written and read by their index.

*Writing.* Every task writes one archive at a time under a name of its own, each record a gzip
member, and returns one index row per record: file, offset, length, URL, digest. The index is
written by Spark, which commits each task once; it names only archives of committed tasks, so files
that a lost or repeated attempt left behind are never read. Archives roll over at a size bound.

*Copies.* Payloads of at least ``least_bytes`` with equal digests are stored once: the record with
the largest page id is the response, the others are revisits that point to it. Digests are counted
before the pages are joined to the few that repeat; a digest with a large share of all rows is
broadcast (at most ``1 / HOT_SHARE`` are), the others shuffle.

*Reading.* The selected index rows are dealt by range of (file, offset) and sorted; neighbouring
records are fetched as one byte range, up to a bound, and cut apart in memory.

Archives lie below the shared folder and are opened through ``pyarrow.fs``, by URI.

Defined results: null html is an empty payload; a null page id is smaller than any other; pages that
share the largest id of their payload are all responses; control characters in a URL are
percent-encoded in its header, a null URL is an empty one; an empty table gives an empty index;
columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.words import whole
from corpusward.session import cut

LEAST_BYTES = 1000
ROLL_BYTES = 1 << 30
RANGE_BYTES = 16 << 20
GZIP_LEVEL = 3
HOT_SHARE = 0.001
# Fixed value: the archive format's version line and line end.
VERSION, END = "WARC/1.1", "\r\n"
DATE = "1970-01-01T00:00:00Z"
INDEX = (
    "page_id BIGINT, url STRING, digest STRING, record_type STRING, "
    "file STRING, offset BIGINT, length BIGINT"
)
RECORD = (
    "page_id BIGINT, url STRING, record_type STRING, refers_to BIGINT, payload_bytes BIGINT, "
    "payload_digest STRING, payload BINARY"
)


# --- records -----------------------------------------------------------------------------------

def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _labelled(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _field(text: str | None) -> str:
    """A header value on one line."""
    return "".join(quote(c) if ord(c) < 33 or ord(c) == 127 else c for c in text or "")


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None,
    revisit: bool, date: str = DATE,
) -> bytes:
    """One record, not yet compressed; ``keeper`` is the page a revisit points to."""
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
    block = f"{http}Content-Length: {len(payload)}{END}{END}".encode()
    if not revisit:
        block += payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": _field(url),
        "WARC-Payload-Digest": _labelled(digest),
        "WARC-Block-Digest": _labelled(hashlib.sha1(block).hexdigest()),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        fields["Page-ID"] = str(page_id)
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = record_id(keeper)
        fields["Refers-To-Page-ID"] = str(keeper)
    head = END.join([VERSION, *(f"{name}: {value}" for name, value in fields.items()), "", ""])
    return head.encode() + block + (END * 2).encode()


def parsed(data: bytes) -> tuple:
    """``RECORD`` values of one record; checks lengths and digests."""
    head, _, rest = data.partition((END * 2).encode())
    version, *lines = head.decode().split(END)
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != VERSION or _labelled(hashlib.sha1(block).hexdigest()) != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition((END * 2).encode())
    revisit = fields["WARC-Type"] == "revisit"
    size = int(dict(line.split(": ", 1) for line in http.decode().split(END)[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if not revisit and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    page, keeper = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
    return (
        None if page is None else int(page), fields["WARC-Target-URI"], fields["WARC-Type"],
        None if keeper is None else int(keeper), size, digest, None if revisit else payload,
    )


# --- writing -----------------------------------------------------------------------------------

def _marked(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with digest and, where a payload repeats, the page that holds it."""
    rows = pages.withColumn("digest", F.sha1("html"))
    repeats = cut(
        rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest")
        .agg(F.count("*").alias("__n"), F.max("page_id").alias("keeper")).filter("__n > 1")
    )
    total = pages.select(F.count("*")).scalar()
    hot = F.col("__n") >= F.greatest(total * HOT_SHARE, F.lit(1000))
    fast = repeats.filter(hot).select("digest", F.struct("keeper").alias("__fast"))
    slow = repeats.filter(~hot).select(F.col("digest").alias("__key"), F.struct("keeper").alias("__slow"))
    probed = rows.join(F.broadcast(fast), "digest", "left").withColumn(
        "__key",
        F.when(F.col("__fast").isNull(), F.col("digest"))
        .otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url")))),
    )
    held = F.coalesce("__fast", "__slow")
    return probed.join(slow, "__key", "left").select(
        "page_id", "url", "html", "digest", held["keeper"].alias("keeper"),
        F.coalesce(held.isNotNull() & ~F.col("page_id").eqNullSafe(held["keeper"]), F.lit(False))
        .alias("revisit"),
    )


class _Archive:
    """The file a task writes at the moment."""

    def __init__(self, root: str, level: int) -> None:
        self.system, place = fs.FileSystem.from_uri(root)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.stream = self.system.open_output_stream(f"{place}/{self.name}", compression=None)
        self.level, self.size = level, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.stream.write(member)
        at, self.size = self.size, self.size + len(member)
        return self.name, at, len(member)


def _writer(root: str, level: int, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            places = []
            for page, url, html, digest, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None or archive.size >= roll_bytes:
                    if archive:
                        archive.stream.close()
                    archive = _Archive(root, level)
                places.append(archive.add(
                    record(page, url, html.encode(), digest, keeper, revisit, date)
                ))
            kind = pa.array(["revisit" if r else "response" for r in batch["revisit"].to_pylist()], pa.string())
            files, offsets, lengths = zip(*places, strict=True) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], batch["digest"], kind, pa.array(files, pa.string()),
                 pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["page_id", "url", "digest", "record_type", "file", "offset", "length"],
            )
        if archive:
            archive.stream.close()

    return run


def as_uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def write_archives(
    pages: DataFrame, root: str, key: str = "page_id", url: str = "url", body: str = "html",
    least_bytes: int = LEAST_BYTES, level: int = GZIP_LEVEL, roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write archives to ``<root>/archives`` and the index to ``<root>/index``; returns the index."""
    home = f"{as_uri(root)}/archives"
    system, place = fs.FileSystem.from_uri(home)
    system.create_dir(place, recursive=True)
    rows = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        whole(F.col(body).cast("string")).alias("html"),
    )
    marked = _marked(rows, least_bytes)
    marked.mapInArrow(_writer(home, level, roll_bytes, date), INDEX).write.parquet(f"{root}/index")
    return pages.sparkSession.read.parquet(f"{root}/index")


# --- reading -----------------------------------------------------------------------------------

def spans(places: list[tuple[str, int, int]], most: int, gap: int = 0) -> Iterator[tuple[str, int, int, int, int]]:
    """``(file, offset, length, first, last)``: runs of sorted places to be read at once.

    Records join a run while they follow within ``gap`` bytes and the run stays below ``most``.
    """
    first = 0
    for i in range(1, len(places) + 1):
        file, start, _ = places[first]
        _, offset, length = places[i - 1]
        end = offset + length
        if i == len(places) or places[i][0] != file or places[i][1] > end + gap or (
            places[i][1] + places[i][2] - start > most
        ):
            yield file, start, end - start, first, i
            first = i


def _reader(root: str, most: int, gap: int, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, home = fs.FileSystem.from_uri(root)
        opened = stream = None
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            *([("payload", pa.binary())] if payloads else []),
        ])
        for batch in batches:
            places = list(zip(*(batch[c].to_pylist() for c in ("file", "offset", "length")), strict=True))
            for file, start, size, first, last in spans(places, most, gap):
                if file != opened:
                    stream, opened = system.open_input_file(f"{home}/{file}"), file
                data = memoryview(stream.read_at(size, start))
                rows = []
                for _, offset, length in places[first:last]:
                    member = data[offset - start : offset - start + length]
                    rows.append(parsed(zlib.decompress(member, 31))[: len(schema)])
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

    return run


def read_records(
    index: DataFrame, root: str, most: int = RANGE_BYTES, gap: int = 4096, payloads: bool = True
) -> DataFrame:
    """The records of the selected ``index`` rows, read from the archives below ``root``.

    Without ``payloads`` they are read and checked, but not returned.
    """
    places = index.select("file", "offset", "length")
    ordered = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = RECORD if payloads else RECORD.removesuffix(", payload BINARY")
    return ordered.mapInArrow(_reader(f"{as_uri(root)}/archives", most, gap, payloads), schema)
