"""One job from files to a searchable corpus, by batches that count as a whole or not at all.

A batch parses its files, redacts, numbers versions, drops duplicates and writes its tables and the
fingerprints, each below its ``batch_id``. Its commit marker comes last. Readers see committed
batches only, and so does every later batch; a batch that dies is repeated under the same id and
overwrites what it left, and one that has its marker is not done again. So a replay neither doubles
nor loses anything. Nothing stored is ever rewritten: which version is current follows from the
documents table.

=========  ======================================================================================
documents  ``source_type, filename, filepath, version, n_chunks, created_at``: files with chunks
chunks     ``chunk_key, source_type, filename, version, chunk_index, text, allowed_groups``
index      ``chunk_key, source_type, allowed_groups, tokens``: ids of a chunk's words
rejects    ``filepath, source_type, error_message, attempt, ts``: what could not be read
dead       rejects whose retries are used up, see ``streaming/retries.py``
=========  ======================================================================================

A chunk is a duplicate of a chunk before it in the batch, or of a stored one of *another* current
document; text that a new version repeats from its own old one stays. Of several versions in one
batch only the newest takes part; the others are stored as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusward.functions import access, text
from corpusward.operators import dedup, fingerprints
from corpusward.operators.running import time_bucket, with_running
from corpusward.plans import ingest
from corpusward.session import cut, release, remove
from corpusward.sources import readers

KEY = ["source_type", "filename"]
TABLES = {
    "documents": "source_type STRING, filename STRING, filepath STRING, version BIGINT, n_chunks BIGINT, created_at TIMESTAMP",
    "chunks": "chunk_key BIGINT, source_type STRING, filename STRING, version BIGINT, chunk_index BIGINT, text STRING, allowed_groups ARRAY<STRING>",
    "index": "chunk_key BIGINT, source_type STRING, allowed_groups ARRAY<STRING>, tokens ARRAY<INT>",
    "rejects": "filepath STRING, source_type STRING, error_message STRING, attempt INT, ts TIMESTAMP",
    "dead": "filepath STRING, source_type STRING, error_message STRING, retry_count INT, created_at TIMESTAMP",
    "commits": "source_type STRING, files BIGINT, extracted BIGINT, stored BIGINT, duplicates BIGINT",
}
UNREADABLE = (".xlsx",)
PARTIAL = "message without a time"  # rejects of files that were read all the same


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(chunks, rejects)`` of landed files; a chunk's ``filename`` is the file's whole path.

    Pages of page-like documents are separated by form feeds, as text extractors write them. A null
    ``value`` is a file that could not be read. ``attempt`` is 0 where ``files`` has no such column.
    """
    found, broken = _extracted(files, list(access.FOLDER_SOURCES.values()))
    return found.filter(F.col("text").isNotNull()), _rejects(files, found, broken)


def _extracted(files: DataFrame, kinds: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Chunks of the files of ``kinds``, those that could not be redacted with a null text, and messages
    and files that are not what they should be; None where no kind can have any."""
    rows = files.select("source_type", F.col("path").alias("filename"), "path", "value", "modified")
    of = lambda kind: rows.filter((F.col("source_type") == kind) & ~_closed())
    parts, bad = [], None
    if "confluence" in kinds:
        parts.append(ingest.from_markdown(of("confluence").select("filename", F.col("value").alias("text"))))
    if "slack" in kinds:
        messages, bad = readers.messages_in(of("slack"))
        parts.append(ingest.from_messages(messages.select("filename", "user", "text", "ts", "pos")))
    if "excel" in kinds:
        parts.append(ingest.from_tables(readers.table_rows_in(of("excel")), F.shiftright("row_no", 12)))
    if "pdf" in kinds:
        pages = of("pdf").select("filename", F.posexplode(F.split("value", "\f")).alias("chunk_index", "text"))
        parts.append(ingest.from_pages(pages))
    return (ingest.union_sources(*parts) if parts else None), bad


def _closed() -> Column:
    return F.lower(F.substring_index("path", ".", -1)).isin([e[1:] for e in UNREADABLE])


def _rejects(files: DataFrame, found: DataFrame | None, bad: DataFrame | None) -> DataFrame:
    """What of ``files`` is not stored, and why; the other two as ``_extracted`` gives them."""
    told = lambda df, why: df.select(
        F.col("path").alias("filepath"), "source_type", why.alias("error_message"), F.current_timestamp().alias("ts"))
    rejects = told(files.filter(_closed()), F.lit("must be converted to text first")).unionByName(
        told(files.filter(~_closed() & F.col("value").isNull()), F.lit("cannot be read")))
    if bad is not None:
        rejects = rejects.unionByName(told(bad.withColumn("source_type", F.lit("slack")), F.when(
            F.col("pos").isNull(), F.lit("not a JSON file")
        ).otherwise(F.concat(F.lit(f"{PARTIAL}: "), F.col("pos").cast("string")))))
    if found is not None:  # what could not be redacted is not stored: closed, not open
        bare = found.filter(F.col("text").isNull()).withColumn("path", F.col("filename"))
        rejects = rejects.unionByName(told(bare, F.lit("redaction failed")))
    if "attempt" in files.columns:
        tries = files.select(F.col("path").alias("filepath"), "attempt")
        rejects = rejects.join(tries, "filepath")
    else:
        rejects = rejects.withColumn("attempt", F.lit(0))
    return rejects


class Store:
    """The tables below one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def committed(self) -> list[int]:
        """Ids of whole batches: one number a batch, from the names of the markers' folders."""
        markers = self._read("commits").inputFiles()
        return sorted({int(path.rsplit("/", 2)[1].removeprefix("batch_id=")) for path in markers} - {-1})

    def _read(self, name: str) -> DataFrame:
        # the folder must be there before the first batch
        nothing = self.spark.createDataFrame([], TABLES[name])
        nothing.write.mode("ignore").parquet(f"{self._path(name)}/batch_id=-1")
        return self.spark.read.schema(f"{TABLES[name]}, batch_id BIGINT").parquet(self._path(name))

    def table(self, name: str, before: int | None = None, ids: bool = False) -> DataFrame:
        """Rows of committed batches, or of those before a batch; ``ids`` adds their ``batch_id``."""
        done = [i for i in self.committed() if before is None or i < before]
        rows = self._read(name).filter(F.col("batch_id").isin(done))
        return rows if ids else rows.drop("batch_id")

    def write(self, name: str, batch_id: int, rows: DataFrame) -> DataFrame:
        path = f"{self._path(name)}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self, batch_id: int, *names: str) -> None:
        """The batch has no rows in the tables: what it left when it ran before goes."""
        for name in names:
            remove(self.spark, f"{self._path(name)}/batch_id={batch_id}")

    def current(self, before: int | None = None) -> DataFrame:
        """``(source_type, filename, version)`` of every document's newest version."""
        return self.table("documents", before).groupBy(*KEY).agg(F.max("version").alias("version"))

    def active(self, name: str = "chunks") -> DataFrame:
        """``chunks`` or ``index`` of current versions."""
        chunks = self.table("chunks")
        if name == "chunks":
            return chunks.join(self.current(), [*KEY, "version"], "left_semi")
        keys = chunks.join(self.current(), [*KEY, "version"], "left_semi").select("chunk_key")
        return self.table(name).join(keys, "chunk_key", "left_semi")


def _numbered(files: DataFrame, chunks: DataFrame, store: Store, batch_id: int) -> DataFrame:
    """Documents of the batch with their versions, after those already stored."""
    counted = chunks.groupBy(F.col("filename").alias("path")).agg(F.count("*").alias("n_chunks"))
    arrived = files.select("path", *KEY, "modified").join(counted, "path")
    numbered = with_running(
        arrived, KEY, ["modified", "path"], time_bucket(F.col("modified")),
        inclusive={"__nth": ("sum", F.lit(1))}, overall={"__of": ("sum", F.lit(1))},
    )
    known = store.current(batch_id).withColumnRenamed("version", "__known")
    return numbered.join(known, KEY, "left").select(
        *KEY, F.col("path").alias("filepath"),
        (F.coalesce("__known", F.lit(0)) + F.col("__nth")).alias("version"), "n_chunks",
        F.col("modified").alias("created_at"), (F.col("__nth") == F.col("__of")).alias("newest"),
    )


def _owner() -> F.Column:
    return F.xxhash64(*KEY)


def _token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's words as sorted distinct token ids (see ``text.token_id``); a batch's distinct words
    are hashed once."""
    for batch in batches:
        words = batch["words_here"]
        coded = words.flatten().dictionary_encode()
        ids = np.array(
            [int.from_bytes(sha256(w).digest()) % text.TOKEN_SPACE for w in coded.dictionary.cast(pa.binary()).to_pylist()],
            np.int64)
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
        pair = np.unique(row << 31 | ids[coded.indices.to_numpy()])
        ends = np.cumsum(np.bincount(pair >> 31, minlength=len(words)))
        tokens = pa.ListArray.from_arrays(
            pa.array(np.r_[0, ends].astype(np.int32)), pa.array((pair & (1 << 31) - 1).astype(np.int32)))
        at = batch.schema.get_field_index("words_here")
        yield batch.set_column(at, pa.field("tokens", tokens.type), tokens)


def _sets(chunks: DataFrame) -> DataFrame:
    """Word sets of the chunks and all that is stored of their words, from one pass over the texts."""
    listed = chunks.withColumn("owner", _owner()).withColumn("words_here", text.word_set(F.col("text")))
    kept = ("owner", "version", "source_type", "allowed_groups")
    sets = dedup.word_sets(listed, keep=(*kept, "words_here"), distinct="words_here")
    schema = ", ".join(
        "tokens ARRAY<INT>" if f.name == "words_here" else f"{f.name} {f.dataType.simpleString()}" for f in sets.schema)
    return sets.mapInArrow(_token_lists, schema)


def _kept(fresh: DataFrame, documents: DataFrame, store: Store, batch_id: int, threshold: float) -> DataFrame:
    """``(key)``: the batch's chunks that are no duplicates, of the word sets of its newest versions."""
    spark, earlier, left = store.spark, [i for i in store.committed() if i < batch_id], None
    if earlier and fingerprints.any_stored(spark, f"{store.root}/fingerprints"):
        now = store.current(batch_id).select(_owner().alias("owner"), "version")
        replaced = documents.select(_owner().alias("owner")).distinct()

        def alive(known: DataFrame) -> DataFrame:
            return known.join(now, ["owner", "version"], "left_semi").join(replaced, "owner", "left_anti")

        seen = fingerprints.matches(
            spark, fresh, f"{store.root}/fingerprints", F.col("batch_id").isin(earlier), threshold, alive)
        fresh = left = cut(fresh.select("key", "n", "words", "print").join(seen.select("key"), "key", "left_anti"))
        release(seen)
    kept, made = dedup.kept_keys(fresh, threshold)
    release(left, made)
    return kept


def _by_source(count: F.Column) -> list[F.Column]:
    kinds = access.FOLDER_SOURCES.values()
    return [F.sum(F.when(F.col("source_type") == kind, count).otherwise(0)).alias(kind) for kind in kinds]


def ingest_batch(
    store: Store, files: DataFrame, batch_id: int, threshold: float = dedup.THRESHOLD,
    before_commit=lambda: None,
) -> None:
    """Bring landed ``files`` into the store as batch ``batch_id``; nothing happens if it is there.

    Counts of chunks are observed while the batch is written, in no pass of their own. Only the
    sources that the batch has files of are parsed, and what follows runs only if there are chunks.
    ``before_commit`` is called when all but the marker is written.
    """
    if batch_id in store.committed():
        return
    files = cut(files)
    landed = {r[0]: r[1] for r in files.groupBy("source_type").count().collect()}  # four rows at most
    found, broken = _extracted(files, list(landed))
    extracted = stored = {}
    if found is not None:
        seen = Observation()
        found = cut(found.observe(seen, *_by_source(F.col("text").isNotNull().cast("bigint"))))
        extracted = seen.get
    if any(extracted.values()):
        stored = _store_chunks(store, files, found.filter(F.col("text").isNotNull()), batch_id, threshold)
    else:
        store.clear(batch_id, "chunks", "documents", "index")
        fingerprints.forget(store.spark, f"{store.root}/fingerprints", batch_id)
    if landed:
        rejects = _rejects(files, found, broken)
        store.write("rejects", batch_id, rejects.select("filepath", "source_type", "error_message", "attempt", "ts"))
    else:
        store.clear(batch_id, "rejects")
    before_commit()
    counts = [
        (kind, landed.get(kind, 0), extracted.get(kind) or 0, stored.get(kind) or 0,
         (extracted.get(kind) or 0) - (stored.get(kind) or 0))
        for kind in access.FOLDER_SOURCES.values()
    ]
    store.write("commits", batch_id, store.spark.createDataFrame(counts, TABLES["commits"]).coalesce(1))
    release(files, found)


def _store_chunks(
    store: Store, files: DataFrame, chunks: DataFrame, batch_id: int, threshold: float
) -> dict[str, int]:
    """Write the batch's documents, its chunks without duplicates, their index and fingerprints; how
    many chunks of each source are stored."""
    stored = Observation()
    documents = cut(_numbered(files, chunks, store, batch_id))
    versions = documents.select(F.col("filepath").alias("__path"), F.col("filename").alias("__name"), "version", "newest")
    keyed = chunks.join(versions, F.col("filename") == F.col("__path")).select(
        "source_type", F.col("__name").alias("filename"), "version",
        F.col("chunk_index").cast("bigint").alias("chunk_index"), "text", "allowed_groups", "newest",
    )
    keyed = cut(ingest.keyed(keyed))
    fresh, older = cut(_sets(keyed.filter("newest"))), cut(_sets(keyed.filter(~F.col("newest"))))
    kept = _kept(fresh, documents, store, batch_id, threshold)

    def without_copies(newest: DataFrame, others: DataFrame, key: str) -> DataFrame:
        return dedup.picked(newest, kept.withColumnRenamed("key", key), key).unionByName(others)

    chunks = without_copies(keyed.filter("newest"), keyed.filter(~F.col("newest")), "chunk_key")
    chunks = chunks.observe(stored, F.count("*").alias("n"), *_by_source(F.lit(1)))
    store.write("chunks", batch_id, chunks.select(
        "chunk_key", *KEY, "version", "chunk_index", "text", "allowed_groups"
    ))
    store.write("documents", batch_id, documents.drop("newest"))
    sets = without_copies(fresh, older, "key")
    store.write("index", batch_id, sets.select(F.col("key").alias("chunk_key"), "source_type", "allowed_groups", "tokens"))
    fingerprints.remember(store.spark, sets, f"{store.root}/fingerprints", batch_id, threshold)
    release(documents, keyed, fresh, older, kept)
    return stored.get


def ingest_corpus(spark: SparkSession, root: str, store_root: str, batch_id: int = 0, **options) -> Store:
    """Every file below ``root`` as one batch."""
    store = Store(spark, store_root)
    ingest_batch(store, readers.read_files(spark, root), batch_id, **options)
    return store


def ingest_stream(
    files: DataFrame, store_root: str, checkpoint: str, **options
) -> StreamingQuery:
    """Every landed file of a stream, a batch at a time; see ``readers.read_files``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(Store(batch.sparkSession, store_root), batch, batch_id, **options)

    return (
        files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
