"""The ingest chain: parsed sources to a redacted, deduplicated, versioned chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions import access, pii, text
from corpusward.operators import chunking, dedup

COLUMNS = ["source_type", "filename", "chunk_index", "text", "allowed_groups"]


def _shaped(chunks: DataFrame, source_type: str) -> DataFrame:
    return chunks.withColumn("source_type", F.lit(source_type)).select(
        "source_type", "filename", F.col("chunk_index").cast("bigint").alias("chunk_index"),
        "text", "allowed_groups",
    )


def from_markdown(docs: DataFrame) -> DataFrame:
    """``docs(filename, text)``: one chunk per section, redacted after its groups were read."""
    cut = chunking.markdown_chunks(docs)
    return _shaped(cut.withColumn("text", pii.redact(F.col("text"))), "confluence")


def from_messages(messages: DataFrame, gap_seconds: int = 600) -> DataFrame:
    """``messages(filename, user, text, ts, pos)``: one chunk per thread."""
    threads = chunking.sessionize(messages, "filename", gap_seconds=gap_seconds)
    chunks = chunking.thread_chunks(threads, "filename")
    body = text.chat_header(pii.redact(F.col("text")), F.col("chunk_index"))
    return _shaped(chunks.withColumn("text", body), "slack")


def from_tables(rows: DataFrame, bucket: Column, budget: int = 500) -> DataFrame:
    """``rows(filename, row_no, row_text)``: packed rows under the table's name.

    A column ``header`` is repeated on top of every chunk.
    """
    header = "header" if "header" in rows.columns else None
    chunks = chunking.table_chunks(rows, bucket, budget, header)
    name = access.basename(F.col("filename"))
    body = text.table_header(pii.redact(F.col("text")), name, F.col("chunk_index"))
    return _shaped(chunks.withColumn("text", body), "excel")


def from_pages(parts: DataFrame) -> DataFrame:
    """``parts(filename, chunk_index, text)``: text of page-like documents, blank parts skipped."""
    chunks = chunking.page_chunks(parts)
    name = access.basename(F.col("filename"))
    body = text.page_header(pii.redact(F.col("text")), name, F.col("chunk_index"))
    return _shaped(chunks.withColumn("text", body), "pdf")


def union_sources(*parts: DataFrame) -> DataFrame:
    """All sources as one chunk set, with a stable key per chunk."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keyed(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_key``, a hash of the natural key."""
    natural = [c for c in ("source_type", "filename", "version", "chunk_index") if c in chunks.columns]
    return chunks.withColumn("chunk_key", F.xxhash64(*natural))


def new_chunks(arrived: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Arrived chunks worth storing (``chunk_key, source_type, filename, text, ...``).

    Duplicates are looked for inside the arrivals and among the active chunks of *other*
    documents: text that a new version repeats from the version it replaces must stay.
    """
    if active is not None:
        replaced = arrived.select("source_type", "filename").distinct()
        others = active.join(replaced, ["source_type", "filename"], "left_anti")
        seen = dedup.matches(dedup.word_sets(arrived), dedup.word_sets(others))
        arrived = arrived.join(seen.select(F.col("key").alias("chunk_key")), "chunk_key", "left_anti")
    return dedup.keep_first(arrived)


def redacted_names(docs: DataFrame, names: DataFrame, key: str, body: str = "text") -> DataFrame:
    """Mask the dictionary's names (column ``name``), of one word or more, in ``body``.

    Names are joined by their first word on the words of the texts, and only texts with a hit are
    joined back; there the whole name is looked for, longer names first.
    """
    listed = names.select("name").distinct().withColumn(
        "__word", F.element_at(pii.name_tokens(F.col("name")), 1)
    ).filter(F.size(pii.name_tokens(F.col("name"))) > 0)
    found = (
        docs.select(key, F.explode(pii.name_tokens(F.col(body))).alias("__word"))
        .join(listed, "__word")
        .groupBy(key).agg(
            F.transform(
                F.sort_array(F.collect_set(F.struct(F.length("name"), "name")), asc=False),
                lambda n: n["name"],
            ).alias("__names")
        )
    )
    masked = pii.mask_names(F.col(body), F.coalesce("__names", access.strings()))
    return docs.join(found, key, "left").withColumn(body, masked).drop("__names")
