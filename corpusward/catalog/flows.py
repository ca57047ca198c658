"""File scans, sinks and streams. Files are written by Spark from the given tables first."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from corpusward import hooks
from corpusward.functions import text
from corpusward.catalog import tables as t
from corpusward.catalog.retrieval import _GREEDY
from corpusward.operators import admin, reports
from corpusward.operators.running import with_running
from corpusward.catalog.scalars import _redacted_sql
from corpusward.plans import corpus, ingest
from corpusward.session import cut, remove, scratch_path
from corpusward.sources import readers, sinks
from corpusward.streaming import freshness, jobs, retries, threads

C = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- scans -------------------------------------------------------------------------------------

@query("""SELECT CASE lang WHEN 'en' THEN 'confluence' WHEN 'fr' THEN 'slack' WHEN 'de' THEN 'excel' ELSE 'pdf' END AS source_type,
  count(*) AS n_lines, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1""")
def scan_corpus_by_folder(spark, sf):
    root = scratch_path(spark, "corpus")
    d = t.read(spark, sf, "documents")
    line = F.concat(C("doc_id").cast("string"), F.lit(" "), C("source"))
    for lang, folder in {"en": "confluence/deep", "fr": "slack", "de": "excel", "es": "pdfs"}.items():
        d.filter(C("lang") == lang).select(line.alias("value")).write.text(f"{root}/{folder}")
    # a folder that is not part of the layout is ignored
    d.select(line.alias("value")).write.text(f"{root}/misc")
    lines = readers.corpus_lines(spark, root)
    return lines.groupBy("source_type").agg(
        F.count("*").alias("n_lines"), F.sum(F.split("line", " ")[0].cast("bigint")).alias("ids")
    )


@query("SELECT md5(text) AS digest, length(text) AS n_chars FROM documents")
def scan_markdown(spark, sf):
    path = scratch_path(spark, "markdown")
    t.read(spark, sf, "documents").select("text").write.option("lineSep", readers.RECORD).text(path)
    docs = readers.read_markdown(spark, path, bundled=True)
    return docs.select(F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("n_chars"))


@query("""SELECT CASE WHEN conv_id % 5 = 0 THEN 'Unknown' ELSE role END AS "user",
  CASE WHEN conv_id % 7 = 0 THEN '' ELSE text END AS text,
  CASE WHEN conv_id % 3 = 0 THEN 0 ELSE (1690890000 + conv_id * 100 + turn) * 1000000 + turn + 1 END AS micros
FROM conversations WHERE conv_id % 11 <> 1""")
def scan_message_json(spark, sf):
    path = scratch_path(spark, "messages")
    n = C("conv_id")
    stamp = F.concat((n * 100 + C("turn") + 1690890000).cast("string"), F.lit("."), F.lpad((C("turn") + 1).cast("string"), 6, "0"))
    message = F.struct(
        F.when(n % 5 != 0, C("role")).alias("user"), F.when(n % 7 != 0, C("text")).alias("text"),
        F.when(n % 11 == 1, F.lit("soon")).when(n % 3 != 0, stamp).alias("ts"),
    )
    t.read(spark, sf, "conversations").select(F.to_json(F.array(message)).alias("value")).write.text(path)
    good, _ = readers.read_messages(spark, path, one_array_per_line=True)
    return good.select("user", "text", F.unix_micros("ts").alias("micros"))


@query("""SELECT event_id || ' ' || user_id || ' ' || event_type || ' ' || props AS row_text,
  'event_id user_id event_type props' AS header, row_number() OVER (ORDER BY event_id) AS place FROM events""")
def scan_table_csv(spark, sf):
    path = scratch_path(spark, "table")
    rows = t.read(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    # one file in order of its ids; it is read in splits all the same
    rows.coalesce(1).sortWithinPartitions("event_id").write.option("header", True).option("escape", '"').csv(path)
    schema = "event_id STRING, user_id STRING, event_type STRING, props STRING"
    table = cut(readers.read_table_rows(spark, path, schema, escape='"'))
    placed = with_running(table, ["filename"], ["row_no"], C("split"), inclusive={"place": ("sum", F.lit(1))})
    return placed.select("row_text", "header", "place")


# --- sinks -------------------------------------------------------------------------------------

@query(f"""WITH {t.CHUNKS}
SELECT chunk_key, source_type, CASE WHEN chunk_key % 3 = 0 AND source_type <> 'pdf' THEN 'new ' || filename ELSE filename END AS filename,
  array_to_string(allowed_groups, ',') AS groups FROM chunks WHERE chunk_key % 2 = 0 OR (chunk_key % 3 = 0 AND source_type <> 'pdf')""")
def sink_chunk_index(spark, sf):
    path = scratch_path(spark, "index")
    chunks = t.chunks(spark, sf).drop("text")
    sinks.write_chunk_index(spark, chunks.filter(C("chunk_key") % 2 == 0), path, ["chunk_key"], exists=False)
    update = chunks.filter((C("chunk_key") % 3 == 0) & (C("source_type") != "pdf"))
    update = update.withColumn("filename", F.concat(F.lit("new "), "filename"))
    sinks.write_chunk_index(spark, update, path, ["chunk_key"])
    return sinks.read_chunk_index(spark, path).select("chunk_key", "source_type", "filename", t.joined("allowed_groups").alias("groups"))


@query(f"""WITH {t.RETRIEVED}, {t.PRINCIPALS}, known AS (SELECT user_id FROM principals WHERE user_id % 3 <> 0),
lines AS (SELECT query_id, string_agg(chunk_key || ':' || filename || ':' || source_type || ':' ||
  array_to_string(allowed_groups, '+') || ':' || rerank_score, ';' ORDER BY rank) AS lineage FROM retrieved GROUP BY query_id)
SELECT a.query, a.response, a.served_from, k.user_id, coalesce(l.lineage, '') AS lineage
FROM audit_logs a LEFT JOIN known k ON k.user_id = a.user_id LEFT JOIN lines l ON l.query_id = a.id""")
def sink_audit_log(spark, sf):
    path = scratch_path(spark, "audit")
    logs = t.audit_logs(spark, sf).select(
        C("id").alias("query_id"), F.concat(F.lit("user"), "user_id").alias("username"), "query", "response", "served_from", "ts"
    )
    known = t.principals(spark, sf).filter(C("user_id") % 3 != 0)
    lineage = t.retrieved(spark, sf).withColumnRenamed("chunk_key", "chunk_id")
    for served in ("cache", "search"):
        sinks.append(admin.audit_rows(logs.filter(C("served_from") == served), known, lineage), path)
    cited = F.transform("retrieved_chunks", lambda c: F.concat_ws(
        ":", c["chunk_id"].cast("string"), c["filename"], c["source_type"],
        F.array_join(c["allowed_groups"], "+"), c["rerank_score"].cast("string"),
    ))
    return spark.read.parquet(path).select(
        "query", "response", "served_from", "user_id", F.coalesce(F.array_join(cited, ";"), F.lit("")).alias("lineage")
    )


@query(f"""WITH {t.FAILURES} SELECT filepath, source_type, error_message, attempt::INT AS retry_count, 'FAILED' AS status, ts AS created_at
FROM failures WHERE attempt >= 3""")
def sink_dlq(spark, sf):
    path = scratch_path(spark, "dlq")
    sinks.append(admin.dead_letters(t.failures(spark, sf)), path)
    return spark.read.parquet(path)


# --- streams -----------------------------------------------------------------------------------

def _stream(spark, sf, table):
    return jobs.table_stream(spark, f"{sf}/{table}.parquet*", t.read(spark, sf, table).schema)


def _stateful(spark):
    """A session of its own whose streams keep state on disk."""
    own = spark.newSession()
    for name, value in {**threads.STATE_SETTINGS, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(name, value)
    return own


def _done(q):
    q.awaitTermination()


@query(f"""WITH {t.MARKDOWN}, {t.SECTIONS} SELECT filename, count(*) AS n_chunks, sum(chunk_index)::BIGINT AS indexes FROM sections GROUP BY filename""")
def stream_sections(spark, sf):
    out, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "offsets")

    def chunks(batch):
        staged = scratch_path(spark, "landing")
        batch.write.parquet(f"{staged}/documents.parquet")
        return ingest.from_markdown(t.markdown(spark, staged))

    _done(jobs.ingest_stream(_stream(spark, sf, "documents"), chunks, out, checkpoint))
    return spark.read.parquet(out).groupBy("filename").agg(
        F.count("*").alias("n_chunks"), F.sum("chunk_index").alias("indexes")
    )


def _deliveries(spark, sf):
    """The documents as files of all four kinds in two deliveries; every tenth comes twice."""
    n, body = C("doc_id"), F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" "))
    message = F.to_json(F.array(F.struct(C("lang").alias("user"), body.alias("text"), F.lit("1690890000").alias("ts"))))
    line = F.concat(F.lit("id,source,lang\n"), F.concat_ws(",", n.cast("string"), "source", "lang"))
    d = t.read(spark, sf, "documents").select("doc_id", "text", "source", "lang").join(
        t.markdown(spark, sf).select("doc_id", C("text").alias("marked")), "doc_id"
    )
    files = d.select(
        "doc_id", t._case(n % 4, {0: F.lit("confluence"), 1: F.lit("slack"), 2: F.lit("excel")}, F.lit("pdfs")).alias("folder"),
        F.when(n % 4 == 0, C("marked")).when(n % 12 == 1, F.lit('[{"user": ')).when(n % 4 == 1, message)
        .when(n % 4 == 2, line).otherwise(body).alias("value"),
    )
    middle = files.select(F.max("doc_id") / 2).scalar()
    late = C("doc_id") >= middle
    second = files.filter(late).withColumn("d", F.lit(2)).unionByName(files.filter("doc_id % 10 = 0").withColumn("d", F.lit(3)))
    for part in (files.filter(~late).withColumn("d", F.lit(1)), second):
        yield part.select(
            F.concat(F.lit("/d"), "d", F.lit("/"), "folder", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
            "value", F.timestamp_seconds(F.lit(1700000000) + C("d") * 60).alias("modified"),
        )


_CORPUS = f"""{t.MARKDOWN}, {t.SECTIONS},
texts AS (
  SELECT doc_id, '' AS head, section AS text FROM sections WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, '[Slack Conversation 0]' || chr(10), 'User ' || lang || ': ' || replace(coalesce(text, ''), chr(12), ' ')
  FROM documents WHERE doc_id % 4 = 1 AND doc_id % 12 <> 1
  UNION ALL SELECT doc_id, 'Table: ' || doc_id || '.txt - Chunk 0' || chr(10) || chr(10),
    'id source lang' || chr(10) || doc_id || ' ' || source || ' ' || lang FROM documents WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_id, 'Document: ' || doc_id || '.txt - Part 1' || chr(10) || chr(10), replace(text, chr(12), ' ')
  FROM documents WHERE doc_id % 4 = 3 AND {t.sql_strip("replace(coalesce(text, ''), chr(12), ' ')")} <> ''),
chunks AS (SELECT doc_id, list_sort(list_distinct({t.sql_words("head || redacted")})) AS words
  FROM (SELECT doc_id, head, {_redacted_sql('texts')} AS redacted FROM texts)),
active AS (SELECT words FROM chunks GROUP BY words),
found AS (SELECT DISTINCT doc_id FROM chunks)
SELECT 'documents' AS name, (SELECT count(*) + count(*) FILTER (doc_id % 10 = 0) FROM found) AS n_rows, 0::BIGINT AS n_words
UNION ALL SELECT 'extracted', (SELECT count(*) + count(*) FILTER (doc_id % 10 = 0) FROM chunks), 0
UNION ALL SELECT 'chunks', count(*), coalesce(sum(len(words)), 0)::BIGINT FROM active
UNION ALL SELECT 'index', count(*), coalesce(sum(len(words)), 0)::BIGINT FROM active
UNION ALL SELECT 'rejects', (SELECT count(*) + count(*) FILTER (doc_id % 10 = 0) FROM documents WHERE doc_id % 12 = 1), 0"""


def _corpus_tables(store):
    """Rows and distinct words per table. Which of equal chunks is stored depends on their keys, so
    the counts are those that do not."""
    words = F.size(text.word_set(C("text")))
    counted = lambda df, name, n: df.select(
        F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_words"))
    none = F.lit(0)
    extracted = store.table("commits").select(
        F.lit("extracted").alias("name"), F.sum("extracted").alias("n_rows"), F.lit(0).cast("bigint").alias("n_words"))
    return reduce(lambda a, b: a.unionByName(b), [
        counted(store.table("documents"), "documents", none), extracted,
        counted(store.active(), "chunks", words), counted(store.active("index"), "index", F.size("tokens")),
        counted(store.table("rejects"), "rejects", none),
    ])


@query(f"WITH {_CORPUS}")
def stream_ingest(spark, sf):
    store, inbox, checkpoint = (scratch_path(spark, n) for n in ("store", "landing", "offsets"))
    for n, part in enumerate(_deliveries(spark, sf)):
        part.write.parquet(f"{inbox}/{n}")
        landed = readers.landed(jobs.table_stream(spark, f"{inbox}/*", part.schema))
        _done(corpus.ingest_stream(landed, store, checkpoint, threshold=1.0))
    return _corpus_tables(corpus.Store(spark, store))


@query(f"WITH {_CORPUS}")
def ingest_corpus(spark, sf):
    store = corpus.Store(spark, scratch_path(spark, "store"))
    for n, part in enumerate(_deliveries(spark, sf)):
        corpus.ingest_batch(store, readers.landed(part), n, threshold=1.0)
    return _corpus_tables(store)


@query("""WITH flagged AS (
  SELECT user_id AS channel, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 600000000 THEN 0 ELSE 1 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
threads AS (SELECT *, sum(starts) OVER (PARTITION BY channel ORDER BY ts, event_id) AS n FROM flagged)
SELECT channel, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_messages FROM threads GROUP BY channel, n
HAVING epoch_us(max(ts)) + 599999999 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 600000000""")
def stream_sessionize(spark, sf):
    out, checkpoint = scratch_path(spark, "threads"), scratch_path(spark, "offsets")
    live = _stream(spark, sf, "events").select(C("user_id").alias("channel"), C("ts").cast("timestamp").alias("ts"))
    _done(jobs.run_to_table(jobs.sessions(live), out, checkpoint))
    return spark.read.parquet(out)


@query("""WITH flagged AS (
  SELECT user_id::VARCHAR AS channel, ts, event_id, event_type,
    CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 600000000 THEN 1 ELSE 0 END AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
threads AS (SELECT *, sum(starts) OVER (PARTITION BY channel ORDER BY ts, event_id)::BIGINT AS thread_no FROM flagged)
SELECT channel, thread_no, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_messages,
  string_agg('User ' || channel || ': ' || event_type, chr(10) ORDER BY ts, event_id) AS text
FROM threads GROUP BY channel, thread_no
HAVING epoch_us(max(ts)) + 600000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 600000000""")
def stream_threads(spark, sf):
    out, checkpoint = scratch_path(spark, "threads"), scratch_path(spark, "offsets")
    live = _stream(_stateful(spark), sf, "events").select(
        C("user_id").alias("channel"), C("ts").cast("timestamp").alias("ts"), C("event_id").alias("pos"),
        C("user_id").cast("string").alias("user"), C("event_type").alias("text"),
    )
    _done(jobs.run_to_table(threads.threads(live), out, checkpoint))
    return spark.read.parquet(out).drop("part", "closed")


@query(f"""WITH RECURSIVE {_GREEDY}
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dropped)""")
def stream_dedup(spark, sf):
    out, state, checkpoint = (scratch_path(spark, n) for n in ("kept", "fingerprints", "offsets"))
    # two deliveries of the table, split at the middle: the second meets the first one's state
    docs = t.read(spark, sf, "documents").select("doc_id", "text")
    inbox = scratch_path(spark, "inbox")
    middle = docs.select(F.max("doc_id") / 2).scalar()
    for n, part in enumerate((docs.filter(C("doc_id") < middle), docs.filter(C("doc_id") >= middle))):
        part.write.parquet(f"{inbox}/{n}")
        arrived = jobs.table_stream(spark, f"{inbox}/*", docs.schema)
        _done(jobs.dedup_stream(spark, arrived, state, out, checkpoint, key="doc_id"))
        remove(spark, f"{inbox}/{n}")  # a delivery goes once it is worked off
    return spark.read.parquet(out).select("doc_id")


@query(f"""WITH {t.FAILURES}
SELECT filepath, 'retry' AS outcome, (attempt + 1)::BIGINT AS attempt,
  ts + to_seconds(least(60, (2 ** attempt)::INT)) AS due FROM failures WHERE attempt < 3
UNION ALL SELECT filepath, 'dead', attempt::BIGINT, ts FROM failures WHERE attempt >= 3""")
def retry_then_dlq(spark, sf):
    again, dead, checkpoint = (scratch_path(spark, n) for n in ("retry", "dlq", "offsets"))
    inbox = scratch_path(spark, "inbox")
    t.failures(spark, sf).write.parquet(inbox)
    failed = jobs.table_stream(spark, inbox, spark.read.parquet(inbox).schema)
    _done(jobs.retry_stream(failed, again, dead, checkpoint))
    retry = spark.read.parquet(again).select(
        "filepath", F.lit("retry").alias("outcome"), "attempt", C("next_attempt_at").cast("timestamp").alias("due")
    )
    return retry.unionByName(spark.read.parquet(dead).select(
        "filepath", F.lit("dead").alias("outcome"), C("retry_count").cast("bigint").alias("attempt"),
        C("created_at").cast("timestamp").alias("due"),
    ))


def _as_messages(docs, mended):
    """Every document as a file with one message; where ``mended`` is false the file is cut short."""
    whole = F.to_json(F.array(F.struct(
        C("lang").alias("user"), F.coalesce("text", F.lit("")).alias("text"), F.lit("1690890000").alias("ts"))))
    return docs.select(
        F.concat(F.lit("/d/slack/"), "doc_id", F.lit(".json")).alias("path"),
        F.when(mended, whole).otherwise(F.lit('[{"user": ')).alias("value"),
        F.timestamp_seconds(F.lit(1700000000)).alias("modified"),
    )


@query("""SELECT '/d/slack/' || doc_id || '.json' AS filepath, CASE WHEN doc_id % 3 = 1 THEN 'dead' ELSE 'stored' END AS outcome,
  CASE doc_id % 3 WHEN 2 THEN 3 WHEN 1 THEN 4 ELSE 1 END::BIGINT AS tries FROM documents""")
def retry_ingest(spark, sf):
    """A third of the files is whole at once, a third at the third try, a third never."""
    own = _stateful(spark)
    docs = t.read(own, sf, "documents").select("doc_id", "text", "lang")
    root, inbox, offsets = (scratch_path(spark, n) for n in ("store", "landing", "offsets"))
    first = _as_messages(docs, C("doc_id") % 3 == 0)
    first.write.parquet(inbox)

    def again(session, due):
        third = due.filter("attempt = 2").select(C("path").alias("__path"))
        names = docs.withColumn("__path", F.concat(F.lit("/d/slack/"), "doc_id", F.lit(".json"))).join(
            due.select(C("path").alias("__path")), "__path", "left_semi"
        ).join(third.withColumn("__third", F.lit(True)), "__path", "left")
        return _as_messages(names, C("__third") & (C("doc_id") % 3 == 2))

    landed = readers.landed(jobs.table_stream(own, inbox, first.schema))
    live = retries.ingest_stream(landed, root, offsets, again=again, second_ms=1, trigger="0 seconds", threshold=1.0)
    # files are told apart by their paths: rows may repeat, or have no id
    store, ended, seen = corpus.Store(spark, root), 0, None
    files = docs.filter(C("doc_id").isNotNull()).select("doc_id").distinct().count()
    try:
        while ended < files:
            if (done := store.committed()) != seen:  # nothing ends between two commits
                both = store.table("documents").select("filepath").unionByName(store.table("dead").select("filepath"))
                seen, ended = done, both.distinct().count()
            elif live.awaitTermination(1):
                break
    finally:
        live.stop()
    failed = store.table("rejects").groupBy("filepath").agg(F.count("*").alias("failed"))
    ended = store.table("documents").select("filepath", F.lit("stored").alias("outcome")).unionByName(
        store.table("dead").select("filepath", F.lit("dead").alias("outcome")))
    return ended.join(failed, "filepath", "left").select(
        "filepath", "outcome",
        (F.coalesce("failed", F.lit(0)) + (C("outcome") == "stored").cast("bigint")).alias("tries"))


@query("""WITH activity AS (SELECT props AS cache_key, event_id AS id, ts, event_type = 'purchase' AS is_write FROM events),
seen AS (SELECT *, max(CASE WHEN is_write THEN epoch_us(ts) END) OVER (PARTITION BY cache_key ORDER BY ts, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS written FROM activity)
SELECT id, cache_key, coalesce(epoch_us(ts) - written < 3600000000, false) AS hit FROM seen WHERE NOT is_write""")
def stream_cache_ttl(spark, sf):
    out, checkpoint = scratch_path(spark, "hits"), scratch_path(spark, "offsets")
    activity = _stream(_stateful(spark), sf, "events").select(
        C("props").alias("cache_key"), C("event_id").alias("id"), C("ts").cast("timestamp").alias("ts"),
        (C("event_type") == "purchase").alias("is_write"),
    )
    _done(jobs.run_to_table(freshness.cache_hits(activity), out, checkpoint))
    return spark.read.parquet(out).select("id", "cache_key", "hit")


@query("""SELECT date_trunc('minute', ts) AS minute, event_type AS caller, count(*) AS n_requests
FROM events GROUP BY ALL HAVING count(*) > 1""")
def rate_limit_report(spark, sf):
    calls = t.read(spark, sf, "events").select("ts", C("event_type").alias("caller"))
    return reports.over_limit(calls, 1)


# --- hook --------------------------------------------------------------------------------------

def _load_detector():
    """Stand-in model: a capitalised ASCII word counts as a name."""
    name = re.compile(r"(?<![0-9A-Za-z_])[A-Z][a-z]{5,}(?![0-9A-Za-z_])")

    def detect(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"start": m.start(), "end": m.end()} for m in name.finditer(x)])

    return detect


@query(r"SELECT doc_id, regexp_replace(text, '\b[A-Z][a-z]{5,}\b', '<PERSON>', 'g') AS redacted FROM documents")
def detect_person(spark, sf):
    spans = hooks.person_detector(_load_detector)
    found = t.read(spark, sf, "documents").select("doc_id", "text", spans(C("text")).alias("spans"))
    return found.select("doc_id", hooks.mask_spans(C("text"), C("spans")).alias("redacted"))
