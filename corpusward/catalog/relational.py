"""Joins, aggregations, windows, paging and set operations over whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from corpusward.catalog import tables as t
from corpusward.catalog.scalars import VERSIONS_SQL, versioned
from corpusward.functions import access, guard, text
from corpusward.operators import admin, cache, chunking, reports, versions
from corpusward.operators.running import id_bucket
from corpusward.plans import ingest
from corpusward.session import scratch_path

C = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- joins -------------------------------------------------------------------------------------

@query(f"""WITH {t.AUDIT}, {t.PRINCIPALS}, known AS (SELECT * FROM principals WHERE user_id % 3 <> 0)
SELECT a.id, coalesce(k.user_id::VARCHAR, 'Anon') AS shown
FROM audit_logs a LEFT JOIN known k ON k.username = 'user' || a.user_id""")
def audit_user_join(spark, sf):
    known = t.principals(spark, sf).filter(C("user_id") % 3 != 0)
    logs = t.audit_logs(spark, sf).select("id", F.concat(F.lit("user"), "user_id").alias("username"))
    found = logs.join(known.select("username", "user_id"), "username", "left")
    return found.select("id", admin.display_user(C("user_id")).alias("shown"))


@query(f"""WITH {VERSIONS_SQL}, chunks AS (
  SELECT doc_id, lang AS source_type, source || '.md' AS filename, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents)
SELECT c.doc_id, c.chunk_index, v.version, v.is_active, length(c.line) AS n_chars
FROM chunks c JOIN versions v ON c.doc_id = v.doc_id""")
def chunk_document_join(spark, sf):
    lines = t.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    docs = versioned(spark, sf).select("doc_id", "version", "is_active")
    return lines.join(docs, "doc_id").select(
        "doc_id", C("chunk_index").cast("bigint").alias("chunk_index"), "version", "is_active",
        F.length("line").cast("bigint").alias("n_chars"),
    )


_EXISTING = "(SELECT * FROM principals WHERE user_id % 2 = 0)"


@query(f"""WITH {t.PRINCIPALS}, requested AS (
  SELECT event_id AS request_id, 'user' || user_id AS username FROM events WHERE event_type = 'signup'),
accepted AS (SELECT username, min(request_id) AS request_id FROM requested
  WHERE username NOT IN (SELECT username FROM {_EXISTING}) GROUP BY username)
SELECT r.request_id, r.username, CASE WHEN a.request_id IS NULL THEN 'rejected' ELSE 'Public' END AS outcome
FROM requested r LEFT JOIN accepted a ON a.request_id = r.request_id""")
def register_if_absent(spark, sf):
    existing = t.principals(spark, sf).filter(C("user_id") % 2 == 0)
    asked = t.read(spark, sf, "events").filter(C("event_type") == "signup").select(
        C("event_id").alias("request_id"), F.concat(F.lit("user"), "user_id").alias("username")
    )
    accepted, rejected = admin.register(existing, asked)
    return accepted.select("request_id", "username", t.joined("groups").alias("outcome")).unionByName(
        rejected.select("request_id", "username", F.lit("rejected").alias("outcome"))
    )


@query(f"""WITH {t.PRINCIPALS}, changes AS (
  SELECT 'user' || (user_id * 2) AS username, ['role' || (user_id % 3), 'HR'] AS groups FROM principals)
SELECT p.username, array_to_string(coalesce(c.groups, p.groups), ',') AS groups, 'kept' AS outcome
FROM principals p LEFT JOIN changes c USING (username)
UNION ALL
SELECT username, array_to_string(groups, ','), 'rejected' FROM changes
WHERE username NOT IN (SELECT username FROM principals)""")
def update_groups(spark, sf):
    people = t.principals(spark, sf)
    changes = people.select(
        F.concat(F.lit("user"), C("user_id") * 2).alias("username"),
        F.array(F.concat(F.lit("role"), C("user_id") % 3), F.lit("HR")).alias("groups"),
    )
    updated, rejected = admin.update_groups(people, changes)
    return updated.select("username", t.joined("groups").alias("groups"), F.lit("kept").alias("outcome")).unionByName(
        rejected.select("username", t.joined("groups").alias("groups"), F.lit("rejected").alias("outcome"))
    )


@query("""SELECT c_custkey AS user_id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS groups
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def role_membership(spark, sf):
    users = t.read(spark, sf, "customer").select(C("c_custkey").alias("user_id"))
    orders = t.read(spark, sf, "orders")
    held = orders.select(C("o_custkey").alias("user_id"), F.md5("o_orderpriority").alias("role_id")).distinct()
    roles = orders.select(F.md5("o_orderpriority").alias("role_id"), C("o_orderpriority").alias("role_name")).distinct()
    return admin.role_membership(users, held, roles).select("user_id", t.joined("groups").alias("groups"))


@query(f"""WITH {t.AUDIT}, {t.PRINCIPALS}, {t.CHUNKS},
gone_docs AS (SELECT DISTINCT filename FROM chunks WHERE source_type = 'slack' AND chunk_key % 3 = 0),
gone_users AS (SELECT user_id FROM principals WHERE user_id % 4 = 1)
SELECT 'chunk' AS kind, chunk_key AS id, NULL::BIGINT AS user_id FROM chunks
WHERE NOT (source_type = 'slack' AND filename IN (SELECT filename FROM gone_docs))
UNION ALL
SELECT 'audit', id, CASE WHEN user_id IN (SELECT user_id FROM gone_users) THEN NULL ELSE user_id END FROM audit_logs""")
def referential_actions(spark, sf):
    chunks = t.chunks(spark, sf).select("chunk_key", "source_type", "filename")
    docs = chunks.select("source_type", "filename").distinct()
    doomed = chunks.filter((C("source_type") == "slack") & (C("chunk_key") % 3 == 0))
    _, left = admin.delete_documents(docs, chunks, doomed, ["source_type", "filename"])
    people = t.principals(spark, sf)
    _, logs = admin.delete_users(people, t.audit_logs(spark, sf).select("id", "user_id"), people.filter(C("user_id") % 4 == 1))
    return left.select(F.lit("chunk").alias("kind"), C("chunk_key").alias("id"), F.lit(None).cast("bigint").alias("user_id")).unionByName(
        logs.select(F.lit("audit").alias("kind"), "id", "user_id")
    )


@query(f"""WITH {t.AUDIT}, {t.CHUNKS}, cited AS (
  SELECT id, unnest(CASE WHEN len(chunk_ids) = 0 THEN [NULL]::BIGINT[] ELSE chunk_ids END) AS chunk_key FROM audit_logs)
SELECT id, c.chunk_key, filename, source_type, array_to_string(allowed_groups, ',') AS groups
FROM cited c LEFT JOIN chunks k ON k.chunk_key = c.chunk_key""")
def lineage_explode_join(spark, sf):
    logs = t.audit_logs(spark, sf).select("id", "chunk_ids")
    cards = admin.lineage_cards(logs, t.chunks(spark, sf).drop("text"))
    return cards.select("id", "chunk_key", "filename", "source_type", t.joined("allowed_groups").alias("groups"))


# --- aggregations ------------------------------------------------------------------------------

_MESSAGES = """messages AS (
  SELECT user_id AS channel, event_id AS pos, ts, event_type AS usr, props AS text FROM events),
flagged AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 600000000 THEN 0 ELSE 1 END AS starts
  FROM messages WINDOW w AS (PARTITION BY channel ORDER BY ts, pos)),
threads AS (SELECT *, sum(starts) OVER (PARTITION BY channel ORDER BY ts, pos) - 1 AS thread_no FROM flagged)"""


def _messages(spark, sf):
    return t.read(spark, sf, "events").select(
        C("user_id").alias("channel"), C("event_id").alias("pos"), "ts", C("event_type").alias("user"), C("props").alias("text")
    )


@query(f"""WITH {_MESSAGES}
SELECT channel, thread_no::BIGINT AS chunk_index,
       '[Slack Conversation ' || thread_no || ']' || chr(10) ||
       string_agg('User ' || usr || ': ' || text, chr(10) ORDER BY ts, pos) AS text
FROM threads GROUP BY channel, thread_no""")
def assemble_thread(spark, sf):
    chunks = chunking.thread_chunks(chunking.sessionize(_messages(spark, sf)))
    return chunks.select("channel", "chunk_index", text.chat_header(C("text"), C("chunk_index")).alias("text"))


@query(f"""WITH {_MESSAGES} SELECT channel, pos, thread_no::BIGINT AS thread_no,
  row_number() OVER (PARTITION BY channel, thread_no ORDER BY ts, pos) - 1 AS nth FROM threads""")
def sessionize_gap(spark, sf):
    return chunking.sessionize(_messages(spark, sf)).select("channel", "pos", "thread_no", "nth")


@query(f"""WITH {t.RETRIEVED} SELECT query_id, array_to_string(list_sort(list(DISTINCT g)), ',') AS groups
FROM (SELECT query_id, unnest(allowed_groups) AS g FROM retrieved) GROUP BY query_id""")
def union_answer_groups(spark, sf):
    return reports.answer_groups(t.retrieved(spark, sf)).select("query_id", t.joined("groups").alias("groups"))


@query(f"""WITH {t.RETRIEVED} SELECT query_id, array_to_string(list_sort(list(DISTINCT filename)), ',') AS files
FROM retrieved GROUP BY query_id""")
def retrieved_file_set(spark, sf):
    return reports.retrieved_files(t.retrieved(spark, sf)).select("query_id", t.joined("files").alias("files"))


@query(f"""WITH {t.RETRIEVED}, blocks AS (
  SELECT query_id, string_agg('--- Document ' || rank || ' ---' || chr(10) || 'Source File: ' || filename || chr(10)
    || 'Content:' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context FROM retrieved GROUP BY query_id)
SELECT query_id, md5('Context Chunks:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query || chr(10)
  || chr(10) || 'Answer:') AS prompt FROM blocks JOIN audit_logs ON id = query_id""")
def assemble_context(spark, sf):
    asked = t.audit_logs(spark, sf).select(C("id").alias("query_id"), "query")
    ready = reports.shared_context(asked, t.found(spark, sf), t.chunks(spark, sf))
    return ready.select("query_id", F.md5(guard.prompt(C("context"), C("query"))).alias("prompt"))


@query(f"WITH {t.AUDIT} SELECT count(*) AS total FROM audit_logs")
def audit_total(spark, sf):
    return t.audit_logs(spark, sf).agg(F.count("*").alias("total"))


@query(f"WITH {t.DLQ} SELECT count(*) AS total FROM dlq WHERE status = 'RETRIED'")
def dlq_total(spark, sf):
    return admin.with_status(t.dlq(spark, sf), "Retried").agg(F.count("*").alias("total"))


@query("""SELECT props AS filename, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_loads,
  arg_max(user_id, event_id) AS loaded_by, arg_max(event_type, event_id) AS status FROM (
    SELECT * FROM events ORDER BY ts) GROUP BY props""")
def ingestion_log(spark, sf):
    e = t.read(spark, sf, "events")
    loads = e.select(
        C("props").alias("filename"), "ts", C("event_id").alias("id"), C("user_id").alias("loaded_by"),
        C("event_type").alias("status"),
    )
    return reports.ingestion_log(loads)


@query(f"""WITH {t.CHUNKS}, sets AS (
  SELECT *, list_sort(list_distinct({t.sql_words('text')})) AS words FROM chunks),
marked AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY chunk_key) = 1 AS kept FROM sets)
SELECT source_type, count(DISTINCT filename) AS files, count(*) AS extracted,
  count(*) FILTER (NOT kept) AS duplicates, count(*) FILTER (kept) AS stored FROM marked GROUP BY source_type""")
def ingest_summary(spark, sf):
    from corpusward.operators import dedup

    chunks = t.chunks(spark, sf)
    first = dedup.exact_first(dedup.word_sets(chunks)).withColumn("kept", F.lit(True))
    marked = chunks.select("chunk_key", "source_type", "filename").join(
        first.withColumnRenamed("key", "chunk_key"), "chunk_key", "left"
    )
    return reports.ingest_summary(marked, F.coalesce("kept", F.lit(False)))


@query(f"""WITH {t.ANSWERS}, {t.CITED}
SELECT sum(len(names))::BIGINT AS n_citations,
  sum(len(list_filter(names, lambda n: list_contains(files, n))))::BIGINT AS n_valid,
  sum(len(list_filter(names, lambda n: list_contains(files, n)))) / sum(len(names)) AS precision FROM cited""")
def citation_precision(spark, sf):
    return reports.citation_precision(t.answers(spark, sf))


@query(f"""WITH {t.AUDIT}, {t.CHUNKS}, {t.PRINCIPALS}, cited AS (
  SELECT id, user_id, unnest(chunk_ids) AS chunk_key FROM audit_logs)
SELECT id, c.user_id, c.chunk_key FROM cited c JOIN chunks k ON k.chunk_key = c.chunk_key
JOIN principals p ON p.user_id = c.user_id
WHERE NOT list_has_any(k.allowed_groups, list_append(p.groups, 'Public'))""")
def acl_leak_audit(spark, sf):
    logs = t.audit_logs(spark, sf).select("id", "user_id", "chunk_ids")
    chunks = t.chunks(spark, sf).select("chunk_key", "allowed_groups")
    return admin.leaks(logs, chunks, t.principals(spark, sf)).select("id", "user_id", "chunk_key")


@query(f"""WITH {t.REQUESTS}
SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_requests, quantile_disc(latency_ms, 0.95) AS p95_ms,
  avg(cached::INT) AS cache_hit_rate, avg(failed::INT) AS failure_rate, sum(tokens)::BIGINT AS tokens, sum(cost)::BIGINT AS cost,
  quantile_disc(latency_ms, 0.95) > 8000 AS slow, avg(cached::INT) < 0.2 AS cold_cache, avg(failed::INT) > 0.05 AS failing
FROM requests GROUP BY 1""")
def ops_rollup(spark, sf):
    return reports.ops_rollup(t.requests(spark, sf))


# --- tables as chunks ---------------------------------------------------------------------------

_ROWS = """rows AS (
  SELECT source || CASE WHEN doc_id % 2 = 0 THEN '_payroll.csv' ELSE '.csv' END AS filename, doc_id AS row_no,
         lang || ' ' || n_chars || ' ' || text AS row_text FROM documents)"""


def _rows(spark, sf):
    d = t.read(spark, sf, "documents")
    end = F.when(C("doc_id") % 2 == 0, "_payroll.csv").otherwise(".csv")
    return d.select(
        F.concat("source", end).alias("filename"), C("doc_id").alias("row_no"),
        F.concat_ws(" ", "lang", C("n_chars").cast("string"), "text").alias("row_text"),
    )


@query(f"""WITH {_ROWS}, placed AS (
  SELECT *, coalesce(sum(length(row_text) + 1) OVER (PARTITION BY filename ORDER BY row_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 5000 AS slot FROM rows),
packed AS (SELECT filename, slot, string_agg(row_text, chr(10) ORDER BY row_no) AS text FROM placed GROUP BY ALL)
SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY slot) - 1 AS chunk_index, text,
  CASE WHEN contains(filename, 'payroll') THEN 'HR,Management,Finance' ELSE 'Public' END AS groups FROM packed""")
def chunk_table_rows(spark, sf):
    chunks = chunking.table_chunks(_rows(spark, sf), id_bucket(C("row_no")), budget=5000)
    return chunks.select("filename", "chunk_index", "text", t.joined("allowed_groups").alias("groups"))


@query("""SELECT o_orderpriority || '.csv' AS filename, '| key | status |' || chr(10) || '|---|---|' || chr(10) ||
  string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) AS text FROM (
    SELECT o_orderpriority, o_orderkey, o_orderstatus FROM orders)
GROUP BY 1""")
def chunk_table_whole(spark, sf):
    o = t.read(spark, sf, "orders")
    name = F.concat("o_orderpriority", F.lit(".csv"))
    rows = o.select(
        name.alias("filename"), F.lit("| key | status |\n|---|---|").alias("header"), C("o_orderkey").alias("row_no"),
        F.concat(F.lit("| "), "o_orderkey", F.lit(" | "), "o_orderstatus", F.lit(" |")).alias("row_text"),
    )
    return chunking.whole_table_chunks(rows, id_bucket(C("row_no"))).select("filename", "text")


# --- versions, paging, sets ---------------------------------------------------------------------

@query(f"WITH {VERSIONS_SQL} SELECT doc_id, source_type, filename, version, is_active FROM versions")
def version_documents(spark, sf):
    # documents of even and odd thousands arrive in two loads; the second continues the first
    d = t.read(spark, sf, "documents").select(
        "doc_id", C("lang").alias("source_type"), F.concat("source", F.lit(".md")).alias("filename")
    )
    middle = d.select(F.max("doc_id") / 2).scalar()
    bucket = id_bucket(C("doc_id"))
    first = versions.number_versions(d.filter(C("doc_id") < middle), ["doc_id"], bucket)
    return versions.add_versions(first, d.filter(C("doc_id") >= middle), ["doc_id"], bucket)


@query(f"WITH {VERSIONS_SQL} SELECT source_type, filename, max(version) AS version, max(doc_id) AS doc_id FROM versions GROUP BY ALL")
def latest_version_lookup(spark, sf):
    return versions.latest(versioned(spark, sf), "doc_id")


@query(f"""WITH {t.AUDIT} SELECT id, user_id, query, response, timestamp FROM (
  SELECT *, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                 ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp
  FROM audit_logs ORDER BY ts DESC, id DESC LIMIT 200 OFFSET 150)""")
def page_audit_log(spark, sf):
    return admin.audit_page(t.audit_logs(spark, sf), 150, 200).select("id", "user_id", "query", "response", "timestamp")


@query(f"""WITH {t.DLQ} SELECT * FROM dlq WHERE status = 'FAILED'
ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 5""")
def page_dlq(spark, sf):
    return admin.dlq_page(t.dlq(spark, sf), "failed", 5, 50)


@query(f"""WITH {t.MARKDOWN}, {t.SECTIONS}, {_MESSAGES}, {_ROWS}, placed AS (
  SELECT filename, coalesce(sum(length(row_text) + 1) OVER (PARTITION BY filename ORDER BY row_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 500 AS slot FROM rows)
SELECT 'confluence' AS source_type, count(*) AS n_chunks, count(DISTINCT filename) AS n_files FROM sections
UNION ALL SELECT 'slack', count(*), count(DISTINCT channel) FROM (SELECT DISTINCT channel, thread_no FROM threads)
UNION ALL SELECT 'excel', count(*), count(DISTINCT filename) FROM (SELECT DISTINCT filename, slot FROM placed)
UNION ALL SELECT 'pdf', count(*), count(DISTINCT source) FROM documents WHERE {t.sql_strip('text')} <> ''""")
def union_corpus(spark, sf):
    pages = t.read(spark, sf, "documents").select(
        F.concat("source", F.lit(".pdf")).alias("filename"), C("doc_id").alias("chunk_index"), "text"
    )
    chat = _messages(spark, sf).withColumn("filename", C("channel").cast("string"))
    everything = ingest.union_sources(
        ingest.from_markdown(t.markdown(spark, sf)), ingest.from_messages(chat),
        ingest.from_tables(_rows(spark, sf), id_bucket(C("row_no"))), ingest.from_pages(pages),
    )
    return everything.groupBy("source_type").agg(
        F.count("*").alias("n_chunks"), F.countDistinct("filename").alias("n_files")
    )


# --- cache --------------------------------------------------------------------------------------

_NEAREST = f"""{t.CACHE}, {t.ASKERS}, near AS (
  SELECT q.query_id, q.groups, c.entry_id, c.response_text, c.chunk_groups, c.allowed_groups,
         round(1 - round(list_cosine_similarity(q.dense, c.dense), 9), 9) AS distance
  FROM askers q, cache c),
top1 AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, entry_id) = 1)"""


@query(f"""WITH {_NEAREST}
SELECT query_id, entry_id, distance, response_text FROM top1
WHERE distance < 0.15 AND (len(allowed_groups) = 0 OR list_has_any(allowed_groups, list_append(groups, 'Public')))""")
def cache_lookup(spark, sf):
    return cache.lookup(t.askers(spark, sf), t.cache(spark, sf), mode="any")


@query(f"""WITH {_NEAREST}, hits AS (SELECT * FROM top1 WHERE distance < 0.15 AND len(list_filter(
  chunk_groups, lambda g: NOT list_has_any(g, list_append(groups, 'Public')))) = 0)
SELECT query_id, array_to_string(groups, ',') AS groups FROM askers
WHERE query_id NOT IN (SELECT query_id FROM hits)""")
def cache_miss_split(spark, sf):
    asked = t.askers(spark, sf)
    hits = cache.lookup(asked, t.cache(spark, sf))
    return cache.misses(asked, hits).select("query_id", t.joined("groups").alias("groups"))


@query(f"""WITH {t.RETRIEVED}, behind AS (
  SELECT query_id, list_sort(list_distinct(flatten(list(allowed_groups)))) AS allowed, list_sort(list_distinct(list(filename))) AS files,
    count(DISTINCT allowed_groups) AS n_lists FROM retrieved GROUP BY query_id)
SELECT 'answer ' || query_id AS response_text, array_to_string(allowed, ',') AS groups, array_to_string(files, ',') AS files, n_lists,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds((query_id % 240) * 60) AS created_at
FROM behind WHERE query_id % 3 <> 0 AND query_id % 240 > 180""")
def cache_write_back(spark, sf):
    found = t.retrieved(spark, sf)
    asked = found.select("query_id").distinct()
    answers = asked.select(
        "query_id", F.concat(F.lit("question "), "query_id").alias("query"), F.concat(F.lit("answer "), "query_id").alias("response"),
        F.when(C("query_id") % 3 != 0, access.strings("file")).otherwise(access.strings()).alias("citations"),
    )
    vectors = asked.select("query_id", F.array(C("query_id").cast("double")).alias("dense"))
    times = asked.select("query_id", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + C("query_id") % 240 * 60).alias("ts"))
    path = scratch_path(spark, "cache")
    entries = cache.new_entries(answers, found, vectors, times)
    for half in (0, 1, 1):  # the second batch is repeated
        cache.write_entries(entries.filter(F.pmod("entry_id", F.lit(2)) == half), path, half)
    return cache.read_entries(spark, path, datetime(2024, 1, 1, 4)).select(
        "response_text", t.joined("allowed_groups").alias("groups"), t.joined("files").alias("files"),
        F.size("chunk_groups").cast("bigint").alias("n_lists"), C("created_at").cast("timestamp_ntz").alias("created_at"),
    )


@query(f"""WITH {t.CACHE}, updated AS (SELECT DISTINCT source FROM documents WHERE doc_id % 200 = 7)
SELECT entry_id FROM cache WHERE entry_id NOT IN (
  SELECT entry_id FROM (SELECT entry_id, unnest(files) AS f FROM cache) JOIN updated ON source = f)""")
def cache_invalidate(spark, sf):
    updated = t.read(spark, sf, "documents").filter(C("doc_id") % 200 == 7).select(C("source").alias("filename"))
    return cache.invalidate(t.cache(spark, sf), updated).select("entry_id")


# --- dead letters -------------------------------------------------------------------------------

@query(f"""WITH {t.DLQ}
SELECT id, filepath, CASE WHEN retry_count = 4 THEN 'RETRIED' ELSE status END AS status,
       retry_count = 4 AS queued FROM dlq""")
def dlq_replay(spark, sf):
    dlq = t.dlq(spark, sf)
    queue, marked = admin.replay(dlq, dlq.filter(C("retry_count") == 4))
    queued = queue.select("filepath", F.lit(True).alias("queued"))
    return marked.join(queued, "filepath", "left").select(
        "id", "filepath", "status", F.coalesce("queued", F.lit(False)).alias("queued")
    )
