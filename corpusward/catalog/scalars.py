"""Scalar functions and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.catalog import tables as t
from corpusward.functions import access, guard, pii, text
from corpusward.operators import admin, cache, chunking, versions
from corpusward.plans import ingest
from corpusward.sources import readers

C = F.col
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


_NAMES = """names AS (
  SELECT doc_id, 'in/' || lang || '/' || source ||
         CASE doc_id % 7 WHEN 0 THEN '.MD' WHEN 1 THEN '.json' WHEN 2 THEN '.v2.csv' WHEN 3 THEN '.XLSX'
                         WHEN 4 THEN '.pdf' WHEN 5 THEN '.exe' ELSE '' END AS path FROM documents)"""


def _names(spark, sf):
    ends = {0: ".MD", 1: ".json", 2: ".v2.csv", 3: ".XLSX", 4: ".pdf", 5: ".exe"}
    end = t._case(C("doc_id") % 7, {k: F.lit(v) for k, v in ends.items()}, F.lit(""))
    return t.read(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("in/"), "lang", F.lit("/"), "source", end).alias("path")
    )


@query(f"""WITH {_NAMES}, typed AS (
  SELECT doc_id, path, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1))
    WHEN '.md' THEN 'confluence' WHEN '.json' THEN 'slack' WHEN '.csv' THEN 'excel'
    WHEN '.xlsx' THEN 'excel' WHEN '.pdf' THEN 'pdf' END AS source_type FROM names)
SELECT doc_id, path, coalesce(source_type, 'rejected') AS outcome FROM typed""")
def route_by_extension(spark, sf):
    good, bad = readers.routed(_names(spark, sf))
    return good.unionByName(bad.withColumn("source_type", F.lit("rejected"))).select(
        "doc_id", "path", C("source_type").alias("outcome")
    )


@query("""SELECT doc_id, 's3a://' || lang || '/' || source || '/v1/' || doc_id || '.txt' AS path,
       lang AS bucket, source || '/v1/' || doc_id || '.txt' AS object FROM documents""")
def read_object_uri(spark, sf):
    uri = F.concat(F.lit("minio://"), "lang", F.lit("/"), "source", F.lit("/v1/"), "doc_id", F.lit(".txt"))
    d = t.read(spark, sf, "documents").select("doc_id", uri.alias("uri"))
    return d.select(
        "doc_id", access.object_uri(C("uri")).alias("path"), access.object_bucket(C("uri")).alias("bucket"),
        access.object_name(C("uri")).alias("object"),
    )


@query(f"""WITH {t.MARKDOWN}, {t.SECTIONS} SELECT doc_id, chunk_index, section FROM sections""")
def split_sections(spark, sf):
    md = t.markdown(spark, sf)
    return chunking.markdown_chunks(md).select(
        "doc_id", C("chunk_index").cast("bigint").alias("chunk_index"), C("text").alias("section")
    )


_ACL = rf"(?i)>{t.WS}*\*\*Allowed Groups:\*\*{t.WS}*([^\n]+)"


@query(rf"""WITH {t.MARKDOWN}, {t.SECTIONS}
SELECT doc_id, chunk_index,
       CASE WHEN line = '' THEN 'Public' ELSE array_to_string(list_filter(
         list_transform(string_split(line, ','), lambda g: {t.sql_strip('g')}), lambda g: g <> ''), ',') END AS groups
FROM (SELECT *, regexp_extract(section, '{_ACL}', 1) AS line FROM sections)""")
def extract_section_acl(spark, sf):
    return chunking.markdown_chunks(t.markdown(spark, sf)).select(
        "doc_id", C("chunk_index").cast("bigint").alias("chunk_index"), t.joined("allowed_groups").alias("groups")
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'HR,Management,Finance' ELSE 'Public' END AS groups
FROM documents""")
def acl_from_filename(spark, sf):
    tag = t._case(C("doc_id") % 4, {0: F.lit("Salary"), 1: F.lit("PAYROLL"), 2: F.lit("financials")}, F.lit("plan"))
    path = F.concat(F.lit("/payroll/"), "source", F.lit("_"), tag, F.lit(".csv"))
    return t.read(spark, sf, "documents").select("doc_id", t.joined(access.filename_groups(path)).alias("groups"))


# the SQL twin uses \b where the Spark patterns spell out ASCII word edges
_CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
_SSN = r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b"
_PHONE = (
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[. -])[0-9]{3}[. -][0-9]{4}\b"
    r"|\+[0-9](?:[ .-]?[0-9]){7,14}\b"
)
_ANNOUNCED = (
    r"(?i)(^|[^\p{L}\p{M}\p{N}_])((?:tel|telephone|phone|mobile|cell|call|fax|telefon|téléphone|teléfono)[.:]{0,2} ?)[0-9]{10}\b"
)
_EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}"


def _redacted_sql(source: str) -> str:
    digits = "regexp_replace(c, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
        CASE WHEN (length({digits}) - i) % 2 = 1
             THEN substr({digits}, i, 1)::INT * 2 - CASE WHEN substr({digits}, i, 1)::INT > 4 THEN 9 ELSE 0 END
             ELSE substr({digits}, i, 1)::INT END)) % 10 = 0"""
    cards = f"""array_to_string(list_transform(list_zip(
        string_split_regex(text, '{_CARD}'),
        list_append(list_transform(regexp_extract_all(text, '{_CARD}'), lambda c:
          CASE WHEN {luhn} THEN '<CREDIT_CARD>' ELSE c END), '')), lambda p: p[1] || p[2]), '')"""
    return rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({cards},
      '{_SSN}', '<US_SSN>', 'g'), '{_PHONE}', '<PHONE_NUMBER>', 'g'),
      '{_ANNOUNCED}', '\1\2<PHONE_NUMBER>', 'g'), '{_EMAIL}', '<EMAIL_ADDRESS>', 'g')""".replace("{source}", source)


@query(f"SELECT doc_id, {_redacted_sql('documents')} AS redacted FROM documents")
def redact_pii(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", pii.redact(C("text")).alias("redacted"))


@query(r"""WITH RECURSIVE dictionary AS (
  SELECT DISTINCT regexp_extract(text, '[\p{L}\p{N}_]+ [\p{L}\p{N}_]+|[\p{L}\p{N}_]+', 0) AS name FROM benchmark
  WHERE regexp_extract(text, '[\p{L}\p{N}_]+', 0) <> ''),
firsts AS (SELECT name, string_split(name, ' ')[1] AS word FROM dictionary),
found AS (
  SELECT doc_id, list(DISTINCT name ORDER BY length(name) DESC, name DESC) AS names FROM firsts JOIN (
    SELECT doc_id, unnest(string_split_regex(text, '[^\p{L}\p{M}\p{N}_]+')) AS word FROM documents) USING (word)
  GROUP BY doc_id),
hits AS (SELECT doc_id, coalesce(names, []) AS names, text FROM documents LEFT JOIN found USING (doc_id)),
masked AS (
  SELECT doc_id, names, text, 0 AS done FROM hits
  UNION ALL
  SELECT doc_id, names, regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{M}\p{N}_])' || names[done + 1] || '($|[^\p{L}\p{M}\p{N}_])', '\1<PERSON>\2', 'g'),
    '(^|[^\p{L}\p{M}\p{N}_])' || names[done + 1] || '($|[^\p{L}\p{M}\p{N}_])', '\1<PERSON>\2', 'g'), done + 1
  FROM masked WHERE done < len(names))
SELECT doc_id, text AS redacted FROM masked WHERE done = len(names)""")
def redact_person_names(spark, sf):
    names = t.read(spark, sf, "benchmark").select(
        F.regexp_extract("text", r"[\p{L}\p{N}_]+ [\p{L}\p{N}_]+|[\p{L}\p{N}_]+", 0).alias("name")
    ).filter("name <> ''")
    docs = t.read(spark, sf, "documents").select("doc_id", "text")
    return ingest.redacted_names(docs, names, "doc_id").select("doc_id", C("text").alias("redacted"))


@query("""SELECT doc_id, '[Slack Conversation ' || doc_id || ']' || chr(10) || text AS chat,
  'Table: ' || source || '.csv - Chunk ' || doc_id || chr(10) || chr(10) || text AS sheet,
  'Document: ' || source || '.pdf - Part ' || (doc_id + 1) || chr(10) || chr(10) || text AS page FROM documents""")
def prefix_chunk_header(spark, sf):
    d = t.read(spark, sf, "documents")
    return d.select(
        "doc_id", text.chat_header(C("text"), C("doc_id")).alias("chat"),
        text.table_header(C("text"), F.concat("source", F.lit(".csv")), C("doc_id")).alias("sheet"),
        text.page_header(C("text"), F.concat("source", F.lit(".pdf")), C("doc_id")).alias("page"),
    )


@query(f"""WITH w AS (SELECT doc_id, {t.sql_words('text')} AS words FROM documents)
SELECT doc_id, unnest(range(0, greatest(len(words) - 65, 0) + 1, 448)) // 448 AS chunk_index,
       array_to_string(list_slice(words, unnest(range(0, greatest(len(words) - 65, 0) + 1, 448)) + 1,
         unnest(range(0, greatest(len(words) - 65, 0) + 1, 448)) + 512), ' ') AS text
FROM w WHERE len(words) > 0""")
def chunk_fixed_overlap(spark, sf):
    d = t.read(spark, sf, "documents").select("doc_id", "text")
    return chunking.overlap_chunks(d).select("doc_id", C("chunk_index").cast("bigint").alias("chunk_index"), "text")


@query(f"""SELECT doc_id, word FROM (
  SELECT doc_id, unnest(list_distinct({t.sql_words('text')})) AS word FROM documents)""")
def tokenize_words(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", F.explode(text.word_set(C("text"))).alias("word"))


TOKEN_SQL = "((" + " + ".join(
    f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT * {1 << (7 - i)}" for i in range(8)
) + ") % 2147483647)::INT"


@query(f"""WITH words AS (SELECT DISTINCT unnest({t.sql_words('text')}) AS word FROM documents)
SELECT word, {TOKEN_SQL} AS token FROM (SELECT word, sha256(word) AS h FROM words)""")
def hash_sparse_token(spark, sf):
    words = t.read(spark, sf, "documents").select(F.explode(text.words(C("text"))).alias("word")).distinct()
    return words.select("word", text.token_id(C("word")).alias("token"))


@query("""SELECT b.item_id, b.text || chr(10) || coalesce(d.text, '') AS expanded, b.text AS plain
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id""")
def expand_query_text(spark, sf):
    hyde = t.read(spark, sf, "documents").select(C("doc_id").alias("item_id"), C("text").alias("hyde"))
    b = t.read(spark, sf, "benchmark").join(hyde, "item_id", "left")
    return b.select(
        "item_id", text.expand_query(C("text"), F.coalesce("hyde", F.lit(""))).alias("expanded"), C("text").alias("plain")
    )


_GATE = f"""CASE WHEN n_chunks = 0 THEN '{guard.REFUSE_NOTHING_FOUND}'
  WHEN coalesce(top_score, 0.0) < -3.0 THEN '{guard.REFUSE_LOW_CONFIDENCE.replace("'", "''")}' END"""


@query(f"""WITH {t.RETRIEVED}, best AS (
  SELECT query_id, count(*) AS n_chunks, arg_min(rerank_score, rank) AS top_score FROM retrieved GROUP BY query_id)
SELECT id AS query_id, coalesce({_GATE.replace('n_chunks', 'coalesce(n_chunks, 0)')}, 'pass') AS outcome
FROM audit_logs LEFT JOIN best ON best.query_id = id""")
def confidence_gate(spark, sf):
    best = t.retrieved(spark, sf).groupBy("query_id").agg(
        F.count("*").alias("n_chunks"), F.min_by("rerank_score", "rank").alias("top_score")
    )
    asked = t.audit_logs(spark, sf).select(C("id").alias("query_id")).join(best, "query_id", "left")
    return asked.select("query_id", F.coalesce(guard.gate(C("n_chunks"), C("top_score")), F.lit("pass")).alias("outcome"))


@query(f"""WITH {t.ANSWERS}, {t.CITED}
SELECT query_id, array_to_string(names, '|') AS names, len(names) AS n FROM cited""")
def extract_citations(spark, sf):
    names = guard.citations(C("answer"))
    return t.answers(spark, sf).select(
        "query_id", F.array_join(names, "|").alias("names"), F.size(names).cast("bigint").alias("n")
    )


@query(f"""WITH {t.ANSWERS}, {t.CITED}
SELECT query_id,
  array_to_string(list_sort(list_distinct(list_filter(names, lambda n: list_contains(files, n)))), '|') AS valid,
  array_to_string(list_sort(list_distinct(list_filter(names, lambda n: NOT list_contains(files, n)))), '|') AS invalid
FROM cited""")
def validate_citations(spark, sf):
    a = t.answers(spark, sf)
    return a.select(
        "query_id",
        F.array_join(F.array_sort(guard.valid_citations(C("answer"), C("files"))), "|").alias("valid"),
        F.array_join(F.array_sort(guard.invalid_citations(C("answer"), C("files"))), "|").alias("invalid"),
    )


@query(rf"""WITH RECURSIVE {t.ANSWERS}, {t.CITED}, bad AS (
  SELECT query_id, answer, list_distinct(list_filter(names, lambda n: NOT list_contains(files, n))) AS bad FROM cited),
step AS (
  SELECT query_id, answer, bad, 0 AS done FROM bad
  UNION ALL
  SELECT query_id, regexp_replace(answer, '\[Source:{t.WS}*' || regexp_escape(bad[done + 1]) || '{t.WS}*\]', '', 'g'),
         bad, done + 1 FROM step WHERE done < len(bad))
SELECT query_id, trim(regexp_replace(answer, '{t.WS}+', ' ', 'g'), ' ') AS answer FROM step WHERE done = len(bad)""")
def strip_invalid_citations(spark, sf):
    return t.answers(spark, sf).select("query_id", guard.strip_invalid(C("answer"), C("files")).alias("answer"))


@query(f"""WITH {t.ANSWERS}, {t.CITED}
SELECT query_id, CASE WHEN len(names) = 0 THEN false
  ELSE len(list_filter(names, lambda n: NOT list_contains(files, n))) / len(names) > 0.5 END AS review FROM cited""")
def flag_low_citation_quality(spark, sf):
    return t.answers(spark, sf).select("query_id", guard.needs_review(C("answer"), C("files")).alias("review"))


_CLAIMS_SQL = """claims AS (
  SELECT event_id, user_id, event_type,
         CASE WHEN event_id % 4 = 0 THEN 'u' || user_id ELSE '' END AS preferred,
         CASE WHEN event_id % 3 = 0 THEN 'm' || user_id || '@x.org' END AS email,
         CASE WHEN event_id % 5 = 0 THEN 's' || user_id END AS sub,
         CASE WHEN event_id % 2 = 0 THEN [event_type, 'HR'] END AS groups,
         CASE WHEN event_id % 7 = 0 THEN ['HR', 'ops'] END AS realm,
         CASE WHEN event_id % 11 = 0 THEN ['Public', 'lead'] END AS roles FROM events)"""


def _claims(spark, sf):
    n = C("event_id")

    def some(every, value):
        return F.when(n % every == 0, value)

    parts = F.struct(
        F.coalesce(some(4, F.concat(F.lit("u"), "user_id")), F.lit("")).alias("preferred_username"),
        some(3, F.concat(F.lit("m"), "user_id", F.lit("@x.org"))).alias("email"),
        some(5, F.concat(F.lit("s"), "user_id")).alias("sub"),
        some(2, F.array("event_type", F.lit("HR"))).alias("groups"),
        some(7, F.struct(F.array(F.lit("HR"), F.lit("ops")).alias("roles"))).alias("realm_access"),
        some(11, F.array(F.lit("Public"), F.lit("lead"))).alias("roles"),
    )
    return t.read(spark, sf, "events").select("event_id", F.to_json(parts).alias("claims"))


@query(f"""WITH {_CLAIMS_SQL}
SELECT event_id, coalesce(nullif(preferred, ''), email, sub, 'oidc_user') AS username,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(groups, []), coalesce(realm, []), coalesce(roles, []), ['Public']))), ',') AS groups
FROM claims""")
def normalize_principal(spark, sf):
    p = _claims(spark, sf).withColumn("p", access.principal(C("claims")))
    return p.select("event_id", "p.username", t.joined(F.array_sort("p.groups")).alias("groups"))


@query("SELECT doc_id, length(text) BETWEEN 1 AND 2000 AS ok FROM documents")
def validate_query_length(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", text.query_length_ok(C("text")).alias("ok"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview
FROM documents""")
def preview_response(spark, sf):
    return t.read(spark, sf, "documents").select("doc_id", text.preview(C("text")).alias("preview"))


VERSIONS_SQL = """versions AS (
  SELECT doc_id, lang AS source_type, source || '.md' AS filename,
         row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS version,
         lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) IS NULL AS is_active, text FROM documents)"""


def versioned(spark, sf):
    d = t.read(spark, sf, "documents").select(
        "doc_id", C("lang").alias("source_type"), F.concat("source", F.lit(".md")).alias("filename"), "text"
    )
    from corpusward.operators.running import id_bucket

    return versions.number_versions(d, ["doc_id"], id_bucket(C("doc_id")))


@query(f"""WITH {VERSIONS_SQL}
SELECT doc_id, '/' || source_type || '/' || sha256(source_type || '/' || filename) || '/v' || version || '/' || filename AS path
FROM versions""")
def archive_path(spark, sf):
    doc = text.source_id(C("source_type"), C("filename"))
    return versioned(spark, sf).select(
        "doc_id", text.archive_path(C("source_type"), doc, C("version"), C("filename")).alias("path")
    )


@query("SELECT doc_id, sha256(lang || '/' || source || '.md') AS source_id FROM documents")
def source_id_hash(spark, sf):
    d = t.read(spark, sf, "documents")
    return d.select("doc_id", text.source_id(C("lang"), F.concat("source", F.lit(".md"))).alias("source_id"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ''
  WHEN event_id % 9 = 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S')
  WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS stamp FROM events""")
def iso_timestamps(spark, sf):
    n = C("event_id") % 9
    ts = F.when(n == 1, F.date_trunc("second", "ts")).when(n > 1, C("ts"))
    return t.read(spark, sf, "events").select("event_id", text.iso_timestamp(ts).alias("stamp"))


@query(f"""WITH {t.CHUNKS}
SELECT chunk_key, array_to_string(allowed_groups, ',') AS groups FROM chunks
WHERE list_has_any(allowed_groups, ['HR', 'Public'])""")
def acl_filter(spark, sf):
    c = t.chunks(spark, sf)
    return c.filter(access.may_see(C("allowed_groups"), access.strings("HR"))).select(
        "chunk_key", t.joined("allowed_groups").alias("groups")
    )


@query(f"WITH {VERSIONS_SQL} SELECT doc_id, source_type, filename, version FROM versions WHERE is_active")
def active_version_filter(spark, sf):
    return versions.active(versioned(spark, sf)).select("doc_id", "source_type", "filename", "version")


@query(f"""SELECT doc_id, pos AS chunk_index, line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
WHERE {t.sql_strip('line')} <> ''""")
def drop_empty_chunks(spark, sf):
    lines = t.read(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")
    )
    return chunking.page_chunks(lines, "line").select("doc_id", C("chunk_index").cast("bigint").alias("chunk_index"), "line")


_AS_OF = "(SELECT max(created_at) FROM cache)"


@query(f"""WITH {t.CACHE} SELECT entry_id, created_at FROM cache
WHERE created_at > {_AS_OF} - INTERVAL 1 HOUR""")
def cache_ttl_filter(spark, sf):
    entries = t.cache(spark, sf)
    now = entries.select(F.max("created_at")).scalar()
    return cache.live(entries, now).select("entry_id", "created_at")


@query(f"""WITH {t.CACHE}
SELECT entry_id, len(allowed_groups) = 0 OR list_has_any(allowed_groups, ['HR', 'Public']) AS by_any,
  len(list_filter(chunk_groups, lambda g: NOT list_has_any(g, ['HR', 'Public']))) = 0 AS by_all FROM cache""")
def cache_acl_filter(spark, sf):
    hr = access.strings("HR")
    return t.cache(spark, sf).select(
        "entry_id", access.may_reuse(C("allowed_groups"), hr).alias("by_any"),
        access.may_reuse_all(C("chunk_groups"), hr).alias("by_all"),
    )


@query(f"WITH {t.DLQ} SELECT id, filepath, status FROM dlq WHERE status = 'FAILED'")
def dlq_status_filter(spark, sf):
    return admin.with_status(t.dlq(spark, sf), "failed").select("id", "filepath", "status")


@query(f"""WITH {t.AUDIT}, {t.PRINCIPALS}
SELECT id, a.user_id FROM audit_logs a JOIN principals p USING (user_id) WHERE list_contains(groups, 'admin')""")
def admin_rbac_filter(spark, sf):
    return admin.admin_rows(t.audit_logs(spark, sf), t.principals(spark, sf)).select("id", "user_id")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_append([lang, source, 'HR'], 'Public'))), ',') AS groups FROM documents")
def effective_groups(spark, sf):
    mine = F.array("lang", "source", F.lit("HR"))
    return t.read(spark, sf, "documents").select(
        "doc_id", t.joined(F.array_sort(access.effective_groups(mine))).alias("groups")
    )


@query(f"""WITH {t.ANSWERS}, {t.CITED}, names AS (SELECT query_id, unnest(names) AS name FROM cited),
files AS (SELECT query_id, unnest(files) AS name FROM answers)
SELECT query_id, name, 'valid' AS verdict FROM (SELECT * FROM names INTERSECT SELECT * FROM files)
UNION ALL SELECT query_id, name, 'invalid' FROM (SELECT * FROM names EXCEPT SELECT * FROM files)""")
def citation_intersect_except(spark, sf):
    a = t.answers(spark, sf)
    valid = a.select("query_id", F.explode(guard.valid_citations(C("answer"), C("files"))).alias("name"))
    invalid = a.select("query_id", F.explode(guard.invalid_citations(C("answer"), C("files"))).alias("name"))
    return valid.withColumn("verdict", F.lit("valid")).unionByName(invalid.withColumn("verdict", F.lit("invalid")))
