"""The driver's tables as corpus, questions, principals, logs: in Spark and in SQL.

Every definition covers its whole table. SQL pieces are common-table-expression bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.functions.access import strings

# whitespace class and trim characters for SQL text
WS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP = rf"regexp_replace(regexp_replace({{0}}, '\A{WS}+', ''), '{WS}+\z', '')"
WORDS = f"list_filter(string_split_regex({{0}}, '{WS}+'), lambda w: w <> '')"


def sql_strip(expr: str) -> str:
    return STRIP.replace("{0}", expr)


def sql_words(expr: str) -> str:
    return WORDS.replace("{0}", expr)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def joined(column) -> F.Column:
    """An array as text, for results that compare the same on every engine."""
    return F.array_join(column, ",")


def _case(column, mapping: dict, default):
    out = None
    for value, result in mapping.items():
        out = (F if out is None else out).when(column == F.lit(value), result)
    return out.otherwise(default)


def groups_of(number) -> F.Column:
    """Access groups by ``number % 5``."""
    return _case(
        number % 5,
        {0: strings("Public"), 1: strings("HR"), 2: strings("Management"), 3: strings("HR", "Management")},
        strings("Engineering"),
    )


GROUPS_SQL = (
    "CASE {0} % 5 WHEN 0 THEN ['Public'] WHEN 1 THEN ['HR'] WHEN 2 THEN ['Management'] "
    "WHEN 3 THEN ['HR', 'Management'] ELSE ['Engineering'] END"
)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: ``chunk_key, filename, source_type, text, allowed_groups``."""
    d = read(spark, sf, "documents")
    kind = _case(F.col("lang"), {"en": F.lit("confluence"), "fr": F.lit("slack"), "de": F.lit("excel")}, F.lit("pdf"))
    return d.select(
        F.col("doc_id").alias("chunk_key"), F.concat("source", F.lit(".md")).alias("filename"),
        kind.alias("source_type"), "text", groups_of(F.col("doc_id")).alias("allowed_groups"),
    )


CHUNKS = f"""chunks AS (
  SELECT doc_id AS chunk_key, source || '.md' AS filename,
         CASE lang WHEN 'en' THEN 'confluence' WHEN 'fr' THEN 'slack' WHEN 'de' THEN 'excel'
                   ELSE 'pdf' END AS source_type,
         text, {GROUPS_SQL.format('doc_id')} AS allowed_groups
  FROM documents)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions of users with different groups."""
    b = read(spark, sf, "benchmark")
    mine = _case(
        F.col("item_id") % 4,
        {0: strings(), 1: strings("HR"), 2: strings("Management")}, strings("Engineering", "HR"),
    )
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), mine.alias("groups"))


QUESTIONS = """questions AS (
  SELECT item_id AS query_id, text AS query,
         CASE item_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['HR'] WHEN 2 THEN ['Management']
                          ELSE ['Engineering', 'HR'] END AS groups
  FROM benchmark)"""


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dressed as Markdown: sentence ends become headings, some with access lines."""
    d = read(spark, sf, "documents")
    restricted = F.concat(F.lit("\n## Part\n> **Allowed groups:** HR, "), "lang", F.lit(" , ,Legal\n"))
    plain = F.lit("\n# Next\n")
    line = F.when(F.col("doc_id") % 2 == 0, restricted).otherwise(plain)
    body = F.replace(F.col("text"), F.lit(".\n"), line)
    return d.select("doc_id", F.concat("source", F.lit(".md")).alias("filename"),
                    F.concat(F.lit("# "), "source", F.lit("\n\n"), body).alias("text"))


MARKDOWN = r"""markdown AS (
  SELECT doc_id, source || '.md' AS filename,
         '# ' || source || chr(10) || chr(10) || replace(text, '.' || chr(10),
           CASE WHEN doc_id % 2 = 0
                THEN chr(10) || '## Part' || chr(10) || '> **Allowed groups:** HR, ' || lang || ' , ,Legal' || chr(10)
                ELSE chr(10) || '# Next' || chr(10) END) AS text
  FROM documents)"""

# sections: mark every line start, mark headings, cut there, drop the marks
SECTIONS = rf"""pieces AS (
  SELECT doc_id, filename, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, filename, string_split(regexp_replace(
          chr(2) || replace(text, chr(10), chr(10) || chr(2)), '\x02(#+{WS})', chr(1) || '\1', 'g'),
          chr(1)) AS p FROM markdown)),
sections AS (
  SELECT doc_id, filename, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, section
  FROM (SELECT doc_id, filename, pos, {sql_strip("replace(piece, chr(2), '')")} AS section FROM pieces)
  WHERE section <> '')"""


def principals(spark: SparkSession, sf: str) -> DataFrame:
    """Every user seen in the events, with groups by number; each tenth is an admin."""
    users = read(spark, sf, "events").select("user_id").distinct()
    mine = F.when(F.col("user_id") % 10 == 0, F.array_union(groups_of(F.col("user_id")), strings("admin"))).otherwise(
        groups_of(F.col("user_id"))
    )
    return users.select("user_id", F.concat(F.lit("user"), F.col("user_id")).alias("username"), mine.alias("groups"))


PRINCIPALS = f"""principals AS (
  SELECT user_id, 'user' || user_id AS username,
         CASE WHEN user_id % 10 = 0 THEN list_append({GROUPS_SQL.format('user_id')}, 'admin')
              ELSE {GROUPS_SQL.format('user_id')} END AS groups
  FROM (SELECT DISTINCT user_id FROM events))"""


def audit_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as audit rows; ``props.k`` names the first of three cited chunks."""
    e = read(spark, sf, "events")
    first = F.get_json_object("props", "$.k").cast("bigint")
    cited = F.when(
        F.col("event_type") == "view", F.array().cast("array<bigint>")
    ).otherwise(F.sequence(first, first + 2))
    return e.select(
        F.col("event_id").alias("id"), "user_id",
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string"), "props").alias("query"),
        F.repeat(F.concat("event_type", F.lit(" answer ")), (F.col("event_id") % 12).cast("int")).alias("response"),
        F.when(F.col("event_type") == "view", "cache").otherwise("search").alias("served_from"),
        cited.alias("chunk_ids"), "ts",
    )


AUDIT = """audit_logs AS (
  SELECT event_id AS id, user_id, event_type || ' ' || event_id || ' ' || props AS query,
         repeat(event_type || ' answer ', (event_id % 12)::INT) AS response,
         CASE WHEN event_type = 'view' THEN 'cache' ELSE 'search' END AS served_from,
         CASE WHEN event_type = 'view' THEN []::BIGINT[]
              ELSE range(k, k + 3) END AS chunk_ids, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def failures(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as failed ingests: ``filepath, source_type, error_message, attempt, ts``."""
    e = read(spark, sf, "events").filter(F.col("event_type") == "error")
    kind = _case(F.col("user_id") % 4, {0: F.lit("confluence"), 1: F.lit("slack"), 2: F.lit("excel")}, F.lit("pdf"))
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("minio://documents/in/"), F.col("event_id"), F.lit(".bin")).alias("filepath"),
        kind.alias("source_type"), F.concat(F.lit("Corrupted "), "props").alias("error_message"),
        (F.col("event_id") % 5).alias("attempt"), "ts",
    )


FAILURES = """failures AS (
  SELECT event_id AS id, 'minio://documents/in/' || event_id || '.bin' AS filepath,
         CASE user_id % 4 WHEN 0 THEN 'confluence' WHEN 1 THEN 'slack' WHEN 2 THEN 'excel' ELSE 'pdf' END AS source_type,
         'Corrupted ' || props AS error_message, event_id % 5 AS attempt, ts
  FROM events WHERE event_type = 'error')"""


def dlq(spark: SparkSession, sf: str) -> DataFrame:
    """Used-up failures, in all three states."""
    f = failures(spark, sf).filter(F.col("attempt") >= 3)
    state = _case(F.col("id") % 3, {0: F.lit("FAILED"), 1: F.lit("RETRIED")}, F.lit("RESOLVED"))
    return f.select(
        "id", "filepath", "source_type", "error_message", F.col("attempt").cast("int").alias("retry_count"),
        state.alias("status"), F.col("ts").alias("created_at"),
    )


DLQ = FAILURES + """, dlq AS (
  SELECT id, filepath, source_type, error_message, attempt::INT AS retry_count,
         CASE id % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RETRIED' ELSE 'RESOLVED' END AS status,
         ts AS created_at
  FROM failures WHERE attempt >= 3)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as model answers citing their own and other sources, valid and not."""
    d = read(spark, sf, "documents")
    number = F.col("doc_id")
    extra = F.concat(
        F.lit(" [Source: "), "source", F.lit(".md] and [Source:\tsrc"), (number % 20).cast("string"),
        F.lit(".md ] \n [Source: "), "lang", F.lit(".md]"),
        F.when(number % 3 == 0, F.lit("[Source: made up (1).pdf]")).otherwise(F.lit("")),
    )
    cited = F.when(number % 7 == 0, F.lit("")).otherwise(extra)
    files = F.array(F.concat("source", F.lit(".md")), F.lit("en.md"), F.concat(F.lit("src"), (number % 11).cast("string"), F.lit(".md")))
    return d.select(number.alias("query_id"), F.concat("text", cited).alias("answer"), F.array_distinct(files).alias("files"))


ANSWERS = r"""answers AS (
  SELECT doc_id AS query_id, text || CASE WHEN doc_id % 7 = 0 THEN '' ELSE
           ' [Source: ' || source || '.md] and [Source:' || chr(9) || 'src' || (doc_id % 20) || '.md ] ' || chr(10)
           || ' [Source: ' || lang || '.md]'
           || CASE WHEN doc_id % 3 = 0 THEN '[Source: made up (1).pdf]' ELSE '' END END AS answer,
         list_distinct([source || '.md', 'en.md', 'src' || (doc_id % 11) || '.md']) AS files
  FROM documents)"""

_CITATION = rf"\[Source:{WS}*([^\]]+)\]"
CITED = rf"""cited AS (
  SELECT query_id, answer, files,
         list_transform(regexp_extract_all(answer, '{_CITATION}', 1), lambda c: {sql_strip('c')}) AS names
  FROM answers)"""


def found(spark: SparkSession, sf: str) -> DataFrame:
    """Audit rows' cited chunks as search results of one question per event, without the chunks."""
    logs = audit_logs(spark, sf).filter(F.col("served_from") == "search")
    cited = logs.select(F.col("id").alias("query_id"), F.posexplode("chunk_ids").alias("pos", "chunk_key"))
    return cited.select(
        "query_id", (F.col("pos") + 1).alias("rank"), "chunk_key",
        (2.5 - 0.25 * (F.col("query_id") % 30) - F.col("pos")).cast("double").alias("rerank_score"),
    )


def retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """Search results with their chunks."""
    return found(spark, sf).join(chunks(spark, sf), "chunk_key")


RETRIEVED = AUDIT + ", " + CHUNKS + """, retrieved AS (
  SELECT c.*, r.query_id, r.rank, r.rerank_score FROM (
    SELECT id AS query_id, unnest(chunk_ids) AS chunk_key, generate_subscripts(chunk_ids, 1) AS rank,
           (2.5 - 0.25 * (id % 30) - (generate_subscripts(chunk_ids, 1) - 1))::DOUBLE AS rerank_score
    FROM audit_logs WHERE served_from = 'search') r JOIN chunks c USING (chunk_key))"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as served requests with latency, tokens, cache and failure flags."""
    e = read(spark, sf, "events")
    return e.select(
        "ts", F.col("user_id").alias("caller"), "event_id",
        F.round(F.col("value") * 100, 3).alias("latency_ms"),
        (F.col("event_type") == "view").alias("cached"), (F.col("event_type") == "error").alias("failed"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        # in millionths: what is served from the cache costs nothing
        F.when(F.col("event_type") == "view", 0).otherwise(
            F.get_json_object("props", "$.k").cast("bigint") * 3).cast("bigint").alias("cost"),
    )


REQUESTS = """requests AS (
  SELECT ts, user_id AS caller, event_id, round(value * 100, 3) AS latency_ms,
         event_type = 'view' AS cached, event_type = 'error' AS failed,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
         CASE WHEN event_type = 'view' THEN 0 ELSE 3 * CAST(json_extract_string(props, '$.k') AS BIGINT) END AS cost FROM events)"""


def cache(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as cached answers; groups behind each answer by number."""
    e = read(spark, sf, "embeddings")
    behind = F.when(F.col("vec_id") % 6 == 0, F.array().cast("array<array<string>>")).otherwise(
        F.array(groups_of(F.col("vec_id")), groups_of(F.floor(F.col("vec_id") / 5)))
    )
    return e.select(
        F.col("vec_id").alias("entry_id"), F.concat(F.lit("answer "), F.col("vec_id")).alias("response_text"),
        behind.alias("chunk_groups"), F.array_distinct(F.flatten(behind)).alias("allowed_groups"),
        F.col("embedding").cast("array<double>").alias("dense"),
        F.array_distinct(F.array(F.concat(F.lit("src"), F.col("vec_id") % 20), F.concat(F.lit("src"), F.col("label")))).alias("files"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("vec_id") * 15)).alias("created_at"),
    )


CACHE = f"""cache AS (
  SELECT entry_id, 'answer ' || entry_id AS response_text, chunk_groups,
         list_distinct(flatten(chunk_groups)) AS allowed_groups, dense, files, created_at
  FROM (SELECT vec_id AS entry_id, embedding::DOUBLE[] AS dense,
               CASE WHEN vec_id % 6 = 0 THEN []::VARCHAR[][]
                    ELSE [{GROUPS_SQL.format('vec_id')}, {GROUPS_SQL.format('(vec_id // 5)')}] END AS chunk_groups,
               list_distinct(['src' || (vec_id % 20), 'src' || label]) AS files,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(vec_id * 15) AS created_at
        FROM embeddings))"""


def askers(spark: SparkSession, sf: str) -> DataFrame:
    """One question per label: its first vector, pulled towards its last by the label number."""
    e = read(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    ends = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("a"), F.max_by("v", "vec_id").alias("b"))
    mixed = F.zip_with("a", "b", lambda x, y: x + y * (F.col("label") % 10 * F.lit(0.08)))
    return ends.select(
        F.col("label").cast("bigint").alias("query_id"), groups_of(F.col("label")).alias("groups"),
        mixed.alias("dense"),
    )


ASKERS = f"""askers AS (
  SELECT label::BIGINT AS query_id, {GROUPS_SQL.format('label')} AS groups,
         list_transform(range(1, len(a) + 1), lambda i: a[i] + b[i] * (label % 10 * 0.08::DOUBLE)) AS dense
  FROM (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS a, arg_max(embedding::DOUBLE[], vec_id) AS b
        FROM embeddings GROUP BY label))"""
