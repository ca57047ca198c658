"""The registered queries of this subpackage with their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusward.llm import (
    chat, exact, leaks, licenses, mixing, negatives, phrases, pieces, quality, simhash, tokens,
    toxicity, warc,
)
from corpusward.session import scratch_path

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_BLANK_RUN = r"[^\x20\x09-\x0D]"


@query(rf"""WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '{_BLANK_RUN}+') AS words FROM documents),
spots AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
windows AS (SELECT doc_id, i, array_to_string(words[i:i+4], ' ') AS win FROM spots),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(body) - length(replace(body, '!', '')))::BIGINT AS n_exclaims,
         list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '{_BLANK_RUN}')) AS lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
l AS (SELECT *, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM m),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
  + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
  + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
  + 64 * (2 * n_exclaims > n_words)::BIGINT AS failed FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed = 0 AS kept, failed
FROM f""")
def op9_quality_rules(spark, sf):
    rows = quality.ledger(table(spark, sf, "documents"))
    base, current = quality.POLICIES[0], quality.CURRENT
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(F.col("failed"), base)).alias("base_failed"),
        quality.passes(F.col("failed"), current).alias("kept"), "failed",
    )


@query()
def op7_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents) WINDOW same AS (PARTITION BY body)""")
def op3_exact_dedup(spark, sf):
    return exact.duplicates(table(spark, sf, "documents"))


@query(rf"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_BLANK_RUN}+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
          WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, row_number() OVER f AS k,
        sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS left_over,
        sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_w
      FROM s WINDOW f AS (ORDER BY 3 * source_size / w, source NULLS LAST),
        b AS (ORDER BY 3 * source_size / w, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT * FROM o WHERE left_over * w <= cap * open_w ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.k < f.k THEN o.cap::DOUBLE
        ELSE (o.w * f.left_over)::DOUBLE / f.open_w::DOUBLE END AS target FROM o, first f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
r AS (SELECT *, greatest(target - whole * source_size, 0) AS rest FROM p),
u AS (SELECT doc_id, size, r.*,
        (('0x' || substr(md5('10:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u,
        CASE WHEN r.source_size > 0 THEN rest / r.source_size ELSE 0 END AS p
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
q AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p <= 0 THEN 'inf'::DOUBLE
        ELSE (u / (1 - u)) / (p / (1 - p)) END AS rank FROM u),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
n AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE
        whole + CASE WHEN p > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END END::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM n""")
def op10_mix_sources(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query()
def op4_sentencepiece(spark, sf):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(table(spark, sf, "documents"), model, remembered=800_000)


@query()
def op1_token_binary(spark, sf):
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(
        table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    rows = tokens.checksums(tokens.read_tokens(spark, path))
    return tokens.with_start(rows, tokens.shard_starts(spark, path)).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )


@query("""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000
  THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k""")
def op2_warc(spark, sf):
    root = scratch_path(spark, "warc")
    index = warc.write_archives(table(spark, sf, "pages"), root)
    return warc.read_records(index, root, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query()
def op8_chat_format(spark, sf):
    return chat.repair(table(spark, sf, "conversations"))


@query()
def op5_license_scan(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


# What the labels say, rarest last: poor texts, hostile ones, and those that are both.
TOXIC_CHAIN = {"poor": "quality = 0", "toxic_poor": "quality = 0 AND toxic = 1", "toxic": "toxic = 1"}


@query()
def op6_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"), TOXIC_CHAIN)
    return toxicity.flagged(toxicity.score(docs, model))


@query("""WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.row, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, id) AS nth FROM pairs WHERE same QUALIFY nth <= 5),
mined AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.row, p.nth ORDER BY n.score DESC, n.id)::INT AS rank
  FROM positives p JOIN pairs n ON n.row = p.row AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 10""")
def op11_hard_negatives(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ).withColumn("embedding", F.transform("embedding", lambda x: negatives.quantized(x)))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@query(r"""WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
pieces AS (SELECT row, lang, unnest(string_split_regex(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
spots AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0),
grams AS (SELECT lang, k AS size, array_to_string(words[i:i+k-1], ' ') AS phrase
  FROM spots, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(words)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND n >= 10),
cuts AS (SELECT lang, size, phrase, a, k, array_to_string(words[1:k], ' ') AS p1, array_to_string(words[k+1:], ' ') AS p2
  FROM candidates, (SELECT unnest([1, 2]) AS k) WHERE k < size),
scored AS (SELECT c.lang, c.size, c.phrase, c.a, c.k, x.n AS l, y.n AS r,
    ((1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1 JOIN f y ON y.lang = c.lang AND y.phrase = c.p2),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(words[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, array_to_string(words[2:3], ' '), a FROM candidates WHERE size = 3) GROUP BY ALL),
free AS (SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE g.longer IS NULL OR 100 * g.longer < 50 * s.a)
SELECT free.lang, row_number() OVER (PARTITION BY free.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, totals.n, score
FROM free JOIN totals ON totals.lang = free.lang QUALIFY rank <= 2000""")
def op12_phrases(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query(r"""WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
starts AS (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, least(len(words), 10) AS width, array_to_string(words[i:i+9], ' ') AS gram FROM starts),
widths AS (SELECT DISTINCT width FROM windows),
spots AS (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM d WHERE len(words) > 0),
grams AS (SELECT row, i, width, array_to_string(words[i:i+width-1], ' ') AS gram
  FROM spots, widths WHERE i + width - 1 <= len(words)),
hits AS (SELECT row, i, g.width, item FROM grams g JOIN windows w ON w.width = g.width AND w.gram = g.gram),
covered AS (SELECT row, count(DISTINCT p) AS n_hit FROM (
  SELECT row, unnest(range(i, i + width)) AS p FROM hits) GROUP BY row),
found AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.row = d.row LEFT JOIN found f ON f.row = d.row""")
def op13_decontaminate(spark, sf):
    rows = leaks.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    hit = leaks.n_hit(F.col("spans"))
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
