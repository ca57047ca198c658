"""Vectors, search, rerank, quality and duplicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusward.catalog import tables as t
from corpusward.catalog.scalars import TOKEN_SQL
from corpusward.operators import ann, dedup, reports, search, weights
from corpusward.session import cut

C = F.col
QUERIES, SQL = {}, {}
DIMS = 64


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- vectors -----------------------------------------------------------------------------------

_WEIGHTS = f"""{t.CHUNKS}, occurrences AS (
  SELECT chunk_key, unnest({t.sql_words('text')}) AS word FROM chunks),
counts AS (SELECT chunk_key, word, count(*) AS tf FROM occurrences GROUP BY ALL),
vocab AS (SELECT word, ln(1 + (SELECT count(*) FROM chunks) / count(*)) AS idf FROM counts GROUP BY word),
hashed AS (SELECT word, idf, {TOKEN_SQL} AS token FROM (SELECT *, sha256(word) AS h FROM vocab)),
weighted AS (SELECT chunk_key, word, token, (1 + ln(tf)) * idf AS weight FROM counts JOIN hashed USING (word)),
postings AS (SELECT chunk_key, token, sum(weight) AS weight FROM weighted GROUP BY ALL)"""

_ASKED = f"""{t.QUESTIONS}, asked_words AS (
  SELECT query_id, word, count(*) AS tf FROM (
    SELECT query_id, unnest({t.sql_words('query')}) AS word FROM questions) GROUP BY ALL),
asked AS (SELECT query_id, token, sum((1 + ln(tf)) * idf) AS weight FROM asked_words JOIN hashed USING (word) GROUP BY ALL)"""

_VISIBLE = "list_has_any(allowed_groups, list_append(groups, 'Public'))"
_POOL = 20

_SPARSE = f"""sparse_scored AS (
  SELECT a.query_id, p.chunk_key, round(sum(a.weight * p.weight), 9) AS score
  FROM asked a JOIN postings p USING (token) JOIN chunks c ON c.chunk_key = p.chunk_key
  JOIN questions q ON q.query_id = a.query_id WHERE {_VISIBLE} GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank
  FROM sparse_scored QUALIFY rank <= {_POOL})"""


def _dense_sql(name: str, key: str, source: str) -> str:
    return f"""{name}_dims AS (SELECT {key}, token % {DIMS} AS dim,
    sum(CASE WHEN (token // {DIMS}) % 2 = 0 THEN weight ELSE -weight END) AS v FROM {source} GROUP BY ALL),
{name} AS (SELECT {key}, list(coalesce(v, 0.0) ORDER BY dim) AS vec
  FROM (SELECT DISTINCT {key} FROM {source}) CROSS JOIN (SELECT unnest(range(0, {DIMS})) AS dim)
  LEFT JOIN {name}_dims USING ({key}, dim) GROUP BY {key})"""


_DENSE = f"""{_dense_sql('chunk_vec', 'chunk_key', 'postings')}, {_dense_sql('asked_vec', 'query_id', 'asked')},
dense_scored AS (
  SELECT query_id, chunk_key, round(list_cosine_similarity(a.vec, v.vec), 9) AS score
  FROM asked_vec a JOIN questions q USING (query_id), chunk_vec v JOIN chunks c USING (chunk_key) WHERE {_VISIBLE}),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_key) AS rank
  FROM dense_scored QUALIFY rank <= {_POOL})"""

_FUSED = f"""{_WEIGHTS}, {_ASKED}, {_SPARSE}, {_DENSE}, fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_key) AS fused_rank FROM (
    SELECT query_id, chunk_key, round(sum(1 / (60 + rank)), 9) AS rrf_score
    FROM (SELECT query_id, chunk_key, rank FROM sparse UNION ALL SELECT query_id, chunk_key, rank FROM dense)
    GROUP BY ALL) QUALIFY fused_rank <= {_POOL})"""

_RERANKED = f"""{_FUSED}, scored AS (
  SELECT f.*, q.query, c.filename, c.text,
         len(list_intersect(list_distinct({t.sql_words('q.query')}), list_distinct({t.sql_words('c.text')})))
         / len(list_distinct({t.sql_words('q.query')})) AS rerank_score
  FROM fused f JOIN questions q USING (query_id) JOIN chunks c USING (chunk_key)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_rank) AS rank
  FROM scored QUALIFY rank <= 5)"""


def _encoded(spark, sf):
    """Index rows of all chunks, and the questions' vectors over the same vocabulary."""
    chunks = t.chunks(spark, sf)
    vocab = cut(weights.vocabulary(chunks))
    index = weights.encode(chunks, vocab, DIMS, carry=("allowed_groups",))
    asked = cut(weights.encode(t.questions(spark, sf), vocab, DIMS, "query_id", "query"))
    return chunks, index, asked


def _legs(spark, sf, legs):
    _, index, asked = _encoded(spark, sf)
    asked = asked.join(t.questions(spark, sf).select("query_id", "groups"), "query_id")
    return search.legs_topk(index, asked, search.pool_size(5), legs)


@query(f"WITH {_WEIGHTS} SELECT chunk_key, word, weight FROM weighted")
def lexical_weights(spark, sf):
    chunks = t.chunks(spark, sf)
    return weights.lexical_weights(chunks, cut(weights.vocabulary(chunks))).drop("token")


@query(f"""WITH {_WEIGHTS}
SELECT chunk_key, string_agg(token, ',' ORDER BY token) AS tokens, count(*) AS n, sum(weight) AS total
FROM postings GROUP BY chunk_key""")
def build_sparse_vector(spark, sf):
    chunks = t.chunks(spark, sf)
    posted = weights.postings(weights.lexical_weights(chunks, cut(weights.vocabulary(chunks))))
    return weights.sparse_vectors(posted).select(
        "chunk_key", F.array_join("tokens", ",").alias("tokens"), F.size("tokens").cast("bigint").alias("n"),
        F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).alias("total"),
    )


@query(f"""WITH {_WEIGHTS}, {_dense_sql('chunk_vec', 'chunk_key', 'postings')},
normed AS (SELECT chunk_key, vec, sqrt(list_inner_product(vec, vec)) AS norm FROM chunk_vec)
SELECT chunk_key, dim::INT AS dim, round(vec[dim + 1] / norm, 9) AS value
FROM normed, (SELECT unnest(range(0, {DIMS})) AS dim)""")
def embed(spark, sf):
    _, index, _ = _encoded(spark, sf)
    return index.select("chunk_key", F.posexplode("dense").alias("dim", "value")).withColumn("value", F.round("value", 9))


# --- search ------------------------------------------------------------------------------------

def _centroids(spark, sf):
    e = t.read(spark, sf, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"])
    return parts.groupBy(C("label").cast("bigint").alias("query_id")).agg(weights.unit(vec).alias("dense"))


def _vectors(spark, sf):
    return t.read(spark, sf, "embeddings").select(
        C("vec_id").alias("chunk_key"), C("embedding").cast("array<double>").alias("dense")
    )


@query("""WITH means AS (
  SELECT label, dim, avg(embedding[dim]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL),
centroids AS (SELECT label::BIGINT AS query_id, list(x ORDER BY dim) AS vec FROM means GROUP BY label)
SELECT query_id, vec_id AS chunk_key, round(list_cosine_similarity(vec, embedding::DOUBLE[]), 9) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vec, embedding::DOUBLE[]), 9) DESC, vec_id) AS rank
FROM centroids, embeddings QUALIFY rank <= 20""")
def dense_topk(spark, sf):
    return search.dense_topk(_vectors(spark, sf), _centroids(spark, sf), 20).withColumn("rank", C("rank").cast("bigint"))


@query()
def dense_topk_ann(spark, sf):
    return ann.dense_topk_ann(_vectors(spark, sf), _centroids(spark, sf), 20)


@query("SELECT 20 * count(DISTINCT label) AS n_exact, true AS recall_reached FROM embeddings")
def dense_topk_ann_recall(spark, sf):
    """Whether the approximate search finds at least 0.9 of the exact results."""
    asked = cut(_centroids(spark, sf))
    found = ann.dense_topk_ann(_vectors(spark, sf), asked, 20)
    exact = search.dense_topk(_vectors(spark, sf), asked, 20)
    return ann.recall(found, exact).select("n_exact", (C("recall") >= 0.9).alias("recall_reached"))


@query(f"WITH {_WEIGHTS}, {_ASKED}, {_SPARSE} SELECT query_id, chunk_key, score, rank FROM sparse")
def sparse_topk(spark, sf):
    return _legs(spark, sf, ("sparse",)).drop("leg").withColumn("rank", C("rank").cast("bigint"))


@query(f"""WITH {_WEIGHTS}, {_ASKED}, {_SPARSE}, {_DENSE}
SELECT 'sparse' AS leg, query_id, chunk_key, rank FROM sparse
UNION ALL SELECT 'dense', query_id, chunk_key, rank FROM dense""")
def leg_rank(spark, sf):
    return _legs(spark, sf, ("dense", "sparse")).select("leg", "query_id", "chunk_key", C("rank").cast("bigint").alias("rank"))


@query(f"WITH {_FUSED} SELECT query_id, chunk_key, rrf_score, fused_rank FROM fused")
def hybrid_rrf(spark, sf):
    fused = search.fuse(_legs(spark, sf, ("dense", "sparse")), search.pool_size(5))
    return fused.withColumn("fused_rank", C("fused_rank").cast("bigint"))


def _searched(spark, sf, **options):
    chunks, index, asked = _encoded(spark, sf)
    return search.search(index, chunks, t.questions(spark, sf), asked, limit=5, **options)


@query(f"WITH {_RERANKED} SELECT query_id, chunk_key, filename, rerank_score, rank FROM reranked")
def rerank_topk(spark, sf):
    return _searched(spark, sf).select(
        "query_id", "chunk_key", "filename", "rerank_score", C("rank").cast("bigint").alias("rank")
    )


@query(f"WITH {_FUSED} SELECT query_id, chunk_key, round(1 - 0.1 * (fused_rank - 1), 9)::DOUBLE AS rerank_score FROM fused WHERE fused_rank <= 5")
def rerank_fallback(spark, sf):
    return _searched(spark, sf, reranked=False).select("query_id", "chunk_key", "rerank_score")


@query(f"WITH {_RERANKED} SELECT query_id, chunk_key, rerank_score AS score FROM scored")
def rerank(spark, sf):
    """Scores of the whole pool."""
    chunks, index, asked = _encoded(spark, sf)
    asked = asked.join(t.questions(spark, sf).select("query_id", "groups"), "query_id")
    pool = search.fuse(search.legs_topk(index, asked, 20), 20).join(t.questions(spark, sf), "query_id")
    small = search.fits(t.questions(spark, sf), search.QUESTION_BOUND)
    found = search.with_text(pool, chunks, small)
    return found.select("query_id", "chunk_key", search.overlap_score(C("query"), C("text")).alias("score"))


_QUALITY = f"""{_RERANKED}, gold AS (
  SELECT query_id, chunk_key FROM questions, chunks WHERE contains(text, query)),
per AS (SELECT g.query_id, count(*) AS n_gold, count(r.rank) AS n_hits, min(r.rank) AS first_hit
  FROM gold g LEFT JOIN reranked r ON r.query_id = g.query_id AND r.chunk_key = g.chunk_key GROUP BY g.query_id),
quality AS (SELECT query_id, n_gold, n_hits, n_hits / n_gold AS recall, n_hits / 5 AS precision,
  coalesce(1 / first_hit, 0.0)::DOUBLE AS reciprocal_rank FROM per)"""


def _gold(spark, sf):
    """Chunks that hold a question's text: they share its longest word, which keeps the join an
    equi-join, and then contain the whole text."""
    asked = t.questions(spark, sf)
    longest = F.max_by("word", F.struct(F.length("word"), "word"))
    inner = asked.select("query_id", F.explode(F.split("query", "[^A-Za-z]+")).alias("word"))
    keys = inner.groupBy("query_id").agg(longest.alias("word")).join(asked, "query_id")
    chunks = t.chunks(spark, sf)
    held = chunks.select("chunk_key", F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+"))).alias("word"))
    if search.fits(asked, search.QUESTION_BOUND):
        keys = F.broadcast(keys)
    near = held.join(keys, "word").select("query_id", "query", "chunk_key")
    return (
        near.join(chunks.select("chunk_key", "text"), "chunk_key")
        .filter(F.contains("text", "query")).select("query_id", "chunk_key")
    )


@query(f"WITH {_QUALITY} SELECT * FROM quality")
def retrieval_eval(spark, sf):
    return reports.retrieval_quality(_searched(spark, sf), _gold(spark, sf), 5)


@query(f"""WITH {_QUALITY} SELECT count(*) AS n_questions, round(avg(recall), 9) AS context_recall,
  round(avg(precision), 9) AS context_precision, round(avg(reciprocal_rank), 9) AS mrr FROM quality""")
def retrieval_eval_overall(spark, sf):
    per = reports.retrieval_quality(_searched(spark, sf), _gold(spark, sf), 5)
    rounded = [F.round(c, 9).alias(c) for c in ("context_recall", "context_precision", "mrr")]
    return reports.overall_quality(per).select("n_questions", *rounded)


# --- duplicates --------------------------------------------------------------------------------

_SETS = f"""sets AS MATERIALIZED (
  SELECT doc_id, words, len(words) AS n FROM (
    SELECT doc_id, list_distinct({t.sql_words('text')}) AS words FROM documents)),
close AS MATERIALIZED (
  SELECT a.doc_id AS first, b.doc_id AS later, a.n + b.n AS total, len(list_intersect(a.words, b.words)) AS common
  FROM sets a JOIN sets b ON a.doc_id < b.doc_id AND a.n >= 0.9 * b.n AND b.n >= 0.9 * a.n),
edges AS MATERIALIZED (
  SELECT first, later, common / (total - common) AS jaccard FROM close WHERE common / (total - common) >= 0.9),
numbered AS MATERIALIZED (
  SELECT later, list(first) AS firsts, row_number() OVER (ORDER BY later) AS i FROM edges GROUP BY later)"""

_GREEDY = f"""{_SETS}, greedy AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS dropped
  UNION ALL
  SELECT n.i, CASE WHEN len(list_filter(n.firsts, lambda f: NOT list_contains(g.dropped, f))) > 0
                   THEN list_append(g.dropped, n.later) ELSE g.dropped END
  FROM greedy g JOIN numbered n ON n.i = g.i + 1),
dropped AS MATERIALIZED (SELECT unnest(dropped) AS doc_id FROM (SELECT dropped FROM greedy ORDER BY i DESC LIMIT 1))"""


@query(f"""WITH RECURSIVE {_GREEDY}
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dropped)""")
def dedup_keep_first(spark, sf):
    return dedup.keep_first(t.read(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id")


@query(f"""WITH RECURSIVE {_GREEDY}, matched AS (
  SELECT e.later AS doc_id, e.first AS kept_id, e.jaccard,
         row_number() OVER (PARTITION BY e.later ORDER BY e.first) AS nth
  FROM edges e JOIN dropped d ON d.doc_id = e.later WHERE e.first NOT IN (SELECT doc_id FROM dropped))
SELECT doc_id, kept_id, round(jaccard, 9) AS jaccard FROM matched WHERE nth = 1""")
def dedup_band_join(spark, sf):
    found = dedup.duplicate_matches(t.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return found.select(C("key").alias("doc_id"), C("kept_key").alias("kept_id"), F.round("jaccard", 9).alias("jaccard"))


@query(f"""SELECT min(doc_id) AS doc_id FROM (
  SELECT doc_id, list_sort(list_distinct({t.sql_words('text')})) AS words FROM documents) GROUP BY words""")
def exact_dedup(spark, sf):
    return dedup.exact_first(dedup.word_sets(t.read(spark, sf, "documents"), "doc_id")).select(C("key").alias("doc_id"))


@query()
def minhash_signature(spark, sf):
    sets = dedup.word_sets(t.read(spark, sf, "documents"), "doc_id")
    return sets.select(C("key").alias("doc_id"), F.posexplode(dedup.minhash_signature(C("words"))).alias("seed", "value"))
