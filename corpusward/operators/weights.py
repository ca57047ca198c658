"""Sparse token weights and hashed dense vectors, from counts alone.

Chunks are dealt into parts of bounded text by their key. Each part's distinct words meet the
vocabulary and come back to their part, where chunks are counted and weighted in place: a word
travels once a part, never once a chunk, whatever the size of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusward.functions.text import let, token_id, words

# A word in this share of all chunks counts as hot; at most (words per chunk / share) words are.
HOT_SHARE = 0.01
# Characters of a part's texts: what one call of the counting function holds.
PART_CHARS = 4_000_000


def tf_weight(tf: Column) -> Column:
    return 1 + F.ln(tf.cast("double"))


def idf_weight(n_chunks: Column, df: Column) -> Column:
    return F.ln(1 + n_chunks / df)


def word_counts(chunks: DataFrame, key: str = "chunk_key", body: str = "text") -> DataFrame:
    """``(key, word, tf)``. Chunks are spread by key once; the grouping then needs no shuffle."""
    exploded = (
        chunks.select(key, body)
        .repartition(key)
        .select(key, F.explode(words(F.col(body))).alias("word"))
    )
    return exploded.groupBy(key, "word").agg(F.count("*").alias("tf"))


def vocabulary(chunks: DataFrame, body: str = "text") -> DataFrame:
    """``(word, token, df, idf, hot)``: token id, and in how many chunks each word occurs.

    Words are hashed here, once each, rather than at every occurrence.
    """
    n_chunks = chunks.select(F.count("*")).scalar()
    seen = chunks.select(F.explode(F.array_distinct(words(F.col(body)))).alias("word"))
    return (
        seen.groupBy("word").agg(F.count("*").alias("df"))
        .withColumn("idf", idf_weight(n_chunks, F.col("df")))
        .withColumn("hot", F.col("df") >= HOT_SHARE * n_chunks)
        .withColumn("token", token_id(F.col("word")))
    )


def _counted(texts: pa.Table, vocab: pa.Table, key: str, body: str):
    """Owner number of every row, the owners' keys, and ``(owner, word, tf)`` of known words.

    Rows of one key, null included, have one owner. ``str.split`` cuts as ``words`` does.
    """
    keys = texts[key].combine_chunks().dictionary_encode(null_encoding="encode")
    row_owner = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = {word: i for i, word in enumerate(vocab["word"].to_pylist())}
    found, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for owner, text in zip(row_owner, texts[body], strict=True):
        said = text.as_py()
        if said is not None:
            at = np.array([place.get(word, -1) for word in said.split()], np.int64)
            found.append(at[at >= 0])
            owners.append(np.full(len(found[-1]), owner))
    pair, tf = np.unique(np.concatenate(owners) * max(1, len(place)) + np.concatenate(found), return_counts=True)
    return row_owner, keys.dictionary, pair // max(1, len(place)), pair % max(1, len(place)), tf


def _in_parts(
    chunks: DataFrame, vocab: DataFrame, key: str, body: str, carry: list[str],
    weigh: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType,
) -> DataFrame:
    """``weigh`` over every part of the chunks and the words of the vocabulary that it holds."""
    size = chunks.agg(F.sum(F.length(body))).first()[0] or 0
    part = F.pmod(F.xxhash64(key), F.lit(-(-size // PART_CHARS) or 1)).alias("__part")
    placed = chunks.select(part, key, body, *carry)
    held = (
        placed.select(F.col("__part").alias("__of"), body).repartition("__of")
        .select("__of", F.explode(words(F.col(body))).alias("word")).distinct()
    )
    known = held.join(vocab.select("word", "token", "idf"), "word")
    return placed.groupBy("__part").cogroup(known.groupBy("__of")).applyInArrow(weigh, schema)


def lexical_weights(
    chunks: DataFrame, vocab: DataFrame, key: str = "chunk_key", body: str = "text",
    small_vocabulary: bool = False,
) -> DataFrame:
    """``(key, word, token, weight)`` with weight = (1 + ln tf) * ln(1 + N / df).

    Words missing from ``vocab`` are left out. ``small_vocabulary`` says that the vocabulary may be
    broadcast, which keeps the rows where they are; otherwise words meet it by parts of the chunks.
    """
    if small_vocabulary:
        joined = word_counts(chunks, key, body).join(F.broadcast(vocab.select("word", "token", "idf")), "word")
    else:
        def weigh(texts: pa.Table, known: pa.Table) -> pa.Table:
            _, keys, owner, word, tf = _counted(texts, known, key, body)
            columns = [pa.chunked_array([keys]).take(owner), *(known[c].take(word) for c in ("word", "token", "idf")), pa.array(tf)]
            return pa.table(columns, [key, "word", "token", "idf", "tf"])

        schema = T.StructType([chunks.schema[key], *vocab.select("word", "token", "idf").schema, T.StructField("tf", T.LongType())])
        joined = _in_parts(chunks, vocab, key, body, [], weigh, schema)
    return joined.select(key, "word", "token", (tf_weight(F.col("tf")) * F.col("idf")).alias("weight"))


def postings(weighted: DataFrame, key: str = "chunk_key") -> DataFrame:
    """``(key, token, weight)``; words that collide on a token id are merged.

    Rows are spread by key once, for ``sparse_vectors`` too.
    """
    rows = weighted.select(key, "token", "weight").repartition(key)
    return rows.groupBy(key, "token").agg(F.sum("weight").alias("weight"))


def sparse_vectors(posted: DataFrame, key: str = "chunk_key") -> DataFrame:
    """One row per chunk: token ids in order, and their weights."""
    pairs = F.array_sort(F.collect_list(F.struct("token", "weight")))
    return (
        posted.groupBy(key).agg(pairs.alias("__pairs"))
        .select(
            key,
            F.col("__pairs.token").alias("tokens"),
            F.col("__pairs.weight").alias("weights"),
        )
    )


def encode(
    chunks: DataFrame, vocab: DataFrame, dims: int = 64, key: str = "chunk_key",
    body: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Sparse and dense vectors of every chunk that has a word, in one pass.

    The dense vector adds each weight, signed, at ``token % dims`` and is scaled to length 1.
    ``corpusward.hooks.embed`` swaps in a model instead. There is one row per key; with ``carry``
    one per chunk that has a key, with these columns of its own, as a join by key would give.
    """
    def weigh(texts: pa.Table, known: pa.Table) -> pa.Table:
        row_owner, keys, owner, word, tf = _counted(texts, known, key, body)
        token = known["token"].to_numpy()[word].astype(np.int64)
        weight = (1 + np.log(tf)) * known["idf"].to_numpy()[word]
        order = np.lexsort((token, owner))
        owner, token, weight = owner[order], token[order], weight[order]
        # words that collide on a token id are merged
        starts = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(token) != 0))[: len(owner)])
        weight = np.add.reduceat(weight, starts) if len(starts) else weight
        owner, token = owner[starts], token[starts]
        signed = np.where(token // dims % 2 == 0, weight, -weight)
        dense = np.bincount(owner * dims + token % dims, signed, len(keys) * dims).reshape(-1, dims)
        norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
        dense = dense / np.where(norm > 0, norm, 1.0)
        offsets = np.searchsorted(owner, np.arange(len(keys) + 1)).astype(np.int32)
        vectors = pa.table({
            "tokens": pa.ListArray.from_arrays(offsets, pa.array(token, pa.int32())),
            "weights": pa.ListArray.from_arrays(offsets, pa.array(weight)),
            "dense": pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * dims, pa.array(dense.ravel())),
        })
        full = np.diff(offsets) > 0
        if not carry:
            return vectors.add_column(0, key, keys).filter(full)
        rows = texts.select([key, *carry])
        here = np.flatnonzero(full[row_owner] & rows[key].is_valid().to_numpy())
        rows, vectors = rows.take(here), vectors.take(row_owner[here])
        return pa.table([rows[key], *vectors.columns, *(rows[c] for c in carry)], schema.names)

    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        chunks.schema[key], T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("weights", numbers),
        T.StructField("dense", numbers), *(chunks.schema[c] for c in carry),
    ])
    return _in_parts(chunks, vocab, key, body, list(carry), weigh, schema)


def unit(vec: Column) -> Column:
    """``vec`` scaled to length 1; a zero vector stays zero."""
    squares = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)
    return let(
        F.sqrt(squares),
        lambda norm: F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))),
    )
