"""Access-filtered hybrid search for many questions at once.

The index is cut by chunk, never by token or group: each task scores its chunks against a block of
questions and keeps the best ``k`` per question, so only winners are shuffled, whatever a token's
or a group's frequency. A question block of checked size is broadcast and the index is read once,
in place. Beyond that bound, in rows or in list elements, questions and index are both cut into
blocks that meet by equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusward.functions.access import PUBLIC
from corpusward.functions.text import let, word_set
from corpusward.operators.versions import active
from corpusward.session import fits

QUESTION_BOUND = 4096
CELL_ROWS = 50_000
# List elements (numbers and group names) of a broadcast question block, and of an index cell.
QUESTION_ELEMENTS = 4_000_000
CELL_ELEMENTS = 16_000_000
SCORE_DIGITS = 9
LEG_SCHEMA = "leg STRING, query_id BIGINT, chunk_key BIGINT, score DOUBLE"
_ARROW = pa.schema(
    [("leg", pa.string()), ("query_id", pa.int64()), ("chunk_key", pa.int64()),
     ("score", pa.float64())]
)


def pool_size(limit: int) -> int:
    """Candidates per leg for a final result of ``limit`` rows."""
    return max(20, 2 * limit)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number of every list element, and the elements."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def _holders(starts: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row with each entry of its list: list ``at[i]`` spans ``starts[at[i]]`` to the next."""
    counts = starts[at + 1] - starts[at]
    shift = np.repeat(starts[at] - (np.cumsum(counts) - counts), counts)
    return np.repeat(row, counts), np.arange(counts.sum()) + shift


@dataclass
class Questions:
    """A block of questions as arrays: what every task needs for scoring."""

    ids: np.ndarray
    groups: list[str] | None = None
    group_starts: np.ndarray | None = None
    group_owners: np.ndarray | None = None
    dense: np.ndarray | None = None
    vocab: np.ndarray | None = None
    starts: np.ndarray | None = None
    owners: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))

    @classmethod
    def of(cls, table: pa.Table, legs: tuple[str, ...]) -> Questions:
        block = cls(table["query_id"].to_numpy())
        count = len(block.ids)
        if "groups" in table.column_names:
            row, names = _ragged(table["groups"])
            listed = names.dictionary_encode()
            block.groups = listed.dictionary
            place = pc.fill_null(listed.indices, -1).to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")[np.count_nonzero(place < 0) :]
            block.group_owners = row[order]
            block.group_starts = np.searchsorted(place[order], np.arange(len(block.groups) + 1))
        if "dense" in legs:
            block.dense = unit_rows(matrix(table["dense"]))
        if "sparse" in legs:
            row, token = _ragged(table["tokens"])
            weight = _ragged(table["weights"])[1].to_numpy(zero_copy_only=False)
            token = token.to_numpy(zero_copy_only=False)
            order = np.argsort(token, kind="stable")
            block.vocab, first = np.unique(token[order], return_index=True)
            block.starts = np.append(first, len(token))
            block.owners, block.weights = row[order], weight[order]
        return block

    def visible(self, allowed: pa.Array) -> np.ndarray:
        """Chunk by question: open to all, or a group in common."""
        row, names = _ragged(allowed)
        seen = np.zeros((len(allowed), len(self.ids)), bool)
        public = pc.fill_null(pc.equal(names, PUBLIC), False).to_numpy(zero_copy_only=False)
        seen[row[public]] = True
        place = pc.fill_null(pc.index_in(names, self.groups), -1).to_numpy(zero_copy_only=False)
        held = (place >= 0) & ~public
        row, entry = _holders(self.group_starts, place[held], row[held])
        seen[row, self.group_owners[entry]] = True
        return seen

    def dense_scores(self, batch: pa.RecordBatch) -> np.ndarray:
        return unit_rows(matrix(batch["dense"])) @ self.dense.T

    def sparse_scores(self, batch: pa.RecordBatch) -> np.ndarray:
        """Dot products; -inf where no token is shared."""
        count = len(self.ids)
        row, token = _ragged(batch["tokens"])
        weight = _ragged(batch["weights"])[1].to_numpy(zero_copy_only=False)
        token = token.to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.vocab, token)
        at[at == len(self.vocab)] = 0
        hit = self.vocab[at] == token if len(self.vocab) else np.zeros(len(token), bool)
        row, at, weight = row[hit], at[hit], weight[hit]
        holders = self.starts[at + 1] - self.starts[at]
        row, entry = _holders(self.starts, at, row)
        cell = row * count + self.owners[entry]
        value = np.repeat(weight, holders) * self.weights[entry]
        size = batch.num_rows * count
        total = np.bincount(cell, value, size)
        total[np.bincount(cell, minlength=size) == 0] = -np.inf
        return total.reshape(batch.num_rows, count)


class _Best:
    """The best ``k`` (score, then smallest key) per question seen so far."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.floor = np.full(questions, -np.inf)
        self.query = np.empty(0, np.int64)
        self.key = np.empty(0, np.int64)
        self.score = np.empty(0)

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        row, query = np.nonzero((scores >= self.floor) & (scores > -np.inf))
        self.query = np.concatenate([self.query, query])
        self.key = np.concatenate([self.key, keys[row]])
        self.score = np.concatenate([self.score, scores[row, query]])
        order = np.lexsort((self.key, -self.score, self.query))
        self.query, self.key, self.score = self.query[order], self.key[order], self.score[order]
        rank = np.arange(len(order)) - np.searchsorted(self.query, self.query)
        keep = rank < self.k
        full = rank == self.k - 1
        self.floor[self.query[full]] = self.score[full]
        self.query, self.key, self.score = self.query[keep], self.key[keep], self.score[keep]


def _score(
    batches: Iterator[pa.RecordBatch], block: Questions, legs: tuple[str, ...], k: int
) -> Iterator[pa.RecordBatch]:
    if not len(block.ids):
        return
    best = {leg: _Best(len(block.ids), k) for leg in legs}
    step = max(1, 2_000_000 // max(1, len(block.ids)))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            keys = batch["chunk_key"].to_numpy()
            hidden = ~block.visible(batch["allowed_groups"]) if block.groups is not None else None
            for leg in legs:
                raw = block.dense_scores(batch) if leg == "dense" else block.sparse_scores(batch)
                scores = np.round(raw, SCORE_DIGITS)
                if hidden is not None:
                    scores[hidden] = -np.inf
                best[leg].add(keys, scores)
    for leg, top in best.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([leg] * len(top.key), pa.string()), pa.array(block.ids[top.query], pa.int64()),
             pa.array(top.key, pa.int64()), pa.array(top.score, pa.float64())],
            schema=_ARROW,
        )


def _columns(legs: tuple[str, ...], index: DataFrame, questions: DataFrame) -> tuple[list, list]:
    vectors = [c for leg in legs for c in (("dense",) if leg == "dense" else ("tokens", "weights"))]
    access = "groups" in questions.columns
    return (
        ["chunk_key", *(["allowed_groups"] if access else []), *vectors],
        ["query_id", *(["groups"] if access else []), *vectors],
    )


def _by_broadcast(index: DataFrame, questions: pa.Table, legs: tuple[str, ...], k: int):
    block = index.sparkSession.sparkContext.broadcast(Questions.of(questions, legs))
    return index.mapInArrow(lambda it: _score(it, block.value, legs, k), LEG_SCHEMA)


def meet(legs: tuple[str, ...], k: int):
    """Scores the chunks of a group against its questions; both are bounded by the caller."""

    def both(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        if not chunks.num_rows or not asked.num_rows:
            return _ARROW.empty_table()
        block = Questions.of(asked, legs)
        return pa.Table.from_batches(
            list(_score(iter(chunks.combine_chunks().to_batches()), block, legs, k)), _ARROW
        )

    return both


def _extent(rows: DataFrame, columns: list[str]) -> tuple[int, int]:
    """Rows, and elements of all their lists, counted in place."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in columns[1:]]
    total = F.sum(sum(sizes, F.lit(0)).cast("bigint"))
    return tuple(rows.agg(F.count("*"), F.coalesce(total, F.lit(0))).first())


def _by_grid(
    index: DataFrame, questions: DataFrame, legs: tuple[str, ...], k: int, q_blocks: int, cells: int
):
    left = index.withColumn("__c", F.pmod(F.xxhash64("chunk_key"), F.lit(cells))).withColumn(
        "__q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>"))
    )
    right = questions.withColumn(
        "__q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))
    ).withColumn("__c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<bigint>")))
    return (
        left.groupBy("__c", "__q").cogroup(right.groupBy("__c", "__q"))
        .applyInArrow(meet(legs, k), LEG_SCHEMA)
    )


def legs_topk(
    index: DataFrame, questions: DataFrame, k: int, legs: tuple[str, ...] = ("dense", "sparse"),
    question_bound: int = QUESTION_BOUND, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(leg, query_id, chunk_key, score, rank)``: best ``k`` visible chunks per question and leg.

    ``index``: ``chunk_key, allowed_groups, tokens, weights, dense``; ``questions``: ``query_id,
    groups, tokens, weights, dense``. Without a ``groups`` column no access rule applies. Chunks a
    question may not see never take part in the ranking. Scores are compared at nine decimals,
    equal ones by chunk key.
    """
    index_columns, question_columns = _columns(legs, index, questions)
    index, questions = index.select(*index_columns), questions.select(*question_columns)
    count, elements = _extent(questions, question_columns)
    q_blocks = max(1, -(-count // question_bound), -(-elements // QUESTION_ELEMENTS))
    if q_blocks == 1:
        scored = _by_broadcast(index, questions.toArrow(), legs, k)
    else:
        count, elements = _extent(index, index_columns)
        cells = max(1, -(-count // cell_rows), -(-elements // CELL_ELEMENTS))
        scored = _by_grid(index, questions, legs, k, q_blocks, cells)
    by_score = W.partitionBy("leg", "query_id").orderBy(F.desc("score"), "chunk_key")
    return scored.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def dense_topk(index: DataFrame, questions: DataFrame, k: int, **options) -> DataFrame:
    """Exact cosine top ``k``."""
    return legs_topk(index, questions, k, ("dense",), **options).drop("leg")


def sparse_topk(index: DataFrame, questions: DataFrame, k: int, **options) -> DataFrame:
    """Top ``k`` by the dot product over shared tokens."""
    return legs_topk(index, questions, k, ("sparse",), **options).drop("leg")


def fuse(ranked: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of ``1 / (k + rank)`` over the legs a chunk appears in."""
    fused = ranked.groupBy("query_id", "chunk_key").agg(
        F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), SCORE_DIGITS).alias("rrf_score")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), "chunk_key")
    return fused.withColumn("fused_rank", F.row_number().over(order)).filter(
        F.col("fused_rank") <= limit
    )


def rerank_fallback(pool: DataFrame, limit: int) -> DataFrame:
    """Without a reranker: 1.0, 0.9, 0.8, ... in fused order."""
    return (
        pool.filter(F.col("fused_rank") <= limit)
        .withColumn("rerank_score", F.round(1 - 0.1 * (F.col("fused_rank") - 1), SCORE_DIGITS))
        .withColumn("rank", F.col("fused_rank"))
    )


def overlap_score(query, text):
    """Share of the question's distinct words that the chunk holds."""
    def share(asked):
        found = F.size(F.array_intersect(asked, word_set(text)))
        return F.when(F.size(asked) > 0, found / F.size(asked)).otherwise(F.lit(0.0))

    return let(word_set(query), share)


def with_text(pool: DataFrame, chunks: DataFrame, small: bool) -> DataFrame:
    """Join chunk columns to a fused pool; texts are read only here.

    ``small`` states that the pool's size was checked (questions within the bound times the pool
    size); it is then broadcast and the chunk table is not shuffled.
    """
    return chunks.join(F.broadcast(pool) if small else pool, "chunk_key")


def rerank(pool: DataFrame, limit: int, scorer=overlap_score) -> DataFrame:
    """Score ``(query, text)`` of the pool and keep the best ``limit``; ties keep fused order.

    ``scorer`` maps two columns to a score; ``corpusward.hooks.reranker`` builds one from a model.
    The plain question is scored, without its hypothetical answer.
    """
    scored = pool.withColumn("rerank_score", scorer(F.col("query"), F.col("text")))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "fused_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def search(
    index: DataFrame, chunks: DataFrame, questions: DataFrame, encoded: DataFrame,
    limit: int = 5, reranked: bool = True, scorer=overlap_score, active_only: bool = True,
) -> DataFrame:
    """The whole search: both legs, fusion, rerank. One row per question and rank.

    Where ``index`` or ``chunks`` have ``is_active``, chunks of replaced versions take no part
    unless ``active_only`` is off.

    ``questions``: ``query_id, query, groups``; ``encoded``: ``query_id, tokens, weights, dense``
    of the expanded question text; ``chunks``: ``chunk_key`` and what answers need from a chunk.
    """
    if active_only and "is_active" in index.columns:
        index = active(index)
    elif active_only and "is_active" in chunks.columns:
        index = index.join(active(chunks).select("chunk_key"), "chunk_key", "left_semi")
    pool = pool_size(limit)
    asked = encoded.join(questions.select("query_id", "groups"), "query_id")
    fused = fuse(legs_topk(index, asked, pool), pool)
    small = fits(questions, QUESTION_BOUND)
    plain = questions.select("query_id", "query")
    found = with_text(fused, chunks, small).join(F.broadcast(plain) if small else plain, "query_id")
    return rerank(found, limit, scorer) if reranked else rerank_fallback(found, limit)
