"""SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints within ``max_bits`` of each other are linked; documents form the components of these
links. The search is exact.

1. *Upper nodes.* The 64 bits are cut into ``max_bits + 2`` segments. Two fingerprints within
   ``max_bits`` agree on at least two whole segments, so for one of the 15 choices of two segments
   (a mask) they share the masked bit pattern. Every choice is one tree whose upper nodes are these
   patterns; fingerprints reach their nodes by equality, never by comparing all with all.
2. *Gray order.* Inside a node fingerprints are sorted by the Gray rank of their other bits, so
   neighbours in the order differ in few bits. Consecutive ones form groups that factor out the bits
   all of them share, groups of groups again. A search adds up the differences from the upper node
   down and drops a whole group as soon as they exceed ``max_bits``.
3. *Dense groups.* Copies with small edits share nearly all nodes, so one cluster may hold a large
   part of all rows. A first pass therefore links only close neighbours in each Gray order, which
   collapses such clusters. In the exact pass, nodes all of whose members are already in one
   component hold nothing new and go. Members of the others meet in cells of bounded size: every
   member has one home cell, and members outside the node's largest component visit all its cells.
   Any pair of different components has such a visitor, so no link between components is lost.

Only links between different components leave a task, at most one per component and cell.
Fingerprints, not documents, are compared: copies have collapsed before.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like
any other; fewer words than ``shingle`` make one shingle of all of them; rows with equal ids or a
null id are rows of their own (a component's id is the smallest id that is not null); an empty table
gives an empty result; columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.graph import components, forest
from corpusward.llm.rows import PLACE, located
from corpusward.operators.skew import join_hot
from corpusward.session import cut, release

SHINGLE = 4
MAX_BITS = 4
SEED = 42
# A node of more members than this is cut into cells of about this many.
CELL = 4096
# Members of a group, and groups of a group above it.
FANOUT = 16
# How far the first pass looks ahead in each order.
NEIGHBOURS = 4
# Searches walked down a cell's tree at a time.
SLICE = 512
# A fingerprint with this share of all rows is a hot join key; at most 1 / HOT_SHARE are.
HOT_SHARE = 0.001
_BLOCK = 1 << 16


# --- fingerprints ------------------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    width = min(shingle, len(words))
    starts = np.concatenate([[0], blanks + 1])[: len(words) - width + 1].tolist()
    ends = np.append(blanks, len(joined))[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over = ones * 2 > len(starts)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, key: str = "doc_id", body: str = "text", shingle: int = SHINGLE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, fp, *keep)`` per row, the fingerprint as a signed bigint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            prints = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints), *batch.columns[2:]], ["id", "fp", *keep]
            )

    rows = docs.select(F.col(key).alias("id"), F.col(body).cast("string").alias("text"), *keep)
    kinds = {field.name: field.dataType.simpleString() for field in rows.schema}
    kept = "".join(f", {name} {kinds[name]}" for name in keep)
    return rows.mapInArrow(run, f"id {kinds['id']}, fp BIGINT{kept}")


# --- upper nodes and Gray order ----------------------------------------------------------------

def _segments(parts: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of ``parts`` runs of bits that make up 64."""
    ends = [64 * i // parts for i in range(parts + 1)]
    return [(low, high - low) for low, high in zip(ends, ends[1:], strict=False)]


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _packed(values: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for shift, width in segments:
        piece = (values >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        out = (out << np.uint64(width)) | piece
    return out


def _nodes(max_bits: int):
    """Rows ``(node, rank, fp, comp)``: every fingerprint below each of its upper nodes."""
    segments = _segments(max_bits + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch["fp"].to_numpy().view(np.uint64)
            for number, pair in enumerate(combinations(range(len(segments)), 2)):
                chosen = [segments[i] for i in pair]
                others = [s for i, s in enumerate(segments) if i not in pair]
                node = _packed(prints, chosen) | np.uint64(number << 56)
                rank = gray_rank(_packed(prints, others))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array(rank.view(np.int64)), batch["fp"],
                     batch["comp"]],
                    ["node", "rank", "fp", "comp"],
                )

    return run


def _indexed(prints: DataFrame, max_bits: int) -> DataFrame:
    return prints.select("fp", "comp").mapInArrow(
        _nodes(max_bits), "node BIGINT, rank BIGINT, fp BIGINT, comp BIGINT"
    )


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits  # signed counts are of abs()


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    node, root = forest(a, b)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])


def _neighbour_links(max_bits: int, ahead: int):
    """Links between rows at most ``ahead`` apart in the order; nodes may be cut anywhere."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.empty((2, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([tail, [batch["node"].to_numpy(), batch["fp"].to_numpy()]], axis=1)
            node, fp = rows
            found = []
            for step in range(1, min(ahead, len(fp) - 1) + 1):
                ok = (node[:-step] == node[step:]) & _near(fp[:-step], fp[step:], max_bits)
                found.append((fp[:-step][ok], fp[step:][ok]))
            if found:
                yield _links(*(np.concatenate(side) for side in zip(*found, strict=True)))
            tail = rows[:, -ahead:]

    return run


# --- the search inside cells -------------------------------------------------------------------

def _factor(values: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ``FANOUT`` consecutive entries: the bits all their members share, and their mask."""
    cuts = np.arange(0, len(values), FANOUT)
    first = np.repeat(values[cuts], np.diff(np.append(cuts, len(values))))
    differ = (values ^ first) | ~masks
    return values[cuts], ~np.bitwise_or.reduceat(differ, cuts)


def tree_pairs(
    queries: np.ndarray, members: np.ndarray, max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(query, member)`` of all pairs within ``max_bits``; members in Gray order.

    Walks from the top group down. A query keeps, for every group it still may meet, the
    differences added up so far; only bits that a level shares beyond the level above it are
    looked at, and groups beyond ``max_bits`` are dropped with all below them.
    """
    levels = [(members, np.full(len(members), ~np.uint64(0)))]
    while len(levels[-1][0]) > 1:
        levels.append(_factor(*levels[-1]))
    none, (top, masks) = np.uint64(0), levels[-1]
    query = np.arange(len(queries))
    group = np.zeros(len(queries), np.int64)
    seen = np.full(len(queries), none)
    spent = np.zeros(len(queries), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        top, masks = levels[depth]
        if depth < len(levels) - 1:
            child = group[:, None] * FANOUT + np.arange(FANOUT)
            inside = child < len(top)
            parent = np.nonzero(inside)[0]
            query, seen, spent, group = query[parent], seen[parent], spent[parent], child[inside]
        fresh = masks[group] & ~seen
        spent = spent + np.bitwise_count((queries[query] ^ top[group]) & fresh)
        alive = spent <= max_bits
        query, group, spent = query[alive], group[alive], spent[alive]
        seen = masks[group]
    return query, group


def _cell_links(max_bits: int):
    """Links between components inside each ``(node, cell)``, rows sorted by these and rank.

    A cell is at most a few thousand members and its visitors; visitors are read in slices.
    """
    def of_cell(fp, comp, home) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        members, owner = fp[home].view(np.uint64), comp[home]
        if not len(members):
            return
        names, counts = np.unique(owner, return_counts=True)
        # of two home members of different components one is outside the largest
        outside = (comp != names[np.argmax(counts)]) | ~home
        fp, comp = fp[outside], comp[outside]
        for at in range(0, len(fp), SLICE):
            asked, asking = fp[at : at + SLICE].view(np.uint64), comp[at : at + SLICE]
            q, m = tree_pairs(asked, members, max_bits)
            other = asking[q] != owner[m]
            yield asking[q[other]], owner[m[other]]

    def small(cell, fp, comp, home) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows in cells of at most FANOUT rows: one group each, compared as such, all at once."""
        for step in range(1, min(FANOUT, len(fp))):
            same = cell[:-step] == cell[step:]
            if not same.any():
                return
            ok = same & (comp[:-step] != comp[step:]) & _near(fp[:-step], fp[step:], max_bits)
            ok &= home[:-step] | home[step:]
            yield comp[:-step][ok], comp[step:][ok]

    def work(rows: np.ndarray) -> pa.RecordBatch:
        node, part, fp, comp, home = rows
        home = home.astype(bool)
        change = np.flatnonzero((np.diff(node) != 0) | (np.diff(part) != 0)) + 1
        bounds = np.concatenate([[0], change, [len(node)]])
        sizes = np.diff(bounds)
        cell = np.repeat(np.arange(len(sizes)), sizes)
        few = np.repeat(sizes <= FANOUT, sizes)
        found = list(small(cell[few], fp[few], comp[few], home[few]))
        for i in np.flatnonzero(sizes > FANOUT):
            span = slice(bounds[i], bounds[i + 1])
            found += of_cell(fp[span], comp[span], home[span])
        sides = [np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*found, strict=True)]
        return _links(*sides) if sides else _links(fp[:0], fp[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((5, 0), np.int64)
        for batch in batches:
            read = [batch[c].to_numpy() for c in ("node", "part", "fp", "comp", "home")]
            held = np.concatenate([held, read], axis=1)
            last = (held[0] == held[0, -1]) & (held[1] == held[1, -1])
            whole = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if whole:
                yield work(held[:, :whole])
                held = held[:, whole:]
        if held.shape[1]:
            yield work(held)

    return run


def _cells(rows: DataFrame, cell: int) -> DataFrame:
    """Members of nodes with more than one component, dealt to cells."""
    stats = cut(
        rows.groupBy("node").agg(
            F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")
        ).filter(F.col("low") != F.col("high"))
        .select("node", F.ceil(F.col("n") / cell).alias("parts"))
    )
    wide = stats.filter(F.col("parts") > 1)
    largest = (
        rows.join(wide.select("node"), "node", "left_semi").groupBy("node", "comp")
        .agg(F.count("*").alias("n")).groupBy("node")
        .agg(F.max(F.struct("n", "comp"))["comp"].alias("largest"))
    )
    dealt = rows.join(stats.join(largest, "node", "left"), "node")
    home = F.pmod(F.xxhash64("fp"), F.col("parts"))
    stray = (F.col("parts") > 1) & (F.col("comp") != F.col("largest"))
    visits = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda p: p != home)
    visits = F.when(stray, visits).otherwise(F.array().cast("array<bigint>"))
    places = F.concat(
        F.array(F.struct(home.alias("part"), F.lit(1).cast("bigint").alias("home"))),
        F.transform(visits, lambda p: F.struct(p.alias("part"), F.lit(0).cast("bigint").alias("home"))),
    )
    return dealt.select("node", "rank", "fp", "comp", F.inline(places))


def link_components(
    prints: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL, ahead: int = NEIGHBOURS
) -> DataFrame:
    """``(fp, comp)`` for distinct fingerprints ``prints(fp)``: the smallest one reachable."""
    alone = prints.select("fp", F.col("fp").alias("comp"))
    links = _indexed(alone, max_bits).select("node", "rank", "fp")
    links = links.repartitionByRange("node", "rank").sortWithinPartitions("node", "rank")
    close = components(links.mapInArrow(_neighbour_links(max_bits, ahead), "a BIGINT, b BIGINT"))
    first = cut(_relabelled(alone, close))

    cells = _cells(_indexed(first, max_bits), cell)
    cells = cells.repartition("node", "part").sortWithinPartitions("node", "part", "rank")
    cells = cells.select("node", "part", "fp", "comp", "home")
    rest = components(cells.mapInArrow(_cell_links(max_bits), "a BIGINT, b BIGINT"))
    final = cut(_relabelled(first, rest))
    release(close, rest, first)
    return final


def _relabelled(prints: DataFrame, stars: DataFrame) -> DataFrame:
    new = stars.select(F.col("a").alias("comp"), F.col("b").alias("__root"))
    return prints.join(new, "comp", "left").select(
        "fp", F.coalesce("__root", "comp").alias("comp")
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", body: str = "text", shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(key, fingerprint, component_id)`` per row; see the module text."""
    rows = cut(fingerprints(docs, key, body, shingle))
    groups = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    labels = link_components(groups.select("fp"), max_bits)
    named = groups.join(labels, "fp")
    named = named.withColumn("comp", F.col("comp").cast("string"))
    prints = groups.select(F.count("*")).scalar()
    least = named.groupBy("comp").agg(
        F.min("least").alias("component_id"),
        (F.count("*") >= F.greatest(prints * HOT_SHARE, F.lit(1000))).alias("__wide"),
    )
    total = groups.select(F.sum("n")).scalar()
    lookup = join_hot(named, least, "comp", F.col("__wide"), F.col("fp")).select(
        F.col("fp").cast("string").alias("__fp"), "component_id",
        (F.col("n") >= F.greatest(total * HOT_SHARE, F.lit(1000))).alias("__hot"),
    )
    keyed = rows.select("id", F.col("fp").cast("string").alias("__fp"), F.monotonically_increasing_id().alias("__row"))
    joined = join_hot(keyed, lookup, "__fp", F.col("__hot"), F.col("__row"))
    return joined.select(
        F.col("id").alias(key),
        F.lpad(F.lower(F.hex(F.col("__fp").cast("bigint"))), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_representatives(
    docs: DataFrame, key: str = "doc_id", body: str = "text", shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``docs`` with one row of every group: that of the smallest id.

    A null id comes after all others; of rows that share an id the first by file and row stays.
    """
    located_rows = located(docs)
    rows = cut(fingerprints(located_rows, key, body, shingle, tuple(PLACE)))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", *PLACE)).alias("first")
    groups = cut(rows.groupBy("fp").agg(first))
    labels = link_components(groups.select("fp"), max_bits)
    stays = groups.join(labels, "fp").groupBy("comp").agg(F.min("first").alias("first"))
    stays = stays.select(*[F.col(f"first.{name}").alias(name) for name in PLACE])
    return located_rows.join(stays, PLACE, "left_semi").select(*docs.columns)
