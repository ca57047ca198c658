"""Near-duplicate removal that keeps the first copy.

A chunk is dropped iff an earlier *kept* chunk has word-set Jaccard similarity of at least the
threshold; a dropped chunk suppresses nothing. Chunks are ordered by key.

1. Chunks with the same word set collapse to the earliest one. That loses nothing: later copies
   are duplicates of it, or of whatever it is a duplicate of.
2. Candidates come from blocks. The default blocks are lossless prefixes: with all words in one
   order, two sets at or above the threshold share one of their first few words, about a tenth of
   the set. The order is by rarity, so blocks are the rare words that two texts have in common, and
   texts made from one template meet only where they really agree. The place of a shared word bounds
   how many words can be shared at all; pairs below the least overlap are never formed.
   ``blocks_from_parts`` (hash parts, lossless too) and ``blocks_from_bands`` (classic MinHash
   bands, which miss some pairs) are options.
3. Blocks are worked off in rounds. In each round the first members of a block are compared with its
   other members, so a block of n copies costs a small multiple of n, never n * n; the copies found
   leave all their blocks. Each round takes four times as many first members, so even a block of n
   different sets is done after log n rounds. Every candidate is verified on its whole word set.
4. Word sets stay where they lie. Candidates first meet as sketches of 64 bytes, which bound the words
   two sets differ in and lose no pair; only sets of pairs that pass are moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial, reduce
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusward.functions.text import word_set
from corpusward.operators.skew import join_hot
from corpusward.session import cut, fits, release

THRESHOLD = 0.9
# First members of a block in the first round, and how much that number grows in each.
LEADERS = 8
GROWTH = 4
# Words whose frequency is known when words are ordered; the others count as rare.
FREQUENT = 50_000
HOT_SHARE = 0.001
# Bits of a set's sketch, and keys whose rows are looked up by broadcast.
SKETCH_BITS = 512
KEY_BOUND = 1_000_000
# Signature length, and the bands and rows the 0.9 threshold gives for it.
PERMUTATIONS = 128
PARITY_BANDS = (5, 25)
WIDE_BANDS = (16, 8)


def word_sets(
    chunks: DataFrame, key: str = "chunk_key", body: str = "text", keep: tuple[str, ...] = (),
    distinct: str | None = None,
) -> DataFrame:
    """``(key, n, words, print)``: distinct words as sorted 64-bit hashes, and their fingerprint.

    Columns named by ``keep`` come along. ``distinct`` names a column that holds the words already.
    """
    hashed = F.transform(F.col(distinct) if distinct else word_set(F.col(body)), lambda w: F.xxhash64(w))
    return (
        chunks.select(F.col(key).alias("key"), *keep, F.array_sort(F.array_distinct(hashed)).alias("words"))
        .withColumn("n", F.size("words"))
        .withColumn(
            "print", F.sha2(F.array_join(F.col("words").cast("array<string>"), ","), 256)
        )
    )


def exact_first(sets: DataFrame) -> DataFrame:
    """``(key)``: the earliest chunk of every distinct word set; grouping combines map-side."""
    return sets.groupBy("print").agg(F.min("key").alias("key")).select("key")


def minhash_signature(words: Column, permutations: int = PERMUTATIONS) -> Column:
    """Per permutation the smallest seeded hash over the words."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(permutations)),
        lambda seed: F.array_min(F.transform(words, lambda w: F.xxhash64(seed, w))),
    )


def blocks_from_bands(sets: DataFrame, bands: tuple[int, int] = WIDE_BANDS) -> DataFrame:
    """``(block, key, n)`` from MinHash bands ``(bands, rows)``."""
    count, rows = bands
    signed = sets.select("key", "n", minhash_signature(F.col("words"), count * rows).alias("sig"))
    hashed = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda b: F.xxhash64(b, F.slice(F.col("sig"), b * rows + 1, rows)),
    )
    return signed.select(F.explode(hashed).alias("block"), "key", "n")


def _levels(threshold: Fraction, top: int = 10**9) -> list[int]:
    """Largest set size of every level: partners of a set lie in its level or the next."""
    smallest = floor(threshold / (1 - threshold))
    sizes = [max(1, smallest)]
    while sizes[-1] < top:
        sizes.append(max(sizes[-1] + 1, floor(sizes[-1] / threshold)))
    return sizes


def blocks_from_parts(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(block, key, n)``: lossless blocks, see the module text.

    A set takes part in its own size level and in the one below, where it may meet smaller
    partners. Sets of a level with largest size ``r`` and their partners differ in at most
    ``d = r * (1 - t) / t`` words, so words go to ``d + 2`` parts. Empty parts are no evidence and
    are skipped, except for the rare set with two or more of them, which emits those too: a pair
    whose only equal parts are empty has at least two empty ones on both sides.
    """
    t = Fraction(str(threshold))
    sizes = _levels(t)
    parts = [floor(r * (1 - t) / t) + 2 for r in sizes]
    bounds = F.array(*[F.lit(s) for s in sizes])
    counts = F.array(*[F.lit(p) for p in parts])
    level = F.size(F.filter(bounds, lambda b: b < F.col("n")))

    near = sets.filter(F.col("n") >= floor(t / (1 - t)))
    placed = near.select(
        "key", "n", "words",
        F.explode(F.filter(F.array(level, level - 1), lambda v: v >= 0)).alias("level"),
    ).select(
        "key", "n", "level", F.element_at(counts, F.col("level") + 1).alias("parts"),
        F.explode("words").alias("word"),
    )
    filled = (
        placed.groupBy("key", "n", "level", "parts", F.pmod("word", "parts").alias("part"))
        .agg(F.bit_xor(F.xxhash64("word")).alias("content"))
    )
    gathered = filled.groupBy("key", "n", "level", "parts").agg(
        F.collect_list(F.struct("part", "content")).alias("filled")
    )
    every = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>"), lambda p: p
    )
    empty = F.array_except(every, F.col("filled.part").cast("array<bigint>"))
    gaps = F.when(
        F.size(empty) >= 2,
        F.transform(empty, lambda p: F.struct(p.alias("part"), F.lit(0).cast("bigint").alias("content"))),
    ).otherwise(F.array().cast("array<struct<part: bigint, content: bigint>>"))
    every_part = F.concat(
        F.col("filled").cast("array<struct<part: bigint, content: bigint>>"), gaps
    )
    return gathered.select("key", "n", "level", F.explode(every_part).alias("p")).select(
        F.xxhash64("level", "p.part", "p.content").alias("block"), "key", "n"
    )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that several sets of a batch hold, and how many do."""
    for batch in batches:
        word, n = np.unique(batch["words"].flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word[n > 1]), pa.array(n[n > 1])], ["word", "n"])


def word_order(sets: DataFrame, frequent: int = FREQUENT) -> list[int]:
    """The most frequent words, rarest first; at most ``frequent`` of them, however many there are.

    All sets are counted, but words that are rare in a batch of them do not leave it: they are not
    among the most frequent, and any list is lossless.
    """
    counted = sets.select("words").mapInArrow(_repeated, "word BIGINT, n BIGINT").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(frequent).collect()
    return [row["word"] for row in reversed(top)]


def _prefixes(
    order: np.ndarray, place: np.ndarray, t: Fraction, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """The first words of each set in the order: words not listed by their hash, then listed ones."""
    for batch in batches:
        words, keys, n = batch["words"], batch["key"].to_numpy(), batch["n"].to_numpy().astype(np.int64)
        flat = words.flatten().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(order, flat), len(order) - 1) if len(order) else None
        rank = np.where(order[at] == flat, place[at], -1) if len(order) else np.full(len(flat), -1)
        sorted_at = np.lexsort([flat, rank, row])
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        head = pos < (n - -(-t.numerator * n // t.denominator) + 1)[row]
        rows = row[head]
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat[sorted_at][head]), pa.array(keys[rows]), pa.array(n[rows].astype(np.int32)),
             pa.array(pos[head].astype(np.int32))],
            ["block", "key", "n", "pos"],
        )


def blocks_from_prefixes(
    sets: DataFrame, threshold: float = THRESHOLD, order: list[int] | None = None
) -> DataFrame:
    """``(block, key, n, pos)``: a block per word of each set's prefix, see the module text.

    ``order`` lists words that come last, in order; any list is lossless, as long as all sets that
    are to meet use the same one. Without it the sets' own frequent words are taken.
    """
    t = Fraction(str(threshold))
    if t >= 1:  # equal sets have the same print
        return sets.select(F.col("key").alias("block"), "key", F.col("n").cast("int").alias("n"), F.lit(0).alias("pos")).limit(0)
    listed = np.array(word_order(sets) if order is None else order, np.int64)
    by_word = np.argsort(listed)
    given = sets.sparkSession.sparkContext.broadcast((listed[by_word], by_word))
    rows = sets.filter(F.col("n") >= floor(t / (1 - t))).select("key", "words", "n")
    return rows.mapInArrow(
        lambda batches: _prefixes(*given.value, t, batches),
        f"block BIGINT, key {sets.schema['key'].dataType.simpleString()}, n INT, pos INT",
    )


_LOSSLESS = (blocks_from_prefixes, blocks_from_parts)


def possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of block members whose sizes, and places of the shared word, allow the threshold."""
    pairs = pairs.filter(_size_ok(F.col("n"), F.col("__n"), threshold))
    if "pos" not in pairs.columns:
        return pairs
    t = Fraction(str(threshold))
    rest = F.least(F.col("n") - F.col("pos"), F.col("__n") - F.col("__pos")).cast("bigint")
    return pairs.filter(
        t.numerator * (F.col("n") + F.col("__n")) <= (t.numerator + t.denominator) * rest
    )


def first_of_pair(member: DataFrame) -> DataFrame:
    """Block members as the first of a pair."""
    names = {"key": "first", "n": "__n", "pos": "__pos"}
    kept = [c for c in ("block", "key", "n", "pos") if c in member.columns]
    return member.select(*[F.col(c).alias(names.get(c, c)) for c in kept])


def _size_ok(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= F.floor(F.greatest(a, b) * threshold)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per set one bit for every residue of its words: whether an odd number of them has it."""
    for batch in batches:
        words = batch["words"]
        n = np.diff(words.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)), n)
        cell = row * SKETCH_BITS + (words.flatten().to_numpy().view(np.uint64) % SKETCH_BITS).astype(np.int64)
        odd = (np.bincount(cell, minlength=len(n) * SKETCH_BITS) & 1).astype(np.uint8)
        packed = np.packbits(odd).view(np.int64).reshape(len(n), -1)
        yield pa.RecordBatch.from_arrays(
            [batch["key"], pa.array(n.astype(np.int32)), *(pa.array(packed[:, i].copy()) for i in range(packed.shape[1]))],
            ["key", "size", *(f"b{i}" for i in range(packed.shape[1]))],
        )


def plausible(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct ``(first, later)`` whose sketches allow the threshold; no pair at or above it is lost.

    Two sets differ in at least as many words as their sketches have different bits, and sets at the
    threshold ``t`` in at most ``(1 - t) / (1 + t)`` of their sizes' sum.
    """
    t, count = Fraction(str(threshold)), SKETCH_BITS // 64

    def sketched(sets: DataFrame, as_key: str, prefix: str) -> DataFrame:
        columns = ", ".join(f"b{i} BIGINT" for i in range(count))
        made = sets.select("key", "words").mapInArrow(
            _sketches, f"key {sets.schema['key'].dataType.simpleString()}, size INT, {columns}")
        return made.select(F.col("key").alias(as_key), *[F.col(c).alias(prefix + c) for c in made.columns[1:]])

    met = pairs.select("first", "later").distinct().join(sketched(left, "first", "f_"), "first").join(
        sketched(right, "later", "l_"), "later")
    differ = sum((F.bit_count(F.col(f"f_b{i}").bitwiseXOR(F.col(f"l_b{i}"))) for i in range(count)), F.lit(0))
    total = (F.col("f_size") + F.col("l_size")).cast("bigint")
    allowed = differ * (t.numerator + t.denominator) <= total * (t.denominator - t.numerator)
    return cut(met.filter(allowed).select("first", "later").distinct())


def picked(rows: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` whose key is among ``keys``; they stay in place where the keys are few enough."""
    return rows.join(F.broadcast(keys) if fits(keys, KEY_BOUND) else keys, key, "left_semi")


def verify_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(first, later, jaccard)`` of the pairs at or above the threshold.

    ``left`` and ``right`` are ``(key, words)`` for the two sides. A first chunk with very many
    later partners is broadcast; at most ``1 / HOT_SHARE`` can be that frequent.
    """
    left = picked(left, pairs.select(F.col("first").alias("key")).distinct())
    right = picked(right, pairs.select(F.col("later").alias("key")).distinct())
    pairs = pairs.withColumn("first", F.col("first").cast("string"))
    degree = pairs.groupBy("first").agg(F.count("*").alias("__n"))
    total = pairs.select(F.count("*")).scalar()
    firsts = (
        left.select(F.col("key").cast("string").alias("first"), F.col("words").alias("__a"))
        .join(degree, "first")
        .withColumn("__hot", F.col("__n") >= F.greatest(total * HOT_SHARE, F.lit(1000)))
    )
    later = right.select(F.col("key").alias("later"), F.col("words").alias("__b"))
    joined = join_hot(
        pairs, firsts.select("first", "__a", "__hot"), "first", F.col("__hot"), F.col("later")
    ).join(later, "later")
    shared = F.size(F.array_intersect("__a", "__b"))
    jaccard = shared / (F.size("__a") + F.size("__b") - shared)
    return (
        joined.withColumn("jaccard", jaccard)
        .filter(F.col("jaccard") >= threshold)
        .select(F.col("first").cast("bigint").alias("first"), "later", "jaccard")
    )


def _shared(member: DataFrame) -> DataFrame:
    """Memberships in blocks that still hold at least two chunks."""
    several = member.groupBy("block").agg(F.count("*").alias("__n")).filter("__n > 1")
    return member.join(several, "block", "left_semi")


def near_dropped(
    sets: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD, verify: bool = True
) -> DataFrame:
    """``(key)``: chunks of pairwise different word sets that an earlier kept chunk duplicates.

    Without ``verify`` a shared block alone makes a duplicate, whatever the similarity.
    """
    member = cut(_shared(blocks))
    edges: DataFrame | None = None
    dropped: list[DataFrame] = []
    first_members = LEADERS

    while True:
        members_left = not member.isEmpty()
        if members_left:
            rank = F.row_number().over(W.partitionBy("block").orderBy("key"))
            leaders = cut(member.withColumn("__r", rank).filter(F.col("__r") <= first_members).drop("__r"))
            first_members *= GROWTH
            pairs = member.join(first_of_pair(leaders), "block").filter(F.col("first") < F.col("key"))
            if verify:
                pairs = possible(pairs, threshold)
            found, likely = pairs.select("first", F.col("key").alias("later")).distinct(), None
            if verify:
                likely = plausible(found, sets, sets, threshold)
                found = verify_pairs(likely, sets, sets, threshold).select("first", "later")
            known, edges = edges, cut(found if edges is None else edges.unionByName(found).distinct())
            done, member = member, cut(_shared(member.join(leaders, ["block", "key"], "left_anti")))
            release(done, leaders, likely, known)
        if edges is None or (not members_left and edges.isEmpty()):
            break
        edges, gone = _decide(edges, member)
        if gone is not None:
            dropped.append(gone)
            done, member = member, cut(_shared(member.join(gone, "key", "left_anti")))
            release(done)
    release(member)
    if not dropped:
        return sets.select("key").limit(0)
    return reduce(DataFrame.unionByName, dropped).distinct()


def _decide(edges: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Settle what the known edges allow: returns the open edges and the chunks dropped.

    A chunk is kept once it has no open earlier neighbour and waits in no block; its later
    neighbours are dropped at once, even those that still wait.
    """
    waiting = member.select("key").distinct()
    gone: list[DataFrame] = []
    while True:
        settled = (
            edges.select(F.col("first").alias("key")).distinct()
            .join(edges.select(F.col("later").alias("key")).distinct(), "key", "left_anti")
            .join(waiting, "key", "left_anti")
        )
        hit = cut(
            edges.join(settled.withColumnRenamed("key", "first"), "first", "left_semi")
            .select(F.col("later").alias("key")).distinct()
        )
        if hit.isEmpty():
            break
        gone.append(hit)
        edges = cut(
            edges.join(hit.withColumnRenamed("key", "first"), "first", "left_anti")
            .join(hit.withColumnRenamed("key", "later"), "later", "left_anti")
        )
        waiting = waiting.join(hit, "key", "left_anti")
    return edges, reduce(DataFrame.unionByName, gone).distinct() if gone else None


def keep_first(
    chunks: DataFrame, key: str = "chunk_key", body: str = "text", threshold: float = THRESHOLD,
    blocks=blocks_from_prefixes, verify: bool = True,
) -> DataFrame:
    """``chunks`` without near-duplicates of an earlier kept chunk.

    ``blocks=partial(blocks_from_bands, bands=PARITY_BANDS), verify=False`` drops on any band hit,
    which finds only about a third of the pairs right at the threshold.
    """
    sets = cut(word_sets(chunks, key, body))
    kept, made = kept_keys(sets, threshold, blocks, verify)
    release(sets, made)
    return picked(chunks, kept.withColumnRenamed("key", key), key)


def kept_keys(
    sets: DataFrame, threshold: float = THRESHOLD, blocks=blocks_from_prefixes, verify: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Keys kept of stored word sets, and the blocks of all earliest copies."""
    firsts = cut(exact_first(sets))
    made = blocks(sets, threshold) if blocks in _LOSSLESS else blocks(sets)
    made = cut(made.join(firsts, "key", "left_semi"))
    lost = near_dropped(sets, made, threshold, verify)
    kept = sets.select("key").join(firsts, "key", "left_semi").join(lost, "key", "left_anti")
    return cut(kept), made


def to_copies(fresh: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``(key, kept_key, jaccard)`` for all fresh chunks, from what was found for one chunk
    ``later`` of each word set."""
    copies = fresh.groupBy("print").agg(F.count("*").alias("__n"))
    total = fresh.select(F.count("*")).scalar()
    by_print = (
        found.join(distinct.select("print", F.col("key").alias("later")), "later").drop("later")
        .join(copies, "print")
        .withColumn("__hot", F.col("__n") >= F.greatest(total * HOT_SHARE, F.lit(1000))).drop("__n")
    )
    return join_hot(
        fresh.select("key", "print"), by_print, "print", F.col("__hot"), F.col("key")
    ).select("key", "kept_key", "jaccard")


def matches(
    fresh: DataFrame, known: DataFrame, threshold: float = THRESHOLD, blocks=None,
    known_blocks: DataFrame | None = None,
) -> DataFrame:
    """``(key, kept_key, jaccard)``: the smallest known chunk each fresh one duplicates.

    ``fresh`` and ``known`` are word sets; ``known`` ones must be duplicates of none among
    themselves, so few of them share a block. ``blocks`` and ``known_blocks`` must agree on the order
    of words, if they use one; by default it is made from the fresh sets.
    """
    fresh = cut(fresh)
    if blocks is None:
        blocks = partial(blocks_from_prefixes, threshold=threshold, order=word_order(fresh))
    if known_blocks is None:
        known_blocks = blocks(known)
    known_small = known.select("print", F.col("key").alias("kept_key"))
    firsts = known_small.groupBy("print").agg(F.min("kept_key").alias("kept_key"))
    frequent = fresh.groupBy("print").agg(F.count("*").alias("__n"))
    total = fresh.select(F.count("*")).scalar()
    flagged = firsts.join(frequent, "print").withColumn(
        "__hot", F.col("__n") >= F.greatest(total * HOT_SHARE, F.lit(1000))
    )
    same = join_hot(
        fresh.select("key", "print"), flagged.select("print", "kept_key", "__hot"), "print",
        F.col("__hot"), F.col("key"),
    ).select("key", "kept_key", F.lit(1.0).alias("jaccard"))

    distinct = fresh.join(exact_first(fresh), "key", "left_semi")
    pairs = possible(blocks(distinct).join(first_of_pair(known_blocks), "block"), threshold).select(
        "first", F.col("key").alias("later")
    )
    near = verify_pairs(plausible(pairs, known, fresh, threshold), known, fresh, threshold)
    best = near.groupBy("later").agg(F.min(F.struct(F.col("first").alias("kept_key"), "jaccard")).alias("m"))
    spread_out = to_copies(fresh, distinct, best.select("later", "m.kept_key", "m.jaccard"))
    both = same.unionByName(spread_out).filter(F.col("key") != F.col("kept_key"))
    return (
        both.groupBy("key").agg(F.min(F.struct("kept_key", "jaccard")).alias("m"))
        .select("key", "m.kept_key", "m.jaccard")
    )


def duplicate_matches(
    chunks: DataFrame, key: str = "chunk_key", body: str = "text", threshold: float = THRESHOLD,
    blocks=blocks_from_prefixes,
) -> DataFrame:
    """``(key, kept_key, jaccard)`` for every dropped chunk: the earliest kept chunk it copies."""
    sets = cut(word_sets(chunks, key, body))
    kept, made = kept_keys(sets, threshold, blocks)
    # of equal sets the first is kept or has its match among the kept, which is that of all of them
    first = made.join(kept, "key", "left_semi")
    later = made.join(kept, "key", "left_anti")
    pairs = possible(later.join(first_of_pair(first), "block").filter(F.col("first") < F.col("key")), threshold)
    likely = plausible(pairs.select("first", F.col("key").alias("later")), sets, sets, threshold)
    near = verify_pairs(likely, sets, sets, threshold)
    best = near.groupBy("later").agg(F.min(F.struct(F.col("first").alias("kept_key"), "jaccard")).alias("m"))
    same = sets.select("key", "print").join(kept, "key", "left_semi").select(
        F.col("key").alias("later"), F.col("key").alias("kept_key"), F.lit(1.0).alias("jaccard"))
    each = cut(best.select("later", "m.kept_key", "m.jaccard").unionByName(same))
    copies = to_copies(sets.join(kept, "key", "left_anti"), sets, each).filter(F.col("kept_key") < F.col("key"))
    found = cut(
        copies.groupBy("key").agg(F.min(F.struct("kept_key", "jaccard")).alias("m"))
        .select("key", "m.kept_key", "m.jaccard")
    )
    release(sets, made, likely, each)
    return found
