"""Phrase collocations, counted in a HAT-trie that spills sorted runs.

1. *Count.* A task walks over its texts and adds, for every word, the phrase of up to three words
   that starts there to a trie of its language. The trie's upper levels are keyed by word number;
   below them hang hash containers, which burst when they are full. Shorter phrases need no entries:
   their counts are sums over a subtree. Beyond a bound on entries or on bytes of words the trie
   spills whole subtrees, the largest first, as a run sorted by word.
2. *Merge.* Runs are cut into blocks by prefix partition, a stretch of phrases in word order. Bounds
   lie between whole phrases of a sample, so a frequent first word or word pair is cut over as many
   partitions as it needs, and their number follows the size of the corpus. Spark shuffles the
   blocks; a partition merges its runs, adds up equal phrases and closes their prefixes. Only the
   prefixes at its two ends can go on next door; those are added up after it. Phrases below the
   least count never leave the partition.
3. *Score.* What remains are the frequent phrases, among them all parts of candidates, as a part is
   never rarer than the whole. Candidates meet the counts of their parts by joins that spread hot
   parts; the counts of longer candidates reach the shorter ones as one maximum per phrase.

Counts are exact over all words of all texts; the sample decides only where they are made. A task
holds its bounded tries, or one partition's runs. Lost executors cost the shuffle files they held.

Defined results: words are compared as bytes after lower-casing A to Z; a null text is empty, a
null language is ``und`` and as such the same as a language of that name; the same text in several
rows counts as often; an empty table gives no rows; columns other than text and language are not
read, whatever their names. Scores are computed in decimals of 38 digits, exact while
``1,000,000 * a * a`` and ``l * r`` stay below ten to the 38th.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusward.llm.memory import sliced
from corpusward.operators.skew import join_hot
from corpusward.session import cut

LONGEST = 3
# Marks that end a piece, and blanks between words.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
UNKNOWN = "und"
# Entries of a worker's tries, bytes of its words, and entries of a container before it bursts.
ENTRIES = 650_000
WORD_BYTES = 32 << 20
BURST = 1 << 15
# Words whose phrases a prefix partition holds, about; texts sampled for each, and a phrase of how
# many words of a sampled text.
PART_WORDS = 1_500_000
SAMPLE_DOCS = 20
SAMPLE_STEP = 41
_BITS = 21  # of a word's number inside a worker
_MASK = (1 << _BITS) - 1
# A phrase part among this share of all parts is a hot join key.
HOT_SHARE = 0.001
_CLEAN = bytes(
    ENDS[0] if b in ENDS else 32 if b in BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def tokens(text: bytes) -> list[bytes]:
    """Words in order, a mark standing for the end of each piece."""
    mark = ENDS[:1]
    spaced = text.translate(_CLEAN).replace(mark, b" " + mark + b" ")
    return [word for word in spaced.split(b" ") if word]


class HatTrie:
    """Counts of phrases of three words or less, as numbers below ``1 << 21``; 0 stands for no word.

    The root's first container is shared by all first words. When it is full it bursts: first words
    with many phrases get a container of their own, and that one, when full, bursts into a node with
    a container per second word.
    """

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.room = burst, 4 * burst
        self.shared: Counter = Counter()
        self.flat: dict[int, Counter] = {}
        self.nodes: dict[int, defaultdict[int, Counter]] = {}
        self.apart = np.zeros(1 << _BITS, bool)  # first words that have left the shared container

    def add(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> None:
        apart = self.apart[first]
        key = second << _BITS | third
        self.shared.update((first << 2 * _BITS | key)[~apart].tolist())
        if apart.any():
            self._add_apart(first[apart], key[apart])
        if len(self.shared) > self.room:
            self._burst_shared()

    def _add_apart(self, first: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        first, keys = first[order], key[order].tolist()
        cuts = np.flatnonzero(np.diff(first, prepend=-1, append=-1)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            head = int(first[a])
            node = self.nodes.get(head)
            if node is None:
                container = self.flat[head]
                container.update(keys[a:b])
                if len(container) > self.burst:
                    self._burst(head)
            else:
                for k in keys[a:b]:
                    node[k >> _BITS][k & _MASK] += 1

    def _burst_shared(self) -> None:
        """Give the first words with the most phrases containers of their own."""
        key, n = self._shared()
        first = key >> 2 * _BITS
        heads, sizes = np.unique(first, return_counts=True)
        heads = heads[sizes > self.burst // 16]
        self.apart[heads] = True
        leave = self.apart[first]
        self.shared = Counter(dict(zip(key[~leave].tolist(), n[~leave].tolist(), strict=True)))
        for head in heads.tolist():
            self.flat[head] = Counter()
        rest = (1 << 2 * _BITS) - 1
        for head, k, count in zip(first[leave].tolist(), (key[leave] & rest).tolist(), n[leave].tolist(), strict=True):
            self.flat[head][k] = count
        self.room = max(self.room, 2 * len(self.shared))  # what is left has few phrases a word

    def _burst(self, head: int) -> None:
        node = self.nodes[head] = defaultdict(Counter)
        for key, n in self.flat.pop(head).items():
            node[key >> _BITS][key & _MASK] = n

    def _shared(self) -> tuple[np.ndarray, np.ndarray]:
        size = len(self.shared)
        return np.fromiter(self.shared, np.int64, size), np.fromiter(self.shared.values(), np.int64, size)

    def sizes(self) -> dict[int, int]:
        """Entries below each first word that stands apart, and under 0 those of all others."""
        out = {0: len(self.shared)} | {head: len(container) for head, container in self.flat.items()}
        return out | {head: sum(map(len, node.values())) for head, node in self.nodes.items()}

    def cut_off(self, heads: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take whole subtrees, as ``sizes`` names them, out: first, second, third words, counts."""
        firsts, keys, counts = [], [], []
        for head in heads:
            if not head:
                key, n = self._shared()
                firsts.append(key >> 2 * _BITS)
                keys.append(key & (1 << 2 * _BITS) - 1)
                counts.append(n)
                self.shared.clear()
                continue
            own, n = [], []
            if head in self.nodes:
                for second, container in self.nodes.pop(head).items():
                    own += [second << _BITS | third for third in container]
                    n += container.values()
            else:
                container = self.flat.pop(head)
                own += container
                n += container.values()
            self.apart[head] = False
            firsts.append(np.full(len(own), head, np.int64))
            keys.append(np.array(own, np.int64))
            counts.append(np.array(n, np.int64))
        first, key, count = (np.concatenate(parts) for parts in (firsts, keys, counts))
        return first, key >> _BITS, key & _MASK, count


class _Words(dict):
    """Numbers of words from 1; ``None`` and the end of a piece are 0."""

    def __init__(self) -> None:
        super().__init__({ENDS[:1]: 0})
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.bytes += len(word)
        return number


class _Counting:
    """One worker's tries, a trie per language, with their common words."""

    def __init__(self, bounds: list[tuple[bytes, ...]], entries: int, word_bytes: int) -> None:
        self.bounds, self.entries, self.word_bytes = bounds, entries, word_bytes
        self.words, self.tries = _Words(), {}
        self.most = 0  # entries there may be at most

    def add(self, lang: str, numbers: np.ndarray) -> None:
        """``numbers`` of all words of some texts, every piece and text ended by 0."""
        second = np.append(numbers[1:], 0)
        third = np.where(second == 0, 0, np.append(numbers[2:], [0, 0])[: len(numbers)])
        at = numbers > 0
        self.most += len(numbers)
        self.tries.setdefault(lang, HatTrie()).add(numbers[at], second[at], third[at])

    def full(self) -> bool:
        return len(self.words) > _MASK // 2 or self.words.bytes > self.word_bytes

    def spilled(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Runs of the largest subtrees, until half of the bound is free, or of all."""
        everything = everything or self.full()
        if not everything and self.most <= self.entries:
            return
        sizes = [(n, lang, head) for lang, trie in self.tries.items() for head, n in trie.sizes().items()]
        held = self.most = sum(n for n, _, _ in sizes)
        if not everything and held <= self.entries:
            return
        chosen: dict[str, list[int]] = {}
        for n, lang, head in sorted(sizes, reverse=True):
            if not everything and held <= self.entries // 2:
                break
            chosen.setdefault(lang, []).append(head)
            held -= n
        self.most = held
        listed = list(self.words)
        listed[0] = b""  # no word sorts before all words
        names = pa.array(listed, pa.binary())
        order = np.array(pc.sort_indices(names))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for lang, heads in chosen.items():
            *columns, counts = self.tries[lang].cut_off(heads)
            columns = [rank[column] for column in columns]
            run = np.argsort(columns[0] << (2 * _BITS) | columns[1] << _BITS | columns[2])
            yield from self._blocks(lang, names, order, [c[run] for c in columns], counts[run])
        if everything:
            self.words, self.tries, self.most = _Words(), {}, 0

    def _blocks(self, lang, names, order, columns, counts) -> Iterator[pa.RecordBatch]:
        """A sorted run, cut at the bounds of the prefix partitions; each block lists its own words."""
        def key(at: int) -> tuple[bytes, ...]:
            return tuple(names[int(order[column[at]])].as_py() for column in columns)

        cuts = [0]
        for bound in self.bounds:
            cuts.append(bisect_left(range(len(counts)), bound, lo=cuts[-1], key=key))
        cuts.append(len(counts))
        for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a == b:
                continue
            used, place = np.unique(np.concatenate([c[a:b] for c in columns]), return_inverse=True)
            words = names.take(pa.array(order[used])).to_pylist()
            numbers = [*np.split(place, LONGEST), counts[a:b]]
            packed = [b"\n".join(words), *(column.astype("<i4").tobytes() for column in numbers)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([lang]), *(pa.array([x], pa.binary()) for x in packed)],
                ["part", "lang", "words", "w1", "w2", "w3", "n"],
            )


_BLOCKS = "part INT, lang STRING, words BINARY, w1 BINARY, w2 BINARY, w3 BINARY, n BINARY"


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _counted(bounds, entries: int, word_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _Counting(bounds.value, entries, word_bytes)
    for batch in sliced(batches):
        by_lang: defaultdict[str, list[np.ndarray]] = defaultdict(list)
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            listed = tokens(_bytes(text))
            numbers = np.fromiter(map(own.words.__getitem__, listed), np.int64, len(listed))
            by_lang[lang] += [numbers, np.zeros(1, np.int64)]
            if own.full():  # a bound on bytes must hold within a batch, too
                for name, parts in by_lang.items():
                    own.add(name, np.concatenate(parts))
                by_lang.clear()
                yield from own.spilled(everything=True)
        for name, parts in by_lang.items():
            own.add(name, np.concatenate(parts))
        yield from own.spilled(everything=False)
    yield from own.spilled(everything=True)


def _keys(every: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of three words or less at every so many words of each text."""
    mark = ENDS[:1]
    for batch in sliced(batches):
        found = []
        for text in batch["text"]:
            listed = tokens(_bytes(text)) + [mark, mark, mark]
            for at in range(len(listed) % every, len(listed) - 3, every):
                key = listed[at : at + LONGEST]
                key = key[: key.index(mark)] if mark in key else key
                if key:
                    found.append(key + [b""] * (LONGEST - len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], ["key"])


def _bounds(rows: DataFrame, parts: int, n_docs: int) -> list[tuple[bytes, ...]]:
    """Phrases that cut a sample of all phrases into ``parts`` stretches of about the same size.

    The sample follows the number of partitions, not that of texts; it decides where phrases are
    counted, never what is counted.
    """
    share = min(1.0, SAMPLE_DOCS * (parts + 10) / max(1, n_docs))
    sample = rows.sample(share, seed=1).mapInArrow(partial(_keys, SAMPLE_STEP), "key ARRAY<BINARY>")
    keys = sorted(tuple(bytes(word) for word in row["key"]) for row in sample.collect())
    chosen = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    return sorted(set(chosen))


def blocks(
    docs: DataFrame, body: str = "text", lang: str = "lang", entries: int = ENTRIES,
    word_bytes: int = WORD_BYTES, part_words: int = PART_WORDS,
) -> DataFrame:
    """``(part, lang, words, w1, w2, w3, n)``: sorted runs of all tasks, in blocks by prefix partition.

    ``words`` lists a block's words in order, one a line, the first being no word; the other
    columns are little-endian 32-bit numbers, of words in that list and of counts.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.col(body).cast("string").alias("text"),
    )
    n_docs, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, -(-(n_bytes or 0) // (6 * part_words)))  # a word takes about six bytes
    bounds = spark.sparkContext.broadcast(_bounds(rows, parts, n_docs))
    counted = rows.mapInArrow(partial(_counted, bounds, entries, word_bytes), _BLOCKS)
    return counted.repartition(parts, "part")


class _Runs:
    """The sorted runs of one prefix partition and language, merged."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.columns: list[list[np.ndarray]] = [[], [], []]
        self.counts: list[np.ndarray] = []

    def add(self, words: bytes, columns: list[bytes], counts: bytes) -> None:
        base = len(self.words)
        self.words += words.split(b"\n")
        for kept, column in zip(self.columns, columns, strict=True):
            kept.append(np.frombuffer(column, "<i4").astype(np.int64) + base)
        self.counts.append(np.frombuffer(counts, "<i4").astype(np.int64))

    def sums(self, least: int) -> Iterator[tuple[str | None, int, int]]:
        """``(phrase, size, n)`` from ``least`` on and at both ends, where phrases may go on next
        door; and the number of all words, as a phrase of size 0."""
        coded = pa.array(self.words, pa.binary()).dictionary_encode()
        names = coded.dictionary
        order = np.array(pc.sort_indices(names))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[coded.indices.to_numpy()]
        w = [place[np.concatenate(column)] for column in self.columns]
        n = np.concatenate(self.counts)
        bits = max(1, int(len(names) - 1).bit_length())
        if 3 * bits <= 62:
            run = np.argsort(w[0] << 2 * bits | w[1] << bits | w[2], kind="stable")  # merges runs
        else:
            run = np.lexsort(w[::-1])
        w, n = [column[run] for column in w], n[run]
        yield None, 0, int(n.sum())
        new = np.zeros(len(n), bool)
        empty = names.index(b"").as_py()
        none = int(rank[empty]) if empty >= 0 else -1
        for size in range(1, LONGEST + 1):
            new = new | (np.diff(w[size - 1], prepend=-1) != 0)
            starts = np.flatnonzero(new)
            total = np.add.reduceat(n, starts)
            wanted = total >= least
            wanted[[0, -1]] = True
            for at, count in zip(starts[wanted].tolist(), total[wanted].tolist(), strict=True):
                numbers = [int(w[i][at]) for i in range(size)]
                if none not in numbers:
                    words = [names[int(order[k])].as_py().decode() for k in numbers]
                    yield " ".join(words), size, count


_SUMS = "lang STRING, phrase STRING, size INT, n BIGINT"


def _merged(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in the order of their partitions, one partition and language at a time."""
    now, runs = None, _Runs()

    def closed() -> pa.RecordBatch:
        found = [(now[1], *item) for item in runs.sums(least)]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            part, lang, words, *columns, counts = (batch[c][i] for c in batch.schema.names)
            if (key := (part.as_py(), lang.as_py())) != now:
                if now is not None:
                    yield closed()
                now, runs = key, _Runs()
            runs.add(_bytes(words), [_bytes(c) for c in columns], _bytes(counts))
    if now is not None:
        yield closed()


def merged(counted: DataFrame, least: int) -> DataFrame:
    """``(lang, phrase, size, n)``: phrases found at least ``least`` times; of size 0, all words."""
    sums = counted.sortWithinPartitions("part", "lang").mapInArrow(partial(_merged, least), _SUMS)
    return sums.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(
        (F.col("n") >= least) | (F.col("size") == 0)
    )


def _with_counts(parts: DataFrame, known: DataFrame) -> DataFrame:
    """``parts(lang, part, ...)`` with ``count``, also where many candidates share a part."""
    keyed = parts.withColumn("key", F.concat_ws("\n", "lang", "part"))
    total = keyed.select(F.count("*")).scalar()
    shares = keyed.groupBy("key").agg(F.count("*").alias("__uses"))
    counts = known.select(F.concat_ws("\n", "lang", "phrase").alias("key"), F.col("n").alias("count"))
    counts = counts.join(shares, "key").select(
        "key", "count", (F.col("__uses") >= F.greatest(total * HOT_SHARE, F.lit(1000))).alias("hot")
    )
    return join_hot(keyed, counts, "key", F.col("hot"), F.xxhash64("phrase")).drop("key", "hot")


def collocations(
    docs: DataFrame, body: str = "text", lang: str = "lang", least: int = 10, share: int = 50,
    best: int = 2000, entries: int = ENTRIES, word_bytes: int = WORD_BYTES,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``best`` phrases of 2 or 3 words.

    A candidate stands at least ``least`` times; ``a`` is its count, ``l`` and ``r`` those of its two
    parts at the cut that scores lowest, ``n`` the language's words, and the score one million times
    ``a * a / (l * r)``, rounded down. A candidate inside a longer one that has ``share`` percent of
    its count is left out.
    """
    counts = cut(merged(blocks(docs, body, lang, entries, word_bytes, part_words), least))
    totals = counts.filter("size = 0").select("lang", F.col("n").alias("total"))
    known = counts.filter("size > 0")
    candidates = known.filter("size > 1").withColumnRenamed("n", "a")

    words = F.split("phrase", " ")
    sides = F.flatten(F.transform(
        F.sequence(F.lit(1), F.col("size") - 1),
        lambda k: F.array(
            F.struct(k.alias("k"), F.lit(True).alias("left"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("part")),
            F.struct(k.alias("k"), F.lit(False).alias("left"),
                     F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("part")),
        ),
    ))
    parts = candidates.select("lang", "phrase", "size", "a", F.explode(sides).alias("s")).select(
        "lang", "phrase", "size", "a", "s.*"
    )
    cuts = _with_counts(parts, known).groupBy("lang", "phrase", "size", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("count"))).alias("l"),
        F.max(F.when(~F.col("left"), F.col("count"))).alias("r"),
    )
    score = F.expr(
        "CAST((CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))"
        " DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)"
    )
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("c")
    )

    inside = F.filter(
        F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " ")),
        lambda p: F.col("size") == LONGEST,
    )
    longer = (
        candidates.select("lang", F.explode(inside).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    free = lowest.join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"), F.lit(True))
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = free.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= best)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r",
        F.col("total").alias("n"), "score",
    )
