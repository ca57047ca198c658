"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one ``bigint`` in
which bit ``i`` says that rule ``i`` failed. A policy is a named, versioned mask over these bits:
applying one, comparing several, or asking what a single rule costs (its ablation) reads the ledger
with bitwise operations and never touches a text again.

Everything runs in place, without a shuffle: measurements are array functions within a row. Only
the ablation groups, and it groups on the failure bits (at most ``2 ** len(RULES)`` groups,
combined before the shuffle).

Defined results: a null or empty text has no words and fails ``few_words``; rows with a null or
repeated id are measured like any other, one ledger row each; an empty table gives an empty ledger;
columns of the input other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusward.functions.text import let
from corpusward.llm.words import BLANKS, whole, words

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_exclaims", "n_lines", "n_dup_lines", "n_repeat_words",
)


@dataclass(frozen=True)
class Rule:
    """A named test; ``fails`` is SQL over the measurements."""

    name: str
    fails: str


# The order is the bit order and only ever grows at the end, so old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("exclamations", "2 * n_exclaims > n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of what counts: documents failing any of ``rules`` go."""

    version: str
    rules: tuple[str, ...]

    def mask(self, ledger_rules: Sequence[Rule] = RULES) -> int:
        place = {rule.name: i for i, rule in enumerate(ledger_rules)}
        return sum(1 << place[name] for name in self.rules)


POLICIES = (
    Policy("base-1", BASE),
    Policy("strict-1", tuple(rule.name for rule in RULES)),
)
CURRENT = POLICIES[-1]


def _covered(hashes: Column, window: int) -> Column:
    """Words lying in windows whose hash occurs twice or more, given one hash per window start."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = F.transform(
            s,
            lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]),
        )
        kept = F.filter(F.zip_with(s, same, lambda x, d: F.when(d, x["i"])), lambda i: i.isNotNull())
        return F.sort_array(kept)

    def spread(p: Column) -> Column:
        steps = F.transform(
            p, lambda x, k: F.least(F.lit(window), F.coalesce(x - F.get(p, k - 1), F.lit(window)))
        )
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    return let(let(placed, starts), spread)


def repeat_words(found: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in ``window``-word windows that occur twice or more.

    Windows are compared by 64-bit hashes of 64-bit word hashes. Documents without a repeated
    window, the usual case, only pay for the distinct count.
    """
    def count(per_word: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(per_word) - window),
            lambda i: F.xxhash64(*[F.get(per_word, i + k) for k in range(window)]),
        )
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, window))
            .otherwise(F.lit(0).cast("bigint")),
        )

    return F.when(
        F.size(found) > window, let(F.transform(found, lambda w: F.xxhash64(w)), count)
    ).otherwise(F.lit(0).cast("bigint"))


def measured(text: Column) -> Column:
    """All measurements of a text as one struct."""
    body = whole(text)

    def of(found: Column) -> Column:
        lines = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
        without = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
        return let(
            lines,
            lambda ls: F.struct(
                F.size(found).cast("bigint").alias("n_words"),
                F.length(F.array_join(found, "")).cast("bigint").alias("word_chars"),
                without(SYMBOLS).cast("bigint").alias("n_symbols"),
                without("!").cast("bigint").alias("n_exclaims"),
                F.size(ls).cast("bigint").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
                repeat_words(found).alias("n_repeat_words"),
            ),
        )

    return let(words(text), of)


def failure_bits(rules: Sequence[Rule] = RULES) -> Column:
    """Bit ``i`` is set if rule ``i`` fails; reads the measurement columns."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("bigint")


def ledger(
    docs: DataFrame, key: str = "doc_id", body: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``(key, measurements, failed)``: one row per document."""
    rows = docs.select(F.col(key), measured(F.col(body)).alias("__m"))
    return rows.select(key, *[F.col(f"__m.{m}").alias(m) for m in MEASURES]).withColumn(
        "failed", failure_bits(rules)
    )


def passes(failed: Column, policy: Policy = CURRENT, rules: Sequence[Rule] = RULES) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) == 0


def verdicts(
    rows: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """The ledger with a column ``kept_<version>`` per policy."""
    return rows.select(
        "*", *[passes(F.col("failed"), p, rules).alias(f"kept_{p.version}") for p in policies]
    )


def ablations(
    rows: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``(version, rule, failing, only, dropped, kept_without)`` per policy and rule of it.

    ``only`` counts documents which this rule alone drops, so ``kept_without`` is what the policy
    would keep if the rule were taken out.
    """
    patterns = rows.groupBy("failed").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n")).otherwise(zero)), zero)
    place = {rule.name: i for i, rule in enumerate(rules)}
    aggregates, outputs = [], []
    for p, policy in enumerate(policies):
        held = F.col("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("bigint"))
        aggregates += [count(held != 0).alias(f"d{p}"), count(held == 0).alias(f"k{p}")]
        for name in policy.rules:
            bit = 1 << place[name]
            aggregates += [
                count(held.bitwiseAND(F.lit(bit).cast("bigint")) != 0).alias(f"f{p}_{name}"),
                count(held == bit).alias(f"o{p}_{name}"),
            ]
            outputs.append(F.struct(
                F.lit(policy.version).alias("version"), F.lit(name).alias("rule"),
                F.col(f"f{p}_{name}").alias("failing"), F.col(f"o{p}_{name}").alias("only"),
                F.col(f"d{p}").alias("dropped"),
                (F.col(f"k{p}") + F.col(f"o{p}_{name}")).alias("kept_without"),
            ))
    return patterns.agg(*aggregates).select(F.inline(F.array(*outputs)))


def keep_passing(docs: DataFrame, body: str = "text", policy: Policy = CURRENT) -> DataFrame:
    """Rows of ``docs``, unchanged, whose text passes the policy."""
    columns = docs.columns
    rows = docs.withColumn("__m", measured(F.col(body)))
    names = {m: f"__m.{m}" for m in MEASURES}
    fails = [_prefixed(rule.fails, names) for rule in RULES]
    bits = failure_bits([Rule(r.name, f) for r, f in zip(RULES, fails, strict=True)])
    return rows.filter(passes(bits, policy)).select(*columns)


def _prefixed(expression: str, names: dict[str, str]) -> str:
    return " ".join(names.get(part, part) for part in expression.split(" "))
