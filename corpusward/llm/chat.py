"""Chat formatting with minimum-cost role repair.

A conversation is legal if its turns run ``[system] user assistant user assistant ...``. Every input
turn is kept, relabelled, or merged into the turn before it, and empty turns may be inserted before
it; each of these has a cost, and a dynamic program over the states of the legal-turn automaton picks
the cheapest repair. Ties go to keeping, then merging, inserting, relabelling, then to the earlier
role in the order system, user, assistant.

What a turn costs depends on its role alone, so a run of turns acts on the states as a matrix of
least costs, and matrices of neighbouring runs combine. Turns are dealt by range of
``(conversation, turn)``: a task holds a bounded run, however long its conversation is. First every
run gives its matrix, then the few runs of each conversation are chained, which fixes the states
between them, then each run is decided on its own. Only roles take part; texts join afterwards by
their place. The result is one row per input turn with its *fragment* of the rendered conversation;
fragments in order are the whole, so no conversation has to fit into one row.

Defined results: turns are ordered by ``turn``, nulls first, ties by role, then text, then place; a
null or unknown role may become any role at a small cost; a null or empty text is an empty turn; a
null conversation id is a conversation of its own; repeated rows are turns of their own; an empty
table gives an empty result; columns other than those named are not read, whatever their names.
Template marks inside a text are broken by a blank, so that no text can open or close a turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusward.llm.rows import PLACE, located
from corpusward.llm.words import whole
from corpusward.session import cut

ROLES = ("system", "user", "assistant")
START = len(ROLES)
_STATES = range(len(ROLES) + 1)
# Which role may follow which state; START is the state before the first turn.
LEGAL = {(START, 0), (START, 1), (0, 1), (1, 2), (2, 1)}
NEVER = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 3
    insert: int = 5
    relabel: int = 8
    unknown: int = 1


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    joiner: str = "\n"
    mark: str = "<|"
    broken: str = "< |"


COSTS, TEMPLATE = Costs(), Template()
FINAL = (1, 2)


@dataclass(frozen=True)
class Step:
    """One turn's move between states."""

    cost: int
    action: str
    inserted: tuple[int, ...] = ()


def _bridges() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest runs of inserted roles that make ``role`` legal after ``state``."""
    out = {}
    for state in _STATES:
        paths: list[tuple[int, ...]] = [()]
        while paths:
            nxt = []
            for path in paths:
                at = path[-1] if path else state
                for role in range(len(ROLES)):
                    if (at, role) in LEGAL:
                        out.setdefault((state, role), path)
                        if len(path) < len(ROLES):
                            nxt.append((*path, role))
            paths = nxt
    return out


@lru_cache(maxsize=64)
def steps(role: int | None, costs: Costs = COSTS) -> dict[tuple[int, int], Step]:
    """The cheapest move for every ``(state, next state)``; ``role`` None is an unknown one."""
    bridges, out = _bridges(), {}
    for state in _STATES:
        for target in range(len(ROLES)):
            label = 0 if role == target else costs.unknown if role is None else costs.relabel
            moves = []
            if state == target:
                moves.append(Step(costs.merge + label, "merge" if not label else "relabel_merge"))
            if (state, target) in bridges:
                added = bridges[state, target]
                moves.append(
                    Step(costs.insert * len(added) + label, "relabel" if label else "keep", added)
                )
            if moves:
                rank = ("keep", "merge", "relabel_merge", "relabel").index
                out[state, target] = min(moves, key=lambda m: (m.cost, len(m.inserted), rank(m.action)))
    return out


def _advance(best: list[int], role: int | None, costs: Costs) -> tuple[list[int], list[int]]:
    """Least cost per state after one more turn, and the state each came from."""
    after, came = [NEVER] * len(_STATES), [-1] * len(_STATES)
    for (state, target), step in steps(role, costs).items():
        cost = best[state] + step.cost
        if best[state] < NEVER and cost < after[target]:
            after[target], came[target] = cost, state
    return after, came


def run_matrix(roles: list[int | None], costs: Costs = COSTS) -> list[list[int]]:
    """Least cost from every state to every state over a run of turns."""
    rows = []
    for state in _STATES:
        best = [0 if s == state else NEVER for s in _STATES]
        for role in roles:
            best, _ = _advance(best, role, costs)
        rows.append(best)
    return rows


def chain(matrices: list[list[list[int]]], final: tuple[int, ...] = FINAL) -> list[tuple[int, int]]:
    """The states ``(before, after)`` of every run on the cheapest way through a conversation."""
    best = [NEVER] * START + [0]
    came = []
    for matrix in matrices:
        after, back = [NEVER] * len(_STATES), [-1] * len(_STATES)
        for state in _STATES:
            for target in _STATES:
                cost = best[state] + matrix[state][target]
                if cost < min(after[target], NEVER):
                    after[target], back[target] = cost, state
        best = after
        came.append(back)
    ends = [s for s in final if best[s] < NEVER] or [s for s in _STATES if best[s] < NEVER]
    at = min(ends, key=lambda s: (best[s], s))
    out = []
    for back in reversed(came):
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


def decide(
    roles: list[int | None], before: int, after: int, costs: Costs = COSTS
) -> list[tuple[int, Step]]:
    """``(role, step)`` per turn of the cheapest way from one state to another."""
    best = [0 if s == before else NEVER for s in _STATES]
    tables = []
    for role in roles:
        best, came = _advance(best, role, costs)
        tables.append(came)
    at, out = after, []
    for role, came in zip(reversed(roles), reversed(tables), strict=True):
        out.append((at, steps(role, costs)[came[at], at]))
        at = came[at]
    return out[::-1]


def _code(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


_PLACED = pa.schema([
    ("run", pa.int64()), ("pos", pa.int64()), ("conv", pa.string()), ("role", pa.string()),
    *((name, kind) for name, kind in zip(PLACE, (pa.string(), pa.int64()), strict=True)),
    ("matrix", pa.list_(pa.int64())),
])


def _placed(costs: Costs):
    """Sorted turns with their run and place in it; a run's last row carries its matrix.

    A run is what one partition holds of one conversation.
    """
    start = [[0 if s == t else NEVER for s in _STATES] for t in _STATES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, matrix = TaskContext.get().partitionId() << 32, None, start
        for batch in batches:
            out = []
            for conv, role, file, row in zip(
                *(batch[c].to_pylist() for c in ("conv", "role", *PLACE)), strict=True
            ):
                if last is not None:
                    ends = last[2] != conv
                    out.append((*last, [c for m in matrix for c in m] if ends else None))
                    number, matrix = (number + 1, start) if ends else (number, matrix)
                    last = (number, 0 if ends else last[1] + 1, conv, role, file, row)
                else:
                    last = (number, 0, conv, role, file, row)
                matrix = [_advance(best, _code(role), costs)[0] for best in matrix]
            yield _batch(out, _PLACED)
        if last is not None:
            yield _batch([(*last, [c for m in matrix for c in m])], _PLACED)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_CHAINED = pa.schema([
    ("run", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("ends", pa.bool_())
])


def _chained(final: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(_STATES)
        for batch in batches:
            out = []
            for runs in batch["runs"].to_pylist():
                matrices = [
                    [m["matrix"][i : i + size] for i in range(0, size * size, size)] for m in runs
                ]
                for one, (before, after) in zip(runs, chain(matrices, final), strict=True):
                    out.append((one["run"], before, after, one is runs[-1]))
            yield _batch(out, _CHAINED)

    return run


def _decided(costs: Costs, template: Template):
    opening = [template.opening.format(role=role) for role in ROLES]
    schema = pa.schema([
        ("run", pa.int64()), ("pos", pa.int64()), *(_PLACED.field(name) for name in PLACE),
        ("repaired", pa.string()), ("action", pa.string()), ("inserted", pa.list_(pa.string())),
        ("prefix", pa.string()), ("suffix", pa.string()),
    ])

    def of_run(rows: list[dict]) -> Iterator[tuple]:
        roles = [_code(r["role"]) for r in rows]
        first = rows[0]
        for i, (row, (role, step)) in enumerate(
            zip(rows, decide(roles, first["before"], first["after"], costs), strict=True)
        ):
            fresh = i == 0 and first["before"] == START
            if step.action in ("merge", "relabel_merge"):
                prefix = template.joiner
            else:
                turns = "".join(opening[r] + template.closing for r in step.inserted)
                prefix = ("" if fresh else template.closing) + turns + opening[role]
            last = row["ends"] and i + 1 == len(rows)
            yield (
                row["run"], row["pos"], *(row[c] for c in PLACE), ROLES[role], step.action,
                [ROLES[r] for r in step.inserted], prefix, template.closing if last else "",
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        held: list[tuple] = []
        for _, one in groupby(rows, key=lambda r: r["run"]):
            held += of_run(list(one))
            if len(held) >= 10_000:
                yield _batch(held, schema)
                held = []
        yield _batch(held, schema)

    return run


def repair(
    turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
    body: str = "text", costs: Costs = COSTS, template: Template = TEMPLATE,
    final: tuple[int, ...] = FINAL,
) -> DataFrame:
    """``(key, order, role, repaired_role, action, inserted, fragment, run, pos)`` per input turn.

    ``action`` is ``keep``, ``merge``, ``relabel`` or ``relabel_merge``; ``inserted`` lists the
    empty turns put before the turn. A conversation's fragments, joined by ``(run, pos)``, are the
    rendered whole.
    """
    rows = located(turns)
    slim = rows.select(
        F.col(key).cast("string").alias("conv"), F.col(order).alias("turn"),
        F.col(role).cast("string").alias("role"), F.xxhash64(F.col(body)).alias("tie"), *PLACE,
    )
    by = ["conv", "turn", F.coalesce("role", F.lit("")), "tie", *PLACE]
    placed = cut(
        slim.repartitionByRange(*by).sortWithinPartitions(*by)
        .select("conv", "role", *PLACE).mapInArrow(
            _placed(costs),
            "run BIGINT, pos BIGINT, conv STRING, role STRING, __file STRING, __row BIGINT, "
            "matrix ARRAY<BIGINT>",
        )
    )
    chained = (
        placed.filter(F.col("matrix").isNotNull()).groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("run", "matrix"))).alias("runs"))
        .select("runs").mapInArrow(_chained(final), "run BIGINT, before BIGINT, after BIGINT, ends BOOLEAN")
    )
    # the exchange comes after the join, which may split a partition of many rows
    decided = (
        placed.drop("matrix", "conv").join(chained, "run")
        .repartition("run").sortWithinPartitions("run", "pos")
        .mapInArrow(
            _decided(costs, template),
            "run BIGINT, pos BIGINT, __file STRING, __row BIGINT, repaired STRING, action STRING, "
            "inserted ARRAY<STRING>, prefix STRING, suffix STRING",
        )
    )
    text = F.replace(whole(F.col(body)), F.lit(template.mark), F.lit(template.broken))
    texts = rows.select(
        F.col(key), F.col(order), F.col(role), text.alias("__text"), *PLACE
    )
    return texts.join(decided, PLACE).select(
        key, order, role, F.col("repaired").alias("repaired_role"), "action", "inserted",
        F.concat("prefix", "__text", "suffix").alias("fragment"), "run", "pos",
    )


def conversations(fragments: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, rendered)``: whole conversations, for those known to fit into one row each."""
    pieces = F.array_sort(F.collect_list(F.struct("run", "pos", "fragment")))
    return fragments.groupBy(key).agg(
        F.array_join(F.transform(pieces, lambda p: p["fragment"]), "").alias("rendered")
    )
