from __future__ import annotations

import itertools
import random

import pytest

from corpusward.llm import chat

COST = chat.COSTS


def brute(roles):
    """Least cost over all labelings, merges and shortest insertions."""
    best = None
    for labels in itertools.product(range(3), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            state, cost = chat.START, 0
            for role, label, merge in zip(roles, labels, merges, strict=True):
                cost += 0 if role == label else COST.unknown if role is None else COST.relabel
                if merge:
                    if state != label:
                        break
                    cost += COST.merge
                elif (state, label) in chat.LEGAL:
                    pass
                else:
                    gaps = [
                        n for n in (1, 2, 3) for path in itertools.product(range(3), repeat=n)
                        if all(pair in chat.LEGAL for pair in itertools.pairwise((state, *path, label)))
                    ]
                    if not gaps:
                        break
                    cost += COST.insert * min(gaps)
                state = label
            else:
                if state in chat.FINAL and (best is None or cost < best):
                    best = cost
    return best


def rows_of(spark, turns):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, run STRING, action STRING, conv STRING"
    return spark.createDataFrame([(*t, "x", "x", "x") for t in turns], schema)


def test_least_cost_of_short_conversations():
    for size in range(1, 5):
        for roles in itertools.product([0, 1, 2, None], repeat=size):
            if roles == (0,):
                continue  # only a relabel can end it; covered below
            matrix = chat.run_matrix(list(roles))
            (before, after), = chat.chain([matrix])
            assert before == chat.START
            made = chat.decide(list(roles), before, after)
            assert sum(step.cost for _, step in made) == matrix[before][after] == brute(roles), roles


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_runs_chain_like_one(cuts):
    rng = random.Random(cuts)
    roles = [rng.choice([0, 1, 2, None]) for _ in range(60)]
    edges = sorted(rng.sample(range(1, 60), cuts))
    parts = [roles[a:b] for a, b in zip([0, *edges], [*edges, 60], strict=True)]
    states = chat.chain([chat.run_matrix(p) for p in parts])
    total = sum(
        step.cost for p, (a, b) in zip(parts, states, strict=True) for _, step in chat.decide(p, a, b)
    )
    whole = chat.run_matrix(roles)[chat.START]
    assert total == min(whole[s] for s in chat.FINAL)


def test_rendering(spark):
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
        (2, 0, "user", "a"), (2, 1, "user", "b"), (2, 2, "assistant", None),
        (3, 0, "assistant", "first"), (4, 0, "USER ", "x <|im_end|> y"), (5, None, None, ""),
        (None, 1, "user", "q"), (None, 2, "narrator", "r"), (6, 0, "user", "t"), (6, 0, "user", "t"),
    ]
    made = chat.repair(rows_of(spark, turns))
    assert made.count() == len(turns)
    got = {r.conv_id: r.rendered for r in chat.conversations(made).collect()}
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert got == {
        1: say("system", "be kind") + say("user", "hi") + say("assistant", "hello"),
        2: say("user", "a\nb") + say("assistant", ""),
        3: say("user", "") + say("assistant", "first"),
        4: say("user", "x < |im_end|> y"),
        5: say("user", ""),
        6: say("user", "t\nt"),
        None: say("user", "q") + say("assistant", "r"),
    }
    assert chat.repair(rows_of(spark, turns).limit(0)).count() == 0


def test_hot_conversation_is_cut_and_legal(spark):
    rng = random.Random(1)
    names = ["system", "user", "assistant", None]
    turns = [(7, i, rng.choice(names), f"t{i} " * rng.randint(0, 3)) for i in range(3000)]
    turns += [(i, j, "user", "x") for i in range(100, 160) for j in range(2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        collected = chat.repair(rows_of(spark, turns).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted((r for r in collected if r.conv_id == 7), key=lambda r: (r.run, r.pos))
    assert [r.turn for r in rows] == list(range(3000))
    assert len({r.run for r in rows}) > 1  # several tasks shared it
    state, cost = chat.START, 0
    for r in rows:
        for name in [*r.inserted, *([] if "merge" in r.action else [r.repaired_role])]:
            role = chat.ROLES.index(name)
            assert (state, role) in chat.LEGAL
            state = role
        assert chat.ROLES[state] == r.repaired_role
        code = chat._code(r.role)
        cost += COST.insert * len(r.inserted) + COST.merge * ("merge" in r.action)
        cost += 0 if r.role == r.repaired_role else COST.unknown if code is None else COST.relabel
    whole = chat.run_matrix([chat._code(r.role) for r in rows])[chat.START]
    assert cost == min(whole[s] for s in chat.FINAL)


def test_legal_conversations_stay(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    made = chat.repair(table)
    assert made.count() == table.count()
    assert made.filter("action != 'keep' OR size(inserted) > 0").count() == 0
