import itertools
import random
import re

import pytest

from boxframe.llm.chat_format import GUESS, INSERT, MERGE, RELABEL, ROLES, START, between, borders, closing, format_chats, product, repair, role_number, transfer


def brute(roles):
    """Least cost over all assignments of roles, merges and inserts."""
    best = float("inf")
    for said in itertools.product(range(3), repeat=len(roles)):
        cost, state = 0.0, START
        for role, now in zip(roles, said):
            cost += 0.5 if role < 0 else 2.0 * (role != now)
            legal = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
            if now in legal[state]:
                pass
            elif now == state:
                cost += MERGE
            elif any(now in legal[b] for b in legal[state]):
                cost += INSERT
            else:
                cost = float("inf")
            state = now
        best = min(best, cost + {2: 0.0, START: 0.0, 1: INSERT, 0: 2 * INSERT}[state])
    return best


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_parts_give_the_least_cost(cut):
    rng = random.Random(cut)
    for _ in range(150):
        roles = [rng.choice([-1, 0, 1, 1, 2, 2]) for _ in range(rng.randrange(7))]
        parts = [roles[i : i + cut] for i in range(0, len(roles), cut)]
        states, cost = borders([transfer(p) for p in parts])
        assert cost == brute(roles)
        done = [x for p, a, b in zip(parts, states, states[1:]) for x in repair(p, a, b)]
        assert sum(what != "insert" for what, _ in done) == len(roles)
        turns = [role for what, role in done if what != "merge"] + closing(states[-1])
        if turns:
            turns = turns[1:] if turns[0] == 0 else turns
            assert turns == [1, 2] * (len(turns) // 2)


def test_query_repairs_every_conversation(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows, by = df.collect(), {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    small = {(r.conv_id): r for r in format_chats(df).collect()}
    assert small.keys() == by.keys() and sum(r.n_turns for r in small.values()) == len(rows)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r.turn, r.role, r.text))
        roles = [role_number(r.role) for r in turns]
        if len(roles) <= 7:
            assert small[c].cost == brute(roles)
        for r in turns:
            assert r.text in small[c].rendered
    cut = {}
    for r in format_chats(df, part_turns=2).orderBy("part").collect():
        cut.setdefault(r.conv_id, []).append(r)
    for c, parts in cut.items():
        assert {p.cost for p in parts} == {small[c].cost} and sum(p.n_messages for p in parts) == small[c].n_messages
        assert "".join("\n" + p.rendered if i and not p.rendered.startswith("\n") else p.rendered for i, p in enumerate(parts)) == small[c].rendered


def test_hard_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "User ", "b"), (2, 0, None, None), (None, None, "bot", "x"), (3, 0, "system", ""), (4, 0, "assistant", "z" * 200_000), (4, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, cost string")
    got = {r.conv_id: r for r in format_chats(df).collect()}
    assert got[1].rendered == "<|user|>\na\n<|assistant|>\nb" and got[1].cost == RELABEL
    assert got[2].cost == GUESS + INSERT and got[None].rendered == "<|user|>\n\n<|assistant|>\nx"
    assert got[3].rendered == "<|user|>\n\n<|assistant|>\n" and got[4].n_messages == 2
    same = format_chats(df.filter("conv_id = 4").unionByName(df.filter("conv_id = 4")), part_turns=3).orderBy("part").collect()
    assert [(r.part, r.n_turns) for r in same] == [(0, 3), (1, 1)] and {r.cost for r in same} == {2 * RELABEL}
    assert format_chats(df.limit(0)).count() == 0
    assert len(ROLES) == 3


def test_crowded_ranges_and_blocks_give_the_same(spark):
    """Turns without number, equal ones and many of one number, in order over many tasks; few parts in a block."""
    rng = random.Random(9)
    rows = [(None, None, rng.choice(ROLES), rng.choice("abc")) for _ in range(700)] + [(1, 5, rng.choice(ROLES), f"t{rng.randrange(40)}") for _ in range(500)]
    rows += [(1, i, rng.choice([*ROLES, "?"]), str(i)) for i in range(60)] + [(2, i, "user", "x") for i in range(30)] + [(3, 7, "user", "same")] * 300
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(6)
    key = lambda r: tuple((x is not None, x) for x in r)
    plain = sorted(map(tuple, format_chats(df, part_turns=16).collect()), key=key)
    split = sorted(map(tuple, format_chats(df, part_turns=16, crowd=20, block_parts=3).collect()), key=key)
    assert len(plain) > 90
    assert {(r[0], r[6]) for r in plain} == {(r[0], r[6]) for r in split}
    assert [(r[0], r[1], r[2]) for r in plain] == [(r[0], r[1], r[2]) for r in split]
    said = lambda r: re.sub(r"<[|]\w+[|]>", "", r[7]).split()
    assert [said(r) for r in plain] == [said(r) for r in split]


def test_products_of_parts():
    rng = random.Random(2)
    for _ in range(50):
        roles = [rng.choice([-1, 0, 1, 2]) for _ in range(12)]
        parts = [transfer(roles[i : i + 3]) for i in range(0, 12, 3)]
        assert product(parts) == transfer(roles)
        states, cost = borders(parts)
        assert between(parts, states[0], states[-1])[0] == START and borders([product(parts)])[1] == cost


def test_registered_query(spark, sf_dir):
    from boxframe.llm.queries import op2_chat_role_repair

    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {(r.conv_id, r.part): r for r in op2_chat_role_repair(spark, sf_dir).collect()}
    by = {}
    for r in table.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert {c for c, _ in got} == by.keys() and sum(r.n_turns for r in got.values()) == table.count()
    for c, turns in by.items():
        if len(turns) <= 7:
            assert got[c, 0].cost == brute([role_number(role) for _, role, _ in sorted(turns)])
