"""Chat formatting with minimum-cost role repair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxframe.llm.common import checkpointed

ROLES = ("system", "user", "assistant")
#: Other names of roles.
NAMES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: States of the automaton: what was said last; START before anything.
START = len(ROLES)
MERGE, RELABEL, GUESS, INSERT = 1.0, 2.0, 0.5, 3.0
#: What may follow: one system message at the start, then user and assistant in turn.
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
FAR = float("inf")


def role_number(role: str | None) -> int:
    """0 to 2, or -1 for an unknown role."""
    name = (role or "").strip().lower()
    name = NAMES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def _step_costs() -> np.ndarray:
    """[before, said]: the least cost of saying a turn next, empty turns put before it if need be."""
    cost = np.full((START + 1, len(ROLES)), FAR)
    for before in range(START + 1):
        for said in range(len(ROLES)):
            if said in FOLLOWS[before]:
                cost[before, said] = 0.0
            elif said == before:
                cost[before, said] = MERGE
        for between in FOLLOWS[before]:
            for said in FOLLOWS[between]:
                cost[before, said] = min(cost[before, said], INSERT)
    return cost


STEP = _step_costs()


def _relabel(role: int, said: int) -> float:
    return GUESS if role < 0 else 0.0 if role == said else RELABEL


def _end_cost(state: int) -> float:
    """A conversation ends with the assistant; an empty turn is put there if need be."""
    return 0.0 if state in (2, START) else INSERT if state == 1 else 2 * INSERT


def transfer(roles: list[int]) -> list[float]:
    """Least costs of the turns from each state before to each state after, row by row."""
    best = np.full((START + 1, START + 1), FAR)
    np.fill_diagonal(best, 0.0)
    for role in roles:
        via = (best[:, :, None] + STEP[None]).min(axis=1)
        best = np.full_like(best, FAR)
        for said in range(len(ROLES)):
            best[:, said] = via[:, said] + _relabel(role, said)
    return best.ravel().tolist()


def borders(matrices: list[list[float]]) -> tuple[list[int], float]:
    """The states before each part and after the last, on a cheapest way through all parts; its cost."""
    cost, back = np.full(START + 1, FAR), []
    cost[START] = 0.0
    for m in matrices:
        through = cost[:, None] + np.array(m).reshape(START + 1, START + 1)
        back.append(through.argmin(axis=0))
        cost = through.min(axis=0)
    total = cost + [_end_cost(s) for s in range(START + 1)]
    state = int(total.argmin())
    states = [state]
    for b in reversed(back):
        state = int(b[state])
        states.append(state)
    return states[::-1], float(total.min())


def product(matrices: list[list[float]]) -> list[float]:
    """Least costs of parts one after the other, as those of one part."""
    whole = np.array(matrices[0]).reshape(START + 1, START + 1)
    for m in matrices[1:]:
        whole = (whole[:, :, None] + np.array(m).reshape(1, START + 1, START + 1)).min(axis=1)
    return whole.ravel().tolist()


def between(matrices: list[list[float]], first: int, last: int) -> list[int]:
    """The states before each part and after the last on a cheapest way from state ``first`` to ``last``."""
    cost, back = np.full(START + 1, FAR), []
    cost[first] = 0.0
    for m in matrices:
        through = cost[:, None] + np.array(m).reshape(START + 1, START + 1)
        back.append(through.argmin(axis=0))
        cost = through.min(axis=0)
    states = [last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def repair(roles: list[int], first: int, last: int) -> list[tuple[str, int]]:
    """What is done with each turn on a cheapest way from state ``first`` to ``last``: (say, merge or insert, role).

    Inserts stand before the turn they are for. Of equal costs, the earlier
    role in ROLES wins, from the last turn back.
    """
    cost = [np.full(START + 1, FAR)]
    cost[0][first] = 0.0
    back = []
    for role in roles:
        through = cost[-1][:, None] + STEP + [_relabel(role, said) for said in range(len(ROLES))]
        back.append(through.argmin(axis=0))
        cost.append(np.append(through.min(axis=0), FAR))
    state, said = last, []
    for b in reversed(back):
        said.append((int(b[state]), state))
        state = int(b[state])
    done = []
    for before, now in reversed(said):
        if now in FOLLOWS[before]:
            done.append(("say", now))
        elif now == before and STEP[before, now] == MERGE:
            done.append(("merge", now))
        else:
            done.append(("insert", next(b for b in FOLLOWS[before] if now in FOLLOWS[b])))
            done.append(("say", now))
    return done


def closing(state: int) -> list[int]:
    """Roles of the empty turns that end a conversation."""
    return {1: [2], 0: [1, 2]}.get(state, [])


def render(done: list[tuple[str, int]], texts: list[str], end: list[int]) -> tuple[str, int]:
    """The text of repaired turns and how many messages begin in it. A merged turn goes on after a line break."""
    parts, said, messages = [], iter(texts), 0
    for what, role in done:
        if what == "merge":
            parts.append("\n" + next(said))
        else:
            parts.append(f"<|{ROLES[role]}|>\n" + (next(said) if what == "say" else ""))
            messages += 1
    parts += [f"<|{ROLES[role]}|>\n" for role in end]
    return "".join(p if p.startswith("\n") or i == 0 else "\n" + p for i, p in enumerate(parts)), messages + len(end)


def _same(left: str, right: str, *keys: str):
    return F.expr(" and ".join(f"{left}.{k} <=> {right}.{k}" for k in keys))


def _crowded_parts(rows: DataFrame, part_turns: int) -> DataFrame:
    """(id, range, cut, turns) of ranges with very many turns, however many are alike.

    Equal turns are counted, so they are one row each; these are put in order
    over all tasks, and a turn's place is what its task holds before it and all
    tasks before hold. Only the turns of one part meet in one row.
    """
    order = ["id", "range", "turn", "role", "text"]
    alike = rows.groupBy(*order).agg(F.count("*").alias("n"))
    placed = alike.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, till = None, 0
        for batch in batches:
            ends = []
            for i, r, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(5).to_pylist(), strict=True):
                till = n + (till if key == (i, r) else 0)
                key = (i, r)
                ends.append(till)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.int64())], [*batch.schema.names, "till"])

    placed = checkpointed(placed.mapInArrow(run, T.StructType([*placed.schema.fields, T.StructField("till", T.LongType())])))
    held = placed.groupBy("id", "range", "task").agg(F.max("till").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("id", "range").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("id", "range", "task", before.alias("before"))
    placed = placed.alias("a").join(held.alias("b"), _same("a", "b", "id", "range", "task")).select("a.*", (F.col("before") + F.col("till")).alias("end"))
    start, cut = F.col("end") - F.col("n"), F.col("cut")
    cuts = placed.withColumn("cut", F.explode(F.sequence(F.floor(start / part_turns), F.floor((F.col("end") - 1) / part_turns))))
    copies = (F.least("end", (cut + 1) * part_turns) - F.greatest(start, cut * part_turns)).cast("int")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", copies.alias("n"))))
    several = F.flatten(F.transform(turns, lambda t: F.array_repeat(F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")), t["n"])))
    return cuts.groupBy("id", "range", "cut").agg(several.alias("turns"))


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = 256, crowd: int = 8192, block_parts: int = 1024) -> DataFrame:
    """(conv_id, part, n_turns, n_messages, first_state, last_state, cost, rendered): repaired conversations.

    Legal is one system message at most, at the start, then user and
    assistant in turn, the assistant last. A turn may be merged with the one
    before it (cost 1), get another role (2; 0.5 if its role is unknown), or
    have an empty turn put before it (3). Dynamic programming over the
    automaton's states finds the cheapest repair of a whole conversation.

    Turn numbers cut a conversation into ranges of ``part_turns``, and a range
    in which numbers repeat is cut again, so a part has no more turns; ranges of
    more than ``crowd`` turns are put in order over many tasks. Each part gives
    a small matrix of least costs between states. The matrices of
    ``block_parts`` parts are multiplied to one (least sums), those of a
    conversation's blocks meet in one task, which fixes the states at the
    blocks' borders, then those within each block are fixed; each part is then
    repaired and rendered by itself. The parts
    in order, joined by "\\n" where a part begins a message, are the
    conversation; cost is the whole conversation's.

    Defined cases: turns are ordered by number, role and text, null first;
    null turn numbers are parts of their own at the start; null or unknown
    roles take the cheapest; null texts are empty; a null id is a
    conversation; repeated rows are turns of their own; an empty table gives
    an empty result; other columns are ignored.
    """
    chosen = df.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranged = chosen.withColumn("range", F.floor(F.col("turn") / part_turns))
    crowded = checkpointed(ranged.groupBy("id", "range").agg(F.count("*").alias("n")).filter(F.col("n") > crowd))
    many = crowded.count()
    calm, parts = ranged, None
    if many:
        few = F.broadcast(crowded) if many <= 100_000 else crowded
        calm = ranged.alias("a").join(few.alias("b"), _same("a", "b", "id", "range"), "left_anti")
        parts = _crowded_parts(ranged.alias("a").join(few.alias("b"), _same("a", "b", "id", "range"), "left_semi"), part_turns)
    place = F.row_number().over(Window.partitionBy("id", "range").orderBy("turn", "role", "text")) - 1
    calm = calm.withColumn("cut", F.floor(place / part_turns)).groupBy("id", "range", "cut").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = calm if parts is None else calm.unionByName(parts)
    parts = checkpointed(parts.select("id", F.struct("range", "cut").alias("part"), F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts")))

    @F.pandas_udf("array<double>")
    def costs(roles):
        return roles.map(lambda r: transfer([role_number(x) for x in r]))

    @F.pandas_udf("array<double>")
    def products(matrices):
        return matrices.map(lambda m: product([list(x) for x in m]))

    @F.pandas_udf("array<double>")
    def ways(matrices):
        def way(m):
            states, cost = borders([list(x) for x in m])
            return [cost, *map(float, states)]

        return matrices.map(way)

    @F.pandas_udf("array<int>")
    def within(matrices, first, last):
        return pd.Series([between([list(x) for x in m], f, z) for m, f, z in zip(matrices, first, last, strict=True)])

    rows = parts.select("id", "part", costs("roles").alias("matrix"))
    numbered = rows.withColumn("number", (F.row_number().over(Window.partitionBy("id").orderBy("part")) - 1).cast("long"))
    blocks = numbered.groupBy("id", F.floor(F.col("number") / block_parts).alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", "part", "matrix"))).alias("all"))
    blocks = checkpointed(blocks.select("id", "block", "all.number", "all.part", "all.matrix").withColumn("whole", products("matrix")))
    top = blocks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("block", "whole"))).alias("all")).select("id", ways("all.whole").alias("way"), F.col("all.block").alias("blocks"))
    at = F.posexplode("blocks").alias("at", "block")
    top = top.select("id", "way", at).select("id", "block", F.col("way")[0].alias("cost"), F.get("way", F.col("at") + 1).cast("int").alias("first"), F.get("way", F.col("at") + 2).cast("int").alias("last"), (F.size("way") == F.col("at") + 3).alias("final"))
    inner = blocks.alias("a").join(top.alias("b"), _same("a", "b", "id", "block")).select("a.id", "number", "part", "cost", "final", within("matrix", "first", "last").alias("states"))
    inner = inner.select("id", "cost", "final", "states", F.posexplode(F.arrays_zip("number", "part")).alias("at", "x"))
    whole = inner.select(F.col("id").alias("__id"), F.col("x.part").alias("__of"), "cost", F.col("x.number").alias("number"), F.get("states", F.col("at")).alias("first"), F.get("states", F.col("at") + 1).alias("last"), (F.col("final") & (F.size("states") == F.col("at") + 2)).alias("ends"))
    joined = parts.join(whole, F.col("id").eqNullSafe(F.col("__id")) & F.col("part").eqNullSafe(F.col("__of"))).drop("__id", "__of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                roles, texts, first, last, ends = (piece.column(i).to_pylist() for i in (2, 3, 5, 6, 7))
                out = [render(repair([role_number(x) for x in r], f, l), t, closing(l) if e else []) for r, t, f, l, e in zip(roles, texts, first, last, ends, strict=True)]
                states = [[[*ROLES, "start"][s] for s in x] for x in (first, last)]
                columns = [piece.column(0), piece.column(1), pa.array(list(map(len, roles)), pa.int64()), pa.array([n for _, n in out], pa.int64()), *map(pa.array, states), piece.column(4), pa.array([t for t, _ in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "part", "n_turns", "n_messages", "first_state", "last_state", "cost", "rendered"])

    kind = chosen.schema["id"].dataType.simpleString()
    done = joined.select("id", "number", "roles", "texts", "cost", "first", "last", "ends").mapInArrow(run, f"id {kind}, part long, n_turns long, n_messages long, first_state string, last_state string, cost double, rendered string")
    return done.withColumnRenamed("id", id_col)
