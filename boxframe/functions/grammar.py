"""The grammar of reaction sequences: a small automaton as nested conditions.

A state is "section,slot": the section a token was said in and its place in
a box (x1, y1, x2, y2, c) or e for the section's end token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxframe.functions.tokens import Vocabulary

START = "Rxn,e"
# The order of places in a box, and what follows the end of each section.
SLOTS = {"x1": "y1", "y1": "x2", "x2": "y2", "y2": "c"}
AFTER_END = {"Rxn": ("Rct", "EOS"), "Rct": ("Cnd", "Cnd"), "Cnd": ("Prd", None), "Prd": (None, "Rxn")}
SECTIONS = ("Rct", "Cnd", "Prd")


#: Every state, and the kinds of tokens that the grammar tells apart: others, coordinates (of x, y, both), special ones by name.
STATES = [f"{section},{slot}" for section in (*AFTER_END, "EOS") for slot in (*SLOTS, "c", "e")]
COORDINATES, NAMED = (1, 2, 3), ("<eos>", "[Rxn]", "[Rct]", "[Cnd]", "[Prd]", "[Nos]", "[Idt]", "[Mol]", "[Txt]", "[Sup]")
KINDS = 1 + len(COORDINATES) + len(NAMED)


def _kind(v: Vocabulary, token: Column) -> Column:
    x, y = v.is_x(token), v.is_y(token)
    out = F.when(x & y, 3).when(x, 1).when(y, 2)
    for i, name in enumerate(NAMED):
        out = out.when(token == v[name], 1 + len(COORDINATES) + i)
    return out.otherwise(0)


def _following(state: str, kind: int) -> str:
    """State after a token of a kind."""
    section, slot = state.split(",")
    if slot in SLOTS:
        return f"{section},{SLOTS[slot]}"
    if slot == "c":
        return f"{section},x1" if kind in COORDINATES else f"{section},e"
    if section not in AFTER_END:
        return state
    boxes, end = AFTER_END[section]
    if boxes and end:
        return f"{boxes},x1" if kind in COORDINATES else f"{end},e"
    return f"{boxes},x1" if boxes else f"{end},e"


def _allowed(state: str, kind: int) -> bool:
    """Whether a token of a kind may be said in a state: ``allowed`` for the table."""
    section, slot = state.split(",")
    x, y, one = kind in (1, 3), kind in (2, 3), lambda *names: kind > 3 and NAMED[kind - 4] in names
    if slot == "y1":
        return x
    if slot in ("x1", "x2"):
        return y
    if slot == "y2":
        return one("[Idt]", "[Mol]", "[Txt]", "[Sup]")
    if slot == "c":
        return x or (section in SECTIONS and one(f"[{section}]"))
    more = {"Rct": (x, "[Cnd]"), "Cnd": (x,), "Prd": (False, "[Rxn]", "[Nos]"), "Rxn": (x, "<eos>")}.get(section, (False, "<eos>"))
    return more[0] or one(*more[1:])


def _said(v: Vocabulary, tokens: Column, say) -> Column:
    """What ``say(state, kind, next state)`` has for each token, one after another, from the start state on: a fold that looks up numbers."""
    cells = [(s, k, _following(s, k)) for s in STATES for k in range(KINDS)]
    after = F.expr(f"array({', '.join(str(STATES.index(n)) for _, _, n in cells)})")
    text = F.expr("array({})".format(", ".join(f"'{say(*c)}'" for c in cells)))

    def step(done: Column, kind: Column) -> Column:
        cell = done["s"] * KINDS + kind
        return F.struct(F.get(after, cell).alias("s"), F.concat(done["out"], F.get(text, cell)).alias("out"))

    start = F.struct(F.lit(STATES.index(START)).alias("s"), F.lit("").alias("out"))
    return F.aggregate(F.transform(tokens, lambda t: _kind(v, t)), start, step, lambda done: done["out"])


def states(v: Vocabulary, tokens: Column) -> Column:
    """States after each token of an array, from the start state on."""
    names = F.split(F.ltrim(_said(v, tokens, lambda state, kind, after: f" {after}")), " ")
    return F.when(F.size(tokens) == 0, F.expr("cast(array() as array<string>)")).otherwise(names)


def allowed_each(v: Vocabulary, tokens: Column) -> Column:
    """A text with 1 for each token of an array that ``allowed`` lets follow those before, else 0."""
    return _said(v, tokens, lambda state, kind, after: str(int(_allowed(state, kind))))


def allowed(v: Vocabulary, state: Column, token: Column) -> Column:
    """Whether a token may be said in a state."""
    section, slot = F.substring_index(state, ",", 1), F.substring_index(state, ",", -1)
    one = lambda *names: token.isin([v[n] for n in names])
    x, y = v.is_x(token), v.is_y(token)
    closer = F.lit(False)
    for s in SECTIONS:
        closer = F.when(section == s, one(f"[{s}]")).otherwise(closer)
    after = F.when(section == "Rct", x | one("[Cnd]")).when(section == "Cnd", x).when(section == "Prd", one("[Rxn]", "[Nos]")).when(section == "Rxn", x | one("<eos>")).otherwise(one("<eos>"))
    return F.when(slot == "y1", x).when(slot.isin("x1", "x2"), y).when(slot == "y2", one("[Idt]", "[Mol]", "[Txt]", "[Sup]")).when(slot == "c", x | closer).otherwise(after)


def output_mask(v: Vocabulary, state: Column) -> Column:
    """For each token id, whether it's forbidden next."""
    return F.transform(F.sequence(F.lit(0), F.lit(v.size - 1)), lambda t: ~allowed(v, state, t))
