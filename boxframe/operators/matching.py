"""Matching of boxes and comparison of reactions.

A reaction is an array of box structs in the order reactants, conditions,
products; a box's place in that array is its number. ``kept`` arrays name
the boxes that are still in a role, so boxes taken out by the removal of
duplicates can still be matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.functions.geometry import Box, iou
from boxframe.schemas import BOX, CONDITION, MATCH_IOU, MOL, PRODUCT, REACTANT, ROLES


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def overlap(a: Column, b: Column, match_category: bool = False, digits: int | None = None) -> Column:
    value = iou(Box.of(a), Box.of(b), digits)
    return F.when(a["category_id"] != b["category_id"], F.lit(0.0)).otherwise(value) if match_category else value


def box_match(left: Column, right: Column, threshold: float = MATCH_IOU, match_category: bool = False, digits: int | None = None) -> Column:
    """For each left box, (place of the right box with the largest IoU or -1, that IoU).

    Of equal IoUs the first place wins; below ``threshold`` there's no match.
    Right boxes may match several left ones.
    """

    def best(scores: Column) -> Column:
        most = F.array_max(scores)
        place = F.when(most >= threshold, F.array_position(scores, most) - 1).otherwise(F.lit(-1))
        return F.struct(F.coalesce(place, F.lit(-1)).cast("long").alias("place"), F.coalesce(most, F.lit(0.0)).alias("iou"))

    return F.transform(left, lambda a: let(F.transform(right, lambda b: overlap(a, b, match_category, digits)), best))


def reactions(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each reaction with its array of boxes, from rows with ``keys``, role, box_idx and corners."""
    box = F.struct(F.col("role").cast("long").alias("role"), F.col("box_idx").cast("long").alias("idx"), F.col("category_id").cast("long").alias("category_id"), "x1", "y1", "x2", "y2")
    return boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias("boxes"))


def role_places(boxes: Column, role: int, mol_only: bool = False, kept: Column | None = None) -> Column:
    """Places of the boxes in a role that a comparison looks at.

    With ``mol_only`` those of other categories are left out; reactants and
    products of which none would be left are all looked at.
    """
    def places(mol: bool) -> Column:
        def inside(b: Column, i: Column) -> Column:
            wanted = b["role"] == role
            if kept is not None:
                wanted = wanted & F.array_contains(kept, i.cast("long"))
            return wanted & (b["category_id"] == MOL) if mol else wanted

        return F.filter(F.transform(boxes, lambda b, i: F.when(inside(b, i), i.cast("long"))), lambda i: i.isNotNull())

    if not mol_only:
        return places(False)
    return places(True) if role == CONDITION else let(places(True), lambda mols: F.when(F.size(mols) == 0, places(False)).otherwise(mols))


def prepared(boxes: Column, mol_only: bool = False, merge_condition: bool = False, kept: Column | None = None) -> Column:
    """What a comparison needs of a reaction, to be worked out once: its boxes, and places to look at by role.

    With ``merge_condition`` reactants and conditions are one role.
    """
    places = [role_places(boxes, r, mol_only, kept) for r in range(len(ROLES))]
    if merge_condition:
        places = [F.sort_array(F.concat(places[REACTANT], places[CONDITION])), places[PRODUCT]]
    return F.struct(boxes.alias("boxes"), F.array(*places).alias("places"), F.array(*(F.size(p) for p in places)).alias("sizes"))


def equal(left: Column, right: Column, digits: int | None = None) -> Column:
    """Whether two prepared reactions are equal, the left one's boxes against the right one's.

    Roles of unequal size decide before any overlap is computed, and the first
    role that differs before the next one is looked at.
    """

    def best(box: Column) -> Column:
        return let(F.transform(right["boxes"], lambda b: overlap(box, b, digits=digits)), lambda scores: let(F.array_max(scores), lambda most: F.when(most >= MATCH_IOU, F.array_position(scores, most) - 1).otherwise(F.lit(-1).cast("long"))))

    def same(role: Column) -> Column:
        found = F.sort_array(F.transform(F.get(left["places"], role), lambda k: best(F.get(left["boxes"], k.cast("int")))))
        return found == F.get(right["places"], role)

    none = F.forall(left["sizes"], lambda n: n == 0)
    return F.when((left["sizes"] != right["sizes"]) | none, F.lit(False)).otherwise(F.forall(F.sequence(F.lit(0), F.size(left["sizes"]) - 1), same))


def compare(left: Column, right: Column, mol_only: bool = False, merge_condition: bool = False, left_kept: Column | None = None, right_kept: Column | None = None, digits: int | None = None) -> Column:
    """Whether the left reaction equals the right one.

    Both have as many boxes to look at, one at least; each of the left one's
    matches a box of the right one, and role by role these are just the right
    one's. The match is over all boxes of the right reaction. With
    ``merge_condition`` reactants and conditions are one role.
    """
    sides = F.struct(prepared(left, mol_only, merge_condition, left_kept).alias("l"), prepared(right, mol_only, merge_condition, right_kept).alias("r"))
    return let(sides, lambda s: equal(s["l"], s["r"], digits))


# What a mode of evaluation compares.
MODES = {"exact": {}, "soft": {"mol_only": True, "merge_condition": True}, "mol_only": {"mol_only": True}}


def counted(gold: Column, pred: Column, digits: int | None = None) -> Column:
    """Hits and totals of the two sides (gold_hits, gold_total, pred_hits, pred_total) from arrays of prepared reactions; each pair is compared once."""
    any_row = lambda m: F.size(F.filter(m, lambda row: F.array_contains(row, True)))
    any_column = lambda m, p: F.size(F.filter(F.sequence(F.lit(0), F.size(p)), lambda j: F.exists(m, lambda row: F.coalesce(F.get(row, j), F.lit(False)))))

    def both(s: Column) -> Column:
        same = F.transform(s["g"], lambda x: F.transform(s["p"], lambda y: equal(x, y, digits)))
        numbers = lambda m: {"gold_hits": any_row(m), "gold_total": F.size(s["g"]), "pred_hits": any_column(m, s["p"]), "pred_total": F.size(s["p"])}
        return let(same, lambda m: F.struct(*(c.cast("long").alias(n) for n, c in numbers(m).items())))

    return let(F.struct(gold.alias("g"), pred.alias("p")), both)


def image_counts(gold: DataFrame, pred: DataFrame, images: DataFrame, image: list[str], mode: str = "exact", digits: int | None = None) -> DataFrame:
    """Rows of ``images`` with hits and totals of both sides: gold_hits, gold_total, pred_hits, pred_total.

    Both sides' reactions of an image come together in one row by an equi-join
    on the image alone, so nothing is shuffled by reaction or pair; each pair
    is compared once. Only numbers are then joined to the images; images
    without reactions count 0.
    """
    ready = prepared(F.col("boxes"), **MODES[mode])
    arrays = [side.select(*image, ready.alias(name)).groupBy(*image).agg(F.collect_list(name).alias(name)) for side, name in ((gold, "g"), (pred, "p"))]
    none = F.expr(f"cast(array() as array<struct<boxes:array<{BOX}>,places:array<array<bigint>>,sizes:array<int>>>)")
    both = arrays[0].join(arrays[1], image, "full").withColumns({c: F.coalesce(c, none) for c in "gp"})
    counts = both.select(*image, counted(F.col("g"), F.col("p"), digits).alias("h")).select(*image, "h.*")
    return images.join(counts, image, "left").select(*images.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts.columns if c not in image))


def hits(gold: DataFrame, pred: DataFrame, image: list[str], digits: int | None = None, modes: tuple[str, ...] = ("exact", "soft")) -> DataFrame:
    """(image, side, rxn_id, one hit flag for each mode) for each reaction of either side.

    ``exact`` compares all boxes role by role; ``soft`` only molecules, with
    reactants and conditions as one role. A reaction is hit if it equals any
    of the other side in its image, gold always on the left. Images meet by
    an equi-join, so Catalyst picks the strategy; every pair is compared once
    for all modes.
    """
    g, p = gold.select(*image, F.col("rxn_id").alias("g"), F.col("boxes").alias("gb")), pred.select(*image, F.col("rxn_id").alias("p"), F.col("boxes").alias("pb"))
    g, p = (side.select(*image, c[0], *(prepared(F.col(c), **MODES[m]).alias(f"{c[0]}_{m}") for m in modes)) for side, c in ((g, "gb"), (p, "pb")))
    pairs = g.join(p, image).select(*image, "g", "p", *(equal(F.col(f"g_{m}"), F.col(f"p_{m}"), digits).alias(m) for m in modes))
    either = F.inline(F.array(F.struct(F.lit("gold").alias("side"), F.col("g").alias("rxn_id")), F.struct(F.lit("pred").alias("side"), F.col("p").alias("rxn_id"))))
    flagged = pairs.select(*image, *modes, either).groupBy(*image, "side", "rxn_id").agg(*(F.max(m).alias(m) for m in modes))
    every = gold.select(*image, F.lit("gold").alias("side"), "rxn_id").unionByName(pred.select(*image, F.lit("pred").alias("side"), "rxn_id"))
    return every.join(flagged, [*image, "side", "rxn_id"], "left").select(*image, "side", "rxn_id", *(F.coalesce(m, F.lit(False)).alias(m) for m in modes))
