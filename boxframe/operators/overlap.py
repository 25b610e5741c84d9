"""Matching, hits and removal of duplicates for images of any number of boxes: an overlap join by grid cells.

``matching`` and ``dedup`` hold an image's boxes in one row, which is best for
pages. Here boxes are rows, pairs that overlap meet in the cell of a grid, and
no task holds an image. Results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.operators import batches
from boxframe.operators.dedup import has_role, kept_boxes
from boxframe.operators.matching import MODES, equal, overlap, prepared
from boxframe.schemas import MATCH_IOU, PRODUCT, REACTANT
from boxframe.storage import written

#: Cells of a level have sides of two to its power; those of the last one are a whole image.
FINEST, COARSEST = -8, 0
#: Boxes of both sides up to which an image, or what else pairs are made in, is a single cell.
FEW = 64


def _cell(value: Column, level: Column) -> Column:
    """The cell that holds a coordinate. Those of the border also hold what lies beyond, so a box has a bounded number of cells."""
    scale = F.pow(F.lit(2.0), -level)
    return F.floor(F.least(F.greatest(value * scale, -scale), 2 * scale)).cast("int")


def _in_cells(df: DataFrame, box: str, level: str, many: Column) -> DataFrame:
    """Rows of ``df`` in the cells of their own level (cells as large as the box) and of all coarser ones; of the coarsest alone, if there aren't ``many``.

    A box has up to four cells at a level. Boxes without corners, or with
    corners in the wrong order, overlap nothing and have no cells.
    """
    b = F.col(box)
    corners = [b[c] for c in ("x1", "y1", "x2", "y2")]
    real = (b["x1"] <= b["x2"]) & (b["y1"] <= b["y2"])
    for c in corners:
        real = real & c.isNotNull() & ~F.isnan(c.cast("double"))
    side = F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"])
    own = F.least(F.greatest(F.ceil(F.log2(F.when(side > 0, side))), F.lit(FINEST)), F.lit(COARSEST))
    own = F.when(many, own).otherwise(F.lit(COARSEST)).cast("int")

    def at(n: Column) -> Column:
        across, down = (F.sequence(_cell(b[f"{c}1"], n), _cell(b[f"{c}2"], n)) for c in "xy")
        return F.flatten(F.transform(across, lambda x: F.transform(down, lambda y: F.struct(n.alias("n"), x.alias("x"), y.alias("y")))))

    placed = df.filter(real).withColumn(level, own)
    cells = F.flatten(F.transform(F.sequence(F.col(level), F.lit(COARSEST)), at))
    return placed.withColumn("__cell", F.explode(cells)).withColumns({"__n": F.col("__cell.n"), "__x": F.col("__cell.x"), "__y": F.col("__cell.y")}).drop("__cell")


def _crowded(by: Sequence[str], *sides: DataFrame, n: Column | None = None) -> DataFrame:
    """(by, __many): groups with more than ``FEW`` boxes; ``n`` is how many a row has, if not one."""
    rows = [side.select(*by, (F.lit(1) if n is None else n).alias("__k")) for side in sides]
    return rows[0].unionByName(rows[1]).groupBy(*by).agg(F.sum("__k").alias("__many")).filter(F.col("__many") > FEW)


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], a: str = "a", b: str = "b", crowded: DataFrame | None = None) -> DataFrame:
    """Each pair of rows with equal ``by`` whose boxes (struct columns ``a`` and ``b``) share a point, once.

    Other columns of the two sides have names of their own. A pair meets at
    the level of its larger box, in the one cell with the corner of what the
    boxes share. So a pair isn't made twice, and rows are shuffled by cell:
    many tasks share an image, unless it has ``FEW`` boxes, when each of them
    is one row in the coarsest cell and not one in each level's. Whoever has
    counted the boxes before they were rows gives the ``crowded`` groups. Boxes are best normalised by their image;
    others are right but meet in fewer cells. Many boxes at one and the same
    place overlap each other, and are paired in one task.
    """
    crowded = _crowded(by, left, right) if crowded is None else crowded
    left, right = (side.join(crowded, list(by), "left") for side in (left, right))
    many = F.col("__many").isNotNull()
    pairs = _in_cells(left, a, "__la", many).drop("__many").join(_in_cells(right, b, "__lb", many).drop("__many"), [*by, "__n", "__x", "__y"])
    p, q = F.col(a), F.col(b)
    corner = {c: F.greatest(p[f"{c}1"], q[f"{c}1"]) for c in "xy"}
    once = F.greatest("__la", "__lb") == F.col("__n")
    for c in "xy":
        once = once & (corner[c] <= F.least(p[f"{c}2"], q[f"{c}2"])) & (_cell(corner[c], F.col("__n")) == F.col(f"__{c}"))
    return pairs.filter(once).drop("__la", "__lb", "__n", "__x", "__y")


def best_matches(left: DataFrame, right: DataFrame, by: Sequence[str], threshold: float = MATCH_IOU, match_category: bool = False, digits: int | None = None) -> DataFrame:
    """``matching.box_match`` for boxes that are rows: ``left`` with place and iou.

    Rows have ``by``, place (unique in its group) and box, a struct; left ones
    may have more columns. place_found is the place of the right box with the
    largest IoU, the first of equal ones, or -1 below ``threshold``, which is
    above 0; iou is that IoU, 0 without any.
    """
    if threshold <= 0:
        raise ValueError("boxes that share nothing don't meet, so the threshold is above 0")
    pairs = overlapping(left.select(*by, F.col("place").alias("__l"), F.col("box").alias("a")), right.select(*by, F.col("place").alias("__r"), F.col("box").alias("b")), by)
    score = overlap(F.col("a"), F.col("b"), match_category, digits)
    best = pairs.groupBy(*by, "__l").agg(F.max(F.struct(score.alias("iou"), (-F.col("__r")).alias("r"))).alias("__best")).withColumnRenamed("__l", "place")
    found = left.join(best, [*by, "place"], "left")
    place = F.when(F.col("__best.iou") >= threshold, -F.col("__best.r")).otherwise(F.lit(-1))
    return found.select(*left.columns, place.cast("long").alias("place_found"), F.coalesce("__best.iou", F.lit(0.0)).alias("iou"))


def _looked_at(ready: Column) -> Column:
    """(role, place) of the boxes that a comparison looks at, in order."""
    return F.sort_array(F.flatten(F.transform(ready["places"], lambda places, role: F.transform(places, lambda i: F.struct(role.cast("int").alias("role"), i.cast("long").alias("place"))))))


def equal_pairs(left: DataFrame, right: DataFrame, image: Sequence[str], mode: str = "exact", with_kept: bool = False, earlier: bool = False, digits: int | None = None) -> DataFrame:
    """(image, l, r): reactions of the two sides that are equal by ``matching.compare``, left against right.

    Rows have image, rxn_id, boxes, and kept if asked; ``earlier`` asks for
    pairs with l < r only. Reactions that are equal have boxes that overlap,
    so those pairs alone are compared.
    """
    kept = F.col("kept") if with_kept else None
    l, r = (side.select(*image, F.col("rxn_id").alias(n), prepared(F.col("boxes"), kept=kept, **MODES[mode]).alias("q")).withColumn("look", _looked_at(F.col("q"))) for side, n in ((left, "l"), (right, "r")))
    a = l.select(*image, "l", F.size("look").alias("n"), "q", F.explode("look").alias("at")).select(*image, "l", "n", "at.role", F.col("at.place").alias("lp"), F.get("q.boxes", F.col("at.place").cast("int")).alias("a"))
    b = r.select(*image, "r", F.posexplode("q.boxes").alias("rp", "b"))
    pairs = overlapping(a, b, image, crowded=_crowded(image, left, right, n=F.size("boxes")))
    if earlier:
        pairs = pairs.filter("l < r")
    score = overlap(F.col("a"), F.col("b"), digits=digits)
    best = pairs.groupBy(*image, "l", "r", "n", "role", "lp").agg(F.max(F.struct(score.alias("iou"), (-F.col("rp").cast("long")).alias("rp"))).alias("m")).filter(F.col("m.iou") >= MATCH_IOU)
    found = best.groupBy(*image, "l", "r", "n").agg(F.sort_array(F.collect_list(F.struct("role", (-F.col("m.rp")).alias("place")))).alias("found")).filter(F.size("found") == F.col("n"))
    wanted = r.select(*image, "r", "look")
    return found.join(wanted, [*image, "r"]).filter(F.col("found") == F.col("look")).select(*image, "l", "r")


def hits(gold: DataFrame, pred: DataFrame, image: Sequence[str], mode: str = "exact", digits: int | None = None) -> DataFrame:
    """(image, side, rxn_id, hit) as ``matching.hits`` has them, by ``equal_pairs``."""
    either = F.inline(F.array(F.struct(F.lit("gold").alias("side"), F.col("l").alias("rxn_id")), F.struct(F.lit("pred").alias("side"), F.col("r").alias("rxn_id"))))
    flagged = equal_pairs(gold, pred, image, mode, digits=digits).select(*image, either).distinct().withColumn("hit", F.lit(True))
    every = gold.select(*image, F.lit("gold").alias("side"), "rxn_id").unionByName(pred.select(*image, F.lit("pred").alias("side"), "rxn_id"))
    return every.join(flagged, [*image, "side", "rxn_id"], "left").select(*image, "side", "rxn_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def _by_crowd(rxns: DataFrame, image: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """``rxns`` of images with up to ``FEW`` boxes, and those of the others, if there are any; images without a key are among these."""
    table = written(rxns, "reactions")
    unknown = F.lit(False)
    for c in image:
        unknown = unknown | F.col(c).isNull()
    crowded = table.groupBy(*image).agg(F.sum(F.size("boxes")).alias("__n")).filter((F.col("__n") > FEW) | unknown)
    crowded = written(crowded.select(*(F.col(c).alias(f"__{c}") for c in image)), "crowded")
    if crowded.isEmpty():
        return table, None
    same = F.lit(True)
    for c in image:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return table.join(crowded, same, "left_anti"), table.join(crowded, same, "left_semi")


def kept_reactions(rxns: DataFrame, image: Sequence[str], with_kept: bool = False, digits: int | None = None) -> DataFrame:
    """The rows that ``dedup.kept_reactions`` keeps, of images of any number of reactions.

    Where an image has few boxes, ``batches`` compares them in its row; cells and
    rounds cost more than they have to find. All others go in rounds.
    """
    columns = ["rxn_id", "boxes", *(["kept"] if with_kept else [])]
    few, many = _by_crowd(rxns.select(*image, *columns), image)
    done = batches.kept_reactions(few, image, with_kept, digits)
    return done if many is None else done.unionByName(_kept_in_rounds(many, image, with_kept, digits))


def _kept_in_rounds(rxns: DataFrame, image: Sequence[str], with_kept: bool = False, digits: int | None = None) -> DataFrame:
    """The rows that ``dedup.kept_reactions`` keeps, found in rounds over pairs of equal reactions.

    rxn_id is unique in its image. In a round, reactions that no undecided
    earlier one equals stay, and those go that equal one that stays. Each
    round decides the first undecided reaction at least, so it ends; a group
    of duplicates needs two rounds, whatever its size. Of reactions with the
    same boxes that equal themselves, only the first can stay, and only it
    takes part, so copies make no pairs. Rounds are written tables of narrow rows.
    """
    columns = ["rxn_id", "boxes", *(["kept"] if with_kept else [])]
    kept = F.col("kept") if with_kept else None
    whole = rxns.filter(has_role(F.col("boxes"), REACTANT, kept) & has_role(F.col("boxes"), PRODUCT, kept)).select(*image, *columns)
    ready = prepared(F.col("boxes"), kept=kept)
    # Others count as one of a kind each: their own number is part of the key.
    alone = F.when(equal(ready, ready, digits), F.lit(None)).otherwise(F.col("rxn_id"))
    shape = F.transform("boxes", lambda x: x.dropFields("idx"))
    of_kind = whole.groupBy(*image, shape.alias("__shape"), alone.alias("__alone"), *columns[2:])
    first = of_kind.agg(F.min_by(F.struct(*columns[:2]), "rxn_id").alias("__r")).select(*image, "__r.*", *columns[2:])
    first = written(first, "reactions")
    pairs = written(equal_pairs(first, first, image, with_kept=with_kept, earlier=True, digits=digits), "equal-pairs")
    # Only reactions in a pair need rounds; all others stay.
    gone, left = None, pairs
    while not left.isEmpty():
        later = left.select(*image, F.col("r").alias("l")).distinct()
        stays = left.select(*image, "l").distinct().join(later, [*image, "l"], "left_anti")
        now = written(left.join(stays, [*image, "l"], "left_semi").select(*image, "r").distinct(), "gone")
        gone = now if gone is None else gone.unionByName(now)
        # A decided reaction's pairs are over: those of what went, and those of what stays.
        left = left.join(stays, [*image, "l"], "left_anti").join(now, [*image, "r"], "left_anti").join(now.withColumnRenamed("r", "l"), [*image, "l"], "left_anti")
        left = written(left.select(*image, "l", "r"), "undecided")
    return first if gone is None else first.join(gone.withColumnRenamed("r", "rxn_id"), [*image, "rxn_id"], "left_anti").select(*image, *columns)


def postprocess(rxns: DataFrame, image: Sequence[str], digits: int | None = None) -> DataFrame:
    """``dedup.postprocess``, of images of any number of reactions as ``kept_reactions``."""
    few, many = _by_crowd(rxns.select(*image, "rxn_id", "boxes"), image)
    done = batches.postprocess(few, image, digits)
    if many is None:
        return done
    once = _kept_in_rounds(many, image, digits=digits)
    return done.unionByName(_kept_in_rounds(once.withColumn("kept", kept_boxes(F.col("boxes"), digits)), image, with_kept=True, digits=digits))
