"""Seeded augmentation of targets: boxes and reactions, without pixels.

All choices come from hashes of a seed and a row's key, so a row gets the
same augmentation wherever and however often it's computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.functions import geometry as G
from boxframe.operators.matching import let
from boxframe.schemas import CATEGORIES

#: Side of the square that pictures are put on.
OUTPUT = 1333
#: Cut-outs narrower or lower than this are not made.
LEAST_CROP = 30


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) for a key: 52 bits of the MD5 of seed and keys as text, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def whole(seed: int, low: Column, high: Column, *keys: Column) -> Column:
    """A whole number from low to high, both included."""
    return (low + F.floor(uniform(seed, *keys) * (high - low + 1))).cast("long")


def shuffled(values: Column, seed: int, *keys: Column) -> Column:
    """An array in an order drawn for the key."""
    ranked = F.sort_array(F.transform(values, lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys), i.cast("string"))).alias("at"), i.alias("i"))))
    return F.transform(ranked, lambda r: F.get(values, r["i"]))


def random_flip(box: G.Box, width: Column, seed: int, *keys: Column, p: float = 0.5) -> G.Box:
    flip = uniform(seed, *keys) < p
    return G.Box(*(F.when(flip, a).otherwise(b) for a, b in zip(G.hflip(box, width), box, strict=True)))


def random_rotate(box: G.Box, width: Column, height: Column, seed: int, *keys: Column, p: float = 0.5) -> tuple[G.Box, Column, Column]:
    """Box, width and height after a quarter turn with probability ``p``."""
    turn = uniform(seed, *keys) < p
    box = G.Box(*(F.when(turn, a).otherwise(b) for a, b in zip(G.rotate90(box, width), box, strict=True)))
    return box, F.when(turn, height).otherwise(width), F.when(turn, width).otherwise(height)


def random_crop(box: G.Box, width: Column, height: Column, crop_w: Column, crop_h: Column, seed: int, *keys: Column) -> G.Box:
    left, top = whole(seed, F.lit(0), width - crop_w, *keys, F.lit("x")), whole(seed, F.lit(0), height - crop_h, *keys, F.lit("y"))
    return G.crop(box, left, top, crop_w, crop_h)


def random_size_crop(box: G.Box, width: Column, height: Column, least: int, most: int, seed: int, *keys: Column) -> tuple[G.Box, Column, Column]:
    """Box, width and height of a cut-out whose sides are drawn from ``least`` to ``most`` (or the picture's)."""
    sides = [whole(seed, F.lit(least), F.least(F.lit(most), side), *keys, F.lit(n)) for n, side in (("w", width), ("h", height))]
    return random_crop(box, width, height, *sides, seed, *keys), *sides


def padded(width: Column, height: Column, right: Column, below: Column) -> tuple[Column, Column]:
    """Width and height of a picture with a margin to the right and below; boxes stay where they are."""
    return width + right, height + below


def random_pad(width: Column, height: Column, most: int, seed: int, *keys: Column) -> tuple[Column, Column]:
    return padded(width, height, *(whole(seed, F.lit(0), F.lit(most), *keys, F.lit(n)) for n in ("x", "y")))


def random_resize(box: G.Box, width: Column, height: Column, sizes: list[int], seed: int, *keys: Column, max_size: int | None = None) -> tuple[G.Box, Column, Column]:
    """Box, width and height after a resize to one of ``sizes``, drawn for the key."""
    at = whole(seed, F.lit(0), F.lit(len(sizes) - 1), *keys)
    sides = [G.resized(width, height, size, max_size) for size in sizes]
    w, h = (F.get(F.array(*(s[i] for s in sides)), at.cast("int")) for i in (0, 1))
    return G.scaled(box, w / width, h / height), w, h


def random_select(first: G.Box, second: G.Box, seed: int, *keys: Column, p: float = 0.5) -> G.Box:
    """The box of one of two transforms, the first with probability ``p``."""
    chosen = uniform(seed, *keys) < p
    return G.Box(*(F.when(chosen, a).otherwise(b) for a, b in zip(first, second, strict=True)))


def center_crop(box: G.Box, width: Column, height: Column, crop_w: Column, crop_h: Column) -> G.Box:
    return G.crop(box, F.rint((width - crop_w) / 2), F.rint((height - crop_h) / 2), crop_w, crop_h)


def jitter(box: G.Box, width: Column, height: Column, seed: int | None = None, low: float = 0.3, high: float = 2.0, keys: tuple[Column, ...] = (), size: int = OUTPUT) -> tuple[G.Box, Column, Column]:
    """(box, x scale, y scale) on a square of ``size``: scaled by a random factor, then padded or cut.

    Without a seed nothing is random: the picture fills the square as far as
    its shape allows and is padded to the right and below. The scales are the
    scaled sides over ``size``, which decoding divides by.
    """
    factor = F.lit(1.0) if seed is None else uniform(seed, *keys, F.lit("scale")) * (high - low) + low
    goal = F.rint(factor * size)
    scale = F.least(goal / height, goal / width)
    w, h = (F.greatest(F.rint(side * scale), F.lit(1.0)) for side in (width, height))
    box = G.scaled(box, w / width, h / height)
    spare_w, spare_h = F.greatest(size - w, F.lit(0.0)), F.greatest(size - h, F.lit(0.0))
    over_w, over_h = F.greatest(w - size, F.lit(0.0)), F.greatest(h - size, F.lit(0.0))
    if seed is None:
        left = top = cut_x = cut_y = F.lit(0.0)
    else:
        share = uniform(seed, *keys, F.lit("pad"))
        left, top = F.rint(share * spare_w), F.rint(share * spare_h)
        cut_x, cut_y = F.floor(uniform(seed, *keys, F.lit("x")) * over_w), F.floor(uniform(seed, *keys, F.lit("y")) * over_h)
    moved = G.Box(box.x1 + left - cut_x, box.y1 + top - cut_y, box.x2 + left - cut_x, box.y2 + top - cut_y)
    cut = (over_w > 0) | (over_h > 0)
    inside = G.clamp(moved, F.lit(float(size)), F.lit(float(size)))
    return G.Box(*(F.when(cut, a).otherwise(b) for a, b in zip(inside, moved, strict=True))), w / size, h / size


def free_spans(boxes: DataFrame, keys: list[str], low: str, high: str, size: Column) -> DataFrame:
    """(keys, start, stop): parts of an axis that no box covers, as gaps between islands.

    An axis covered to its edge has an empty span there, so a cut can be at
    the very edge.
    """
    order = Window.partitionBy(*keys).orderBy(low, high)
    rows = boxes.select(*keys, F.rint(low).cast("long").alias(low), F.rint(high).cast("long").alias(high), F.lit(size).cast("long").alias("size"))
    till = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    between = rows.select(*keys, F.coalesce(till, F.lit(0)).alias("start"), F.col(low).alias("stop"), F.when(till.isNull(), F.col(low) <= 0).otherwise(False).alias("edge"))
    behind = rows.groupBy(*keys, "size").agg(F.max(high).alias("start")).select(*keys, F.least("start", "size").alias("start"), F.col("size").alias("stop"), (F.col("start") >= F.col("size")).alias("edge"))
    return between.unionByName(behind).filter("stop > start or edge").select(*keys, "start", F.greatest("start", "stop").alias("stop"))


def crop_region(spans: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, low, high): a cut between points drawn in two different spans of each axis; axes with one span get two points in it."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in (*keys, "start", "stop"))))
    pick = spans.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "start", "stop"))).filter("__nth <= 2")
    point = pick.select(*keys, whole(seed + 1, F.col("start"), F.col("stop"), *map(F.col, keys), F.col("__nth")).alias("at"), whole(seed + 2, F.col("start"), F.col("stop"), *map(F.col, keys), F.col("__nth")).alias("other"))
    both = point.groupBy(*keys).agg(F.count("*").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"), F.min("other").alias("c"))
    high = F.when(F.col("n") > 1, F.col("b")).otherwise(F.greatest("a", "c"))
    low = F.when(F.col("n") > 1, F.col("a")).otherwise(F.least("a", "c"))
    return both.select(*keys, low.alias("low"), high.alias("high"), (high - low >= LEAST_CROP).alias("wide"))


def composites(items: DataFrame, others: int, n: Column, seed: int, p: float = 0.5) -> DataFrame:
    """(idx, slot, source): which items are put below one another for each item, by up to ``others`` coin throws.

    ``items`` has idx from 0 to ``n`` - 1. Slot 0 is the item itself; a partner
    is ``idx + k`` modulo n for a drawn k.
    """
    slot = F.explode(F.sequence(F.lit(1), F.lit(others))).alias("slot")
    throws = items.select("idx", slot).filter(uniform(seed, F.col("idx"), F.col("slot")) < p)
    partner = F.pmod(F.col("idx") + whole(seed + 1, F.lit(1), F.greatest(n - 1, F.lit(1)), F.col("idx"), F.col("slot")), n)
    return items.select("idx", F.lit(0).alias("slot"), F.col("idx").alias("source")).unionByName(throws.select("idx", "slot", partner.alias("source")))


def stacked(pictures: DataFrame, keys: list[str], slot: str = "slot", boxes: str = "boxes") -> DataFrame:
    """(keys, boxes): the pictures of each key put below one another in the order of slots.

    ``pictures`` has keys, slot, height and an array of boxes (x1, y1, x2, y2
    and any other fields); of fields named rxn_id and box_idx those of later
    pictures are counted on from the ones before. A key has a handful of slots.
    """
    order = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    reactions = F.coalesce(F.array_max(F.transform(boxes, lambda b: b["rxn_id"])) + 1, F.lit(0))
    placed = pictures.select(*keys, slot, boxes, before(F.col("height")).alias("top"), before(F.size(boxes)).alias("n"), before(reactions).alias("r"))
    moved = F.transform(boxes, lambda b: b.withField("y1", b["y1"] + F.col("top")).withField("y2", b["y2"] + F.col("top")).withField("box_idx", b["box_idx"] + F.col("n")).withField("rxn_id", b["rxn_id"] + F.col("r")))
    return placed.select(*keys, slot, moved.alias("b")).groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(slot, "b"))), lambda x: x["b"])).alias(boxes))


def below(boxes_a: Column, boxes_b: Column, height_a: Column, x_b: Column) -> Column:
    """Boxes of two pictures of which the second is put below the first, ``x_b`` to the right."""
    moved = F.transform(boxes_b, lambda b: b.withField("x1", b["x1"] + x_b).withField("x2", b["x2"] + x_b).withField("y1", b["y1"] + height_a).withField("y2", b["y2"] + height_a))
    return F.concat(boxes_a, moved)


def rebased(indices: Column, n_boxes: Column) -> Column:
    """Box numbers of the second picture's reactions, behind the first one's boxes."""
    return F.transform(indices, lambda i: i + n_boxes)


def perturbed(roles: Column, n_boxes: Column, seed: int, *keys: Column) -> Column:
    """A reaction, as an array of its roles' box numbers, with one box added, taken out or moved to another role.

    A reaction of one reactant and one product can only get one added; what's
    taken out leaves at least one reactant and one product.
    """
    draw = lambda low, high, name: whole(seed, low, high, *keys, F.lit(name))
    least = F.array(F.lit(1), F.lit(0), F.lit(1))
    spare = F.filter(F.transform(roles, lambda a, r: F.when(F.size(a) > F.get(least, r), r.cast("long"))), lambda r: r.isNotNull())

    def first(spare: Column) -> Column:
        kind = F.when(F.size(spare) == 0, F.lit(0).cast("long")).otherwise(draw(F.lit(0), F.lit(2), "kind"))
        gone = F.get(spare, draw(F.lit(0), F.size(spare) - 1, "gone").cast("int"))
        return let(F.struct(kind.alias("kind"), gone.alias("gone"), F.get(roles, gone.cast("int")).alias("own")), second)

    def second(d: Column) -> Column:
        place = draw(F.lit(0), F.size(d["own"]) - 1, "place")
        added = F.when(d["kind"] == 0, draw(F.lit(0), F.lit(2), "role"))
        to = F.when(d["kind"] == 2, (d["gone"] + 1 + draw(F.lit(0), F.lit(1), "to")) % 3)
        return let(F.struct(F.when(d["kind"] > 0, d["gone"]).alias("gone"), F.when(d["kind"] > 0, place).alias("place"), added.alias("added"), to.alias("to"), d["own"].alias("own")), changed)

    def changed(d: Column) -> Column:
        new = draw(F.lit(0), n_boxes - 1, "new")
        put = lambda a, r: F.when(r == d["added"], F.concat(a, F.array(new))).when(r == d["gone"], F.filter(a, lambda x, i: i != d["place"]))
        return F.transform(roles, lambda a, r: put(a, r).when(r == d["to"], F.concat(a, F.array(F.get(d["own"], d["place"].cast("int"))))).otherwise(a))

    return let(spare, first)


def augmented(reactions: Column, boxes: Column, seed: int, *keys: Column, fresh: int = 20) -> Column:
    """A reaction that isn't there: of boxes drawn anew (``fresh`` times of 100, or if there's none), or one of ``reactions`` perturbed.

    ``reactions`` is an array of roles' box numbers, ``boxes`` the numbers of
    boxes that aren't empty.
    """
    draw = lambda low, high, *name: whole(seed, low, high, *keys, *map(F.lit, name))
    n = F.size(boxes)

    def drawn(name: str, least: int) -> Column:
        count = draw(F.lit(least), F.lit(3), "n", name)
        return F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), count.cast("int")), lambda j: F.get(boxes, whole(seed, F.lit(0), n - 1, *keys, F.lit(name), j).cast("int")))

    anew = F.array(drawn("r", 1), drawn("c", 0), drawn("p", 1))
    known = F.get(reactions, draw(F.lit(0), F.size(reactions) - 1, "pick").cast("int"))
    old = let(known, lambda k: perturbed(k, n, seed, *keys))
    return F.when((F.size(reactions) == 0) | (draw(F.lit(0), F.lit(99), "fresh") < fresh), anew).otherwise(old)


def train_view(box: G.Box, width: Column, height: Column, seed: int, *keys: Column, size: int = OUTPUT) -> tuple[G.Box, Column, Column]:
    """(normalised box, x scale, y scale) of a training view: turned, flipped, jittered, then normalised. Colours are the pixels' matter."""
    box, w, h = random_rotate(box, width, height, seed, *keys)
    box = random_flip(box, w, seed + 1, *keys)
    box, sx, sy = jitter(box, w, h, seed + 2, keys=keys, size=size)
    return G.normalised(box, F.lit(float(size)), F.lit(float(size))), sx, sy


def eval_view(box: G.Box, width: Column, height: Column, size: int = OUTPUT) -> tuple[G.Box, Column, Column]:
    """The same without any draw: fitted and padded, then normalised."""
    box, sx, sy = jitter(box, width, height, size=size)
    return G.normalised(box, F.lit(float(size)), F.lit(float(size))), sx, sy


def jittered_box(box: G.Box, width: Column, height: Column, seed: int, *keys: Column, ratio: float = 0.2) -> G.Box:
    """Corners moved by up to ``ratio`` of the box's sides, put in order and cut to the picture."""
    return G.clamp(_ordered(*_moved(box, seed, *keys, ratio=ratio)), width, height)


def _ordered(xa: Column, xb: Column, ya: Column, yb: Column) -> G.Box:
    return G.Box(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))


def _moved(box: G.Box, seed: int, *keys: Column, ratio: float) -> list[Column]:
    w, h = box.x2 - box.x1, box.y2 - box.y1
    move = lambda side, name: side * ratio * (uniform(seed, *keys, F.lit(name)) * 2 - 1)
    return [box.x1 + move(w, "x1"), box.x2 + move(w, "x2"), box.y1 + move(h, "y1"), box.y2 + move(h, "y2")]


def _drawn(width: Column, height: Column, seed: int, *keys: Column) -> list[Column]:
    return [uniform(seed, *keys, F.lit(n)) * side for n, side in zip("abcd", (width, width, height, height), strict=True)]


def noise_box(box: Column, width: Column, height: Column, seed: int, *keys: Column, ratio: float = 0.2) -> Column:
    """A struct with the corners that ``random_select`` by ``seed`` gives of a ``random_box`` (``seed`` + 1) and ``box`` jittered (``seed`` + 2).

    Each draw is made once and only if it's needed, also inside functions over arrays.
    """
    corners = lambda values: F.struct(*(c.alias(n) for n, c in zip(("xa", "xb", "ya", "yb"), values, strict=True)))
    jittered = let(box, lambda b: corners(_moved(G.Box.of(b), seed + 2, *keys, ratio=ratio)))
    chosen = F.when(uniform(seed, *keys) < 0.5, corners(_drawn(width, height, seed + 1, *keys))).otherwise(jittered)
    return let(chosen, lambda c: F.struct(*G.clamp(_ordered(c["xa"], c["xb"], c["ya"], c["yb"]), width, height).named()))


def random_category(seed: int, *keys: Column) -> Column:
    return whole(seed, F.lit(1), F.lit(len(CATEGORIES)), *keys, F.lit("category"))


def random_box(width: Column, height: Column, seed: int, *keys: Column) -> G.Box:
    return _ordered(*_drawn(width, height, seed, *keys))


def views(df: DataFrame, n: int = 2) -> DataFrame:
    """Each row ``n`` times, with the number of the view as part of its seed."""
    return df.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
