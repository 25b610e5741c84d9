"""Grid cells and rounds against the forms that hold an image in one row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxframe.operators import dedup, matching, overlap

BOX = "struct<role:bigint,idx:bigint,category_id:bigint,x1:double,y1:double,x2:double,y2:double>"


@pytest.fixture
def many(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def drawn(rng, n, like=()):
    """Boxes of all sizes: whole images and points, equal and touching ones, outside the image, without corners or turned."""
    out = []
    for i in range(n):
        side = rng.choice([0.0, 0.001, 0.01, 0.06, 0.25, 1.0, 40.0])
        x, y = (rng.choice([rng.random(), rng.randrange(5) / 4, rng.uniform(-60, 60)]) for _ in "xy")
        box = [0, i, rng.randrange(1, 4), x, y, x + side * rng.choice([0.5, 1.0]), y + side]
        if like and i % 2:
            box = [0, i, *rng.choice(like)[2:]]
        elif i % 3 == 2:
            box = [0, i, rng.randrange(1, 4), *(c + rng.choice([0.0, 0.0, 1e-4]) for c in out[-1][3:])] if None not in out[-1] else box
        if i % 29 == 28 and not like:
            box[rng.randrange(3, 7)] = None
        elif i % 31 == 30:
            box[3:] = box[5], box[6], box[3] - 1, box[4] - 1
        out.append(tuple(box))
    return out


@pytest.mark.parametrize("category", [False, True])
def test_matches_by_cells_are_those_of_arrays(many, category):
    rng = random.Random(5)
    rows = [(i, l := drawn(rng, n), drawn(rng, m, l)) for i, (n, m) in enumerate([(120, 150), (1, 40), (40, 0), (0, 5)])]
    rows.append((None, drawn(rng, 9), drawn(rng, 9)))
    df = many.createDataFrame(rows, f"image int, l array<{BOX}>, r array<{BOX}>")
    want = df.filter("image is not null").select("image", F.posexplode(matching.box_match(F.col("l"), F.col("r"), 0.5, category)).alias("place", "m")).select("image", "place", "m.place", "m.iou").collect()
    sides = [df.select("image", F.posexplode(c).alias("place", "box")) for c in "lr"]
    got = {(r[0], r[1]): (r.place_found, r.iou) for r in overlap.best_matches(*sides, ["image"], match_category=category).filter("image is not null").collect()}
    assert len(got) == len(want) == 161
    for image, at, place, iou in want:
        # Where arrays have no IoU at all for lack of corners, so has this.
        assert got[image, at] == (place, pytest.approx(iou))
    assert sum(p >= 0 for p, _ in got.values()) > 20


def test_a_threshold_of_nothing_is_refused(spark):
    with pytest.raises(ValueError):
        overlap.best_matches(None, None, ["image"], threshold=0.0)


def test_one_image_of_ten_thousand_boxes_a_side(many):
    rng = np.random.default_rng(3)
    sides, frames = [], []
    for _ in range(2):
        low = np.round(rng.random((10_000, 2)), 2)
        corners = np.hstack([low, low + np.round(rng.uniform(0.01, 0.04, (10_000, 2)), 2)])
        sides.append(corners)
        rows = [(0, i, (1, *map(float, c))) for i, c in enumerate(corners)]
        frames.append(many.createDataFrame(rows, "image int, place int, box struct<category_id:int,x1:double,y1:double,x2:double,y2:double>"))
    left, right = sides
    pairs = overlap.overlapping(frames[0].select("image", F.col("place").alias("l"), F.col("box").alias("a")), frames[1].select("image", F.col("place").alias("r"), F.col("box").alias("b")), ["image"])
    where = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(where) >= 4 and max(r[1] for r in where) < 0.5 * sum(r[1] for r in where)
    shared = 0
    got = {r.place: (r.place_found, r.iou) for r in overlap.best_matches(*frames, ["image"], digits=9).collect()}
    for start in range(0, 10_000, 1000):
        a = left[start : start + 1000, None]
        wide = np.minimum(a[..., 2:], right[:, 2:]) - np.maximum(a[..., :2], right[:, :2])
        shared += int((wide >= 0).all(axis=2).sum())
        both = np.where((wide >= 0).all(axis=2), wide.prod(axis=2), 0)
        area = (a[..., 2:] - a[..., :2]).prod(axis=2) + (right[:, 2:] - right[:, :2]).prod(axis=1) - both
        iou = np.round(both / area, 9)
        best = iou.argmax(axis=1)
        for i, j in enumerate(best):
            place, value = got[start + i]
            assert value == pytest.approx(iou[i, j], abs=2e-9) and place == (j if iou[i, j] >= 0.5 else -1)
    assert pairs.count() == shared


def reactions(rng, n, base):
    """Reactions made from ``base`` ones: copies, moved a little or more, roles swapped, boxes said twice, without area or a product."""
    kinds, out = [], []
    for _ in range(base):
        boxes = []
        for role in range(3):
            for _ in range(rng.choice([1, 1, 2] if role != 1 else [0, 1, 2])):
                x, y = rng.random(), rng.random()
                boxes.append([role, 0, rng.choice([1, 1, 2]), x, y, x + rng.choice([0.1, 0.3]), y + rng.choice([0.1, 0.3])])
        if rng.random() < 0.2:
            boxes.append(list(boxes[-1]))
        if rng.random() < 0.1:
            boxes[0][5] = boxes[0][3]
        kinds.append(boxes)
    for i in range(n):
        move = rng.choice([0.0, 0.0, 0.01, 0.03, 0.05])
        boxes = [[*b[:3], *(c + rng.choice([-1, 0, 1]) * move for c in b[3:])] for b in rng.choice(kinds)]
        if rng.random() < 0.1:
            boxes[0][0] = 2
        boxes.sort(key=lambda b: b[0])
        out.append((i, [(b[0], k, *b[2:]) for k, b in enumerate(boxes)]))
    return out


@pytest.mark.parametrize("mode", ["exact", "soft", "mol_only"])
def test_hits_by_cells_are_those_of_arrays(many, mode):
    rng = random.Random(11)
    sides = ([], [])
    for image in range(12):
        made = reactions(rng, 16, 4)
        for i, r in made:
            sides[i % 2].append((image, i // 2, r))
    gold, pred = (many.createDataFrame(s, f"image int, rxn_id long, boxes array<{BOX}>") for s in sides)
    want = {tuple(r) for r in matching.hits(gold, pred, ["image"], 9, (mode,)).collect()}
    got = {tuple(r) for r in overlap.hits(gold, pred, ["image"], mode, 9).collect()}
    assert got == want and 10 < sum(r[3] for r in got) < len(got)


def kept(df, module):
    once = module.postprocess(df, ["image"], 9)
    first = module.kept_reactions(df, ["image"], digits=9)
    return [sorted(tuple(r) for r in x.select("image", "rxn_id", *x.columns[2:]).collect()) for x in (first, once)]


def test_rounds_keep_what_the_fold_keeps(many):
    rng = random.Random(23)
    rows = [(image, i, r) for image, n in enumerate([60, 25, 1, 12]) for i, r in reactions(rng, n, 3)]
    df = many.createDataFrame(rows, f"image int, rxn_id long, boxes array<{BOX}>").repartition(3)
    got, want = kept(df, overlap), kept(df, dedup)
    assert got == want and 4 < len(got[0]) < len(rows)
    none = df.filter("false")
    assert kept(none, overlap) == [[], []]


def test_a_chain_takes_rounds(many):
    """Each reaction equals the next one only: every other one stays."""
    rows = [(0, i, [(0, 0, 1, 0.02 * i, 0.0, 0.02 * i + 0.07, 0.1), (2, 1, 1, 0.02 * i, 0.5, 0.02 * i + 0.07, 0.6)]) for i in range(9)]
    df = many.createDataFrame(rows, f"image int, rxn_id long, boxes array<{BOX}>")
    got = sorted(r.rxn_id for r in overlap.kept_reactions(df, ["image"], digits=9).collect())
    assert got == sorted(r.rxn_id for r in dedup.kept_reactions(df, ["image"], digits=9).collect()) == [0, 2, 4, 6, 8]


def test_one_image_of_five_thousand_reactions(many):
    rng = random.Random(31)
    rows = [(0, i, [(0, 0, 1, x, y, x + 0.02, y + 0.02), (2, 1, 1, x, y + 0.03, x + 0.02, y + 0.05)]) for i in range(5000) for x, y in [(rng.randrange(25) / 25 + rng.choice([0, 0, 0.002]), rng.randrange(4) / 4)]]
    df = many.createDataFrame(rows, f"image int, rxn_id long, boxes array<{BOX}>")
    got, want = (sorted(r.rxn_id for r in m.kept_reactions(df, ["image"], digits=9).collect()) for m in (overlap, dedup))
    assert got == want and 90 < len(got) < 250


def test_boxes_of_small_images_are_one_row(spark):
    """Few boxes meet in a single cell, whatever their size; many in cells of their own level and the coarser ones."""
    from boxframe.operators import overlap

    box = F.expr("named_struct('x1', 0.1d, 'y1', 0.1d, 'x2', 0.11d, 'y2', 0.11d)")
    rows = spark.range(1).select(box.alias("b"))
    assert overlap._in_cells(rows, "b", "l", F.lit(False)).count() == 1
    assert overlap._in_cells(rows, "b", "l", F.lit(True)).count() > 6
    few, many = (spark.range(n).select(F.lit(n).alias("image"), "id") for n in (overlap.FEW // 2, overlap.FEW))
    assert [r.image for r in overlap._crowded(["image"], few, few).unionByName(overlap._crowded(["image"], many, many)).collect()] == [overlap.FEW]


def test_images_of_few_boxes_need_no_cells(many, monkeypatch):
    """Only crowded images, and rows without an image, go by cells and rounds."""
    rng = random.Random(41)
    rows = [(image, i, r) for image, n in enumerate([9, 5, 1, 12]) for i, r in reactions(rng, n, 2)]
    df = many.createDataFrame(rows, f"image int, rxn_id long, boxes array<{BOX}>")
    want, asked = kept(df, dedup), []
    rounds = overlap._kept_in_rounds
    monkeypatch.setattr(overlap, "_kept_in_rounds", lambda rxns, *a, **k: asked.append(sorted({r.image for r in rxns.select("image").collect()}, key=str)) or rounds(rxns, *a, **k))
    assert kept(df, overlap) == want and not asked
    crowd = [(7, i, r) for i, r in reactions(rng, 30, 3)]
    both = many.createDataFrame([*rows, *crowd, (None, 1, crowd[0][2]), (None, 2, crowd[0][2])], df.schema)
    got = overlap.postprocess(both, ["image"], 9).collect()
    assert sorted(tuple(r) for r in got if r.image is not None) == kept(both.filter("image is not null"), dedup)[1]
    assert asked == [[7, None]] * 2 and [r.rxn_id for r in got if r.image is None] == [1]


def test_a_long_chain_takes_rounds(many):
    rows = [(0, i, [(0, 0, 1, 0.02 * i, 0.0, 0.02 * i + 0.07, 0.1), (2, 1, 1, 0.02 * i, 0.5, 0.02 * i + 0.07, 0.6)]) for i in range(overlap.FEW)]
    df = many.createDataFrame(rows, f"image int, rxn_id long, boxes array<{BOX}>")
    left = overlap._by_crowd(df, ["image"])[1]
    assert left is not None and left.count() == overlap.FEW
    got = sorted(r.rxn_id for r in overlap.kept_reactions(df, ["image"], digits=9).collect())
    assert got == list(range(0, overlap.FEW, 2))
