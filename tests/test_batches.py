"""Removal of duplicates by batches of images against the folds of columns."""

import random

import pytest
from pyspark.sql import functions as F

from boxframe.operators import batches, dedup, overlap
from tests.test_overlap import BOX, reactions


def odd(rng, rxns):
    """Some boxes without a corner, with one that isn't a number or is infinite, turned, nearly empty, or of an unknown role."""
    for i, boxes in rxns:
        boxes = [list(b) for b in boxes]
        for b in boxes:
            if rng.random() < 0.12:
                b[rng.randrange(3, 7)] = rng.choice([None, None, float("nan"), float("inf")])
            elif rng.random() < 0.1:
                b[3:] = rng.choice([[b[5], b[6], b[3], b[4]], [b[3], b[4], b[3] + 0.009, b[6]], [b[3], b[4], b[3], b[4]]])
            elif rng.random() < 0.05:
                b[0] = rng.choice([3, -1])
        yield i, [tuple(b) for b in boxes]


def rows_of(df):
    return sorted(map(repr, df.select("image", "split", "rxn_id", *df.columns[3:]).collect()))


@pytest.mark.parametrize("digits", [None, 9])
def test_batches_keep_what_the_folds_keep(spark, monkeypatch, digits):
    rng = random.Random(digits or 5)
    rows = [(f"i{image}" if image else None, image % 3, i, r) for image in range(60) for i, r in (odd if image % 2 else lambda _, x: x)(rng, reactions(rng, rng.choice([1, 2, 5, 14]), 2))]
    df = spark.createDataFrame(rows, f"image string, split int, rxn_id long, boxes array<{BOX}>").repartition(3).cache()
    image = ["image", "split"]
    kept = df.withColumn("kept", F.expr("transform(filter(sequence(0L, size(boxes) - 1L), i -> (i + rxn_id) % 4 > 0), i -> i)"))
    want = [rows_of(dedup.kept_reactions(df, image, digits=digits)), rows_of(dedup.kept_reactions(kept, image, True, digits)), rows_of(dedup.postprocess(df, image, digits))]
    for together in (1, 1 << 20):
        monkeypatch.setattr(batches, "_TOGETHER", together)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if together == 1 else "10000")
        try:
            got = [rows_of(batches.kept_reactions(df, image, digits=digits)), rows_of(batches.kept_reactions(kept, image, True, digits)), rows_of(batches.postprocess(df, image, digits))]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want
    assert all(10 < len(w) < len(rows) for w in want) and len({len(w) for w in want}) == 3


def test_slices_hold_few_pairs_or_one_image(monkeypatch):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("rxn_id", pa.int64()), ("boxes", pa.list_(pa.struct([("x1", pa.float64())])))]))
    sizes = [[2, 1], [], [9], [1], [1], [3]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([[{"rxn_id": i, "boxes": [{"x1": 0.0}] * n} for i, n in enumerate(s)] for s in sizes], kind)], names=["image", "all"])
    monkeypatch.setattr(batches, "_TOGETHER", 10)
    assert [s.column(0).to_pylist() for s in batches._cut(batch)] == [[0, 1], [2], [3, 4], [5]]


def test_few_boxes_are_compared_by_batches(spark):
    """No overlap is worked out inside functions over arrays, whose time grew with each pair of boxes."""
    df = spark.createDataFrame([(i % 2, i, r) for i, r in reactions(random.Random(2), 8, 2)], f"image int, rxn_id long, boxes array<{BOX}>")
    for made in (overlap.kept_reactions(df, ["image"], digits=9), overlap.postprocess(df, ["image"], 9)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "lambda" not in plan
