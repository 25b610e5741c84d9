import random

import pytest

from boxframe.operators import coco

KIND = "image_id long, category_id long, box long, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture
def boxes(spark):
    """Crowded images of boxes of all areas, some of them without predictions."""
    rng = random.Random(12)
    gold, pred = [], []
    for i in range(60):
        for k in range(rng.randrange(1, 9)):
            x, y, side = rng.random() * 40, rng.random() * 40, rng.choice((20, 60, 120))
            gold.append((i, k % 2, k, x, y, x + side, y + side))
            if i % 5:
                pred += [(i, k % 2, 10 * k + j, x + rng.random() * side / 4, y, x + side, y + side, round(rng.random(), 1)) for j in range(2)]
    return spark.createDataFrame(gold, KIND), spark.createDataFrame(pred, KIND + ", score double"), len(pred)


def test_images_across_batches(spark, boxes):
    """Images that begin in one batch and end in another are matched whole."""
    gold, pred, _ = boxes
    want = coco.evaluate(gold, pred).first()
    assert 0 < want.aps < 1 and 0 < want.apm < 1 and 0 < want.apl < 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert coco.evaluate(gold, pred).first() == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sides_whose_partitions_are_merged_apart(spark, boxes):
    """Gold and predicted boxes that are dealt out already, of unequal size, still meet."""
    gold, pred, _ = boxes
    want = coco.evaluate(gold, pred).first()
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2000")
    try:
        assert coco.evaluate(gold.distinct().repartition("image_id"), pred.distinct().repartition("image_id")).first() == pytest.approx(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_what_is_written(monkeypatch, boxes):
    """A detection is written for the areas where it counts, not for all four, and once; its curves are scanned from far fewer rows."""
    gold, pred, n = boxes
    tables = {}
    plain = coco.written
    monkeypatch.setattr(coco, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    coco.evaluate(gold, pred).first()
    assert tables["matches"].filter("hits is not null").count() < 3 * n
    assert tables["blocks"].count() < n / 5
