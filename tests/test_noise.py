"""Noise is drawn inside an image's row, and only as much as is needed."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxframe.functions import draws, tokens
from boxframe.functions import geometry as G
from boxframe.operators import augment, matching, noise
from boxframe.operators.matching import let
from boxframe.plans import registry


def test_filling_draws_no_more_than_needed(spark):
    five = F.expr("array(1L, 2L, 3L, 4L, 5L)")
    part = lambda k: F.when(k > 3, F.raise_error(F.lit("drawn in vain")).cast("array<bigint>")).when(k == 1, F.expr("cast(array() as array<bigint>)")).otherwise(five)
    row = spark.range(1).select(tokens.filling(28, part, F.lit(86), 100).alias("all"), tokens.filling(28, part, F.lit(86), 100, with_empty=False).alias("full")).first()
    assert [len(p) for p in row.all] == [5, 0, 5, 5] and [len(p) for p in row.full] == [5, 5, 5]


@pytest.mark.parametrize("name", ["noise_boxes", "noise_sequences"])
def test_rows_arent_multiplied(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("key", [(), (0,), (7, 23, 2**40), (-3, None, "n", "r")])
def test_draws_side_by_side_are_those_of_columns(spark, key):
    heads, tails = ["22", "22:5", f"22:{2**62}", "22:é"], [":".join(["", *(str(k) for k in key if k is not None)]), ":1:fresh"]
    got = draws.Draws(heads, tails)(np.repeat(range(4), 2), np.tile(range(2), 4))
    rows = spark.createDataFrame([(h + t,) for h in heads for t in tails], "k string").select(augment.uniform(0, F.col("k")).alias("u"), "k").collect()
    assert got.tolist() == [int(hashlib.md5(r.k.encode()).hexdigest()[:13], 16) / 2**52 for r in rows]
    assert [r.u for r in rows] == draws.Draws(["0:"], [r.k for r in rows])(np.zeros(len(rows), int), np.arange(len(rows))).tolist()
    with pytest.raises(ValueError):
        draws.Draws(["x" * 50], ["12345678"])(np.zeros(1, int), np.zeros(1, int))


def test_noise_of_batches_is_that_of_columns(spark):
    """Images of one box to many, without roles, boxes without an area or with corners in the wrong order; batches of one image and of many."""
    rng = random.Random(9)
    v, rows = tokens.Vocabulary.of(pix2seq=True), []
    for image in [None, -4, *range(60), 2**50]:
        for i in range(rng.choice([1, 2, 3, 7, 12, 80])):
            x, y, w, h = rng.random() / 2, rng.random() / 2, rng.choice([0.3, 0.1, 0.0, -0.1]), rng.choice([0.3, 0.2, 0.2, -0.1])
            rows.append((image, i, rng.choice([i // 3, i % 2]), rng.randrange(3) if rng.random() < 0.7 else 2 * (i % 2), rng.randrange(1, 5), x, y, x + w, y + h))
    boxes = spark.createDataFrame(rows, "image_id long, box_idx long, rxn_id long, role long, category_id long, x1 double, y1 double, x2 double, y2 double").repartition(2).cache()

    # The same as columns: parts drawn one after the other inside an image's row.
    roles = F.array(*(F.transform(F.filter("boxes", lambda b: b["role"] == r), lambda b: b["idx"]) for r in range(3)))
    rxns = matching.reactions(boxes, ["image_id", "rxn_id"]).select("image_id", F.struct("rxn_id", roles.alias("roles"), "boxes").alias("r")).groupBy("image_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    box = lambda b: F.struct((G.Box.of(b).area != 0).alias("full"), tokens.box_tokens(v, G.Box.of(b), b["category_id"]).alias("five"))
    every = F.array_sort(F.flatten(F.transform("r", lambda x: x["boxes"])), lambda a, b: (a["idx"] - b["idx"]).cast("int"))
    images = rxns.select("image_id", "r", F.transform("r", lambda x: x["roles"]).alias("reactions"), every.alias("boxes"))
    images = images.select("*", F.transform("boxes", box).alias("fives"), F.transform("boxes", lambda b: b["idx"]).alias("numbers"), F.transform("r", lambda r: tokens.reaction_tokens(v, r["boxes"])).alias("parts"))

    def drawn(k):
        said = F.transform(augment.augmented(F.col("reactions"), F.col("numbers"), 22, F.col("image_id"), k), lambda role: F.filter(F.transform(role, lambda i: F.get("fives", i.cast("int"))), lambda x: x["full"]))
        return let(F.transform(said, lambda role: F.transform(role, lambda x: x["five"])), lambda roles: tokens.roles_tokens(v, roles))

    made = images.select("image_id", "parts", tokens.filling(24, drawn, F.size(F.flatten("parts")), 256, with_empty=False).alias("noise"))
    both = tokens.sequence(v, F.col("parts"), F.col("noise"))
    text = lambda c: F.array_join(F.transform(tokens.truncated(c, 256), lambda x: x.cast("string")), " ")
    want = sorted(map(tuple, made.select(F.coalesce("image_id", F.lit(-1)), F.size("noise"), F.size(both[0]), *map(text, both)).collect()))
    assert len(want) == 63 and {r[1] > 0 for r in want} == {True, False} and max(r[2] for r in want) > 256
    for at_once in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
        try:
            got = noise.filled(noise.images(v, boxes, "image_id"), v, "image_id", 22, 24, 256).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == want


def test_noise_reactions_are_drawn_by_batches(spark, sf_dir):
    """No draw is made inside a function over arrays; the time of those grew with each number drawn."""
    plan = registry.QUERIES["noise_sequences"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "conv(" not in plan and "lambda" not in plan
