"""Masks of batches bit by bit, and token sequences of any length."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from boxframe.functions import tokens
from boxframe.operators import batching


def test_masks_are_the_plain_ones(spark):
    rng = random.Random(4)
    rows = [(i, i // 3, rng.randrange(1, 40), rng.randrange(1, 30)) for i in range(60)] + [(60, 20, 7, 5), (61, 20, 7, 5), (62, 21, 1, 9), (63, 21, 9, 1)]
    df = batching.batch_sides(spark.createDataFrame(rows, "i long, batch long, w long, h long"), "batch", "w", "h")
    sides = [F.col(c) for c in ("w", "h", "batch_width", "batch_height")]
    cells = [F.ceil(F.col(c) / 4) for c in ("batch_width", "batch_height")]
    kept = [batching.cells_kept(F.col(c), F.col(b), n) for c, b, n in (("w", "batch_width", cells[0]), ("h", "batch_height", cells[1]))]
    done = df.select("*", batching.mask_bands(*sides).alias("bands"), batching.mask_bits(batching.mask_bands(*sides)).alias("bits"), batching.mask_bits(batching.mask_bands(*kept, *cells)).alias("small"))
    got = {r.i: r for r in done.collect()}
    assert len(got) == len(rows)
    for i, batch, w, h in rows:
        most = [max(r[k] for r in rows if r[1] == batch) for k in (2, 3)]
        mask = np.ones((most[1], most[0]), int)
        mask[:h, :w] = 0
        assert got[i].bits == "".join(map(str, mask.ravel()))
        assert len(got[i].bands) == (1 if h == most[1] else 2)
        wide, high = -(-most[0] // 4), -(-most[1] // 4)
        small = mask[[r * most[1] // high for r in range(high)]][:, [c * most[0] // wide for c in range(wide)]]
        assert got[i].small == "".join(map(str, small.ravel()))


def test_no_pictures(spark):
    df = spark.createDataFrame([], "batch long, w long, h long")
    assert batching.batch_sides(df, "batch", "w", "h").count() == 0


def test_reading_takes_linear_time(spark):
    """Sequences of many and of crowded reactions."""
    v = tokens.Vocabulary.of(pix2seq=True)
    box = [1, 2, 3, 4, v["[Mol]"]]
    ends = [v["[Rct]"]], [v["[Cnd]"]], [v["[Prd]"], v["[Rxn]"]]
    many = (box + ends[0] + ends[1] + box + ends[2]) * 8000
    crowd = box * 10000 + ends[0] + ends[1] + box * 10000 + ends[2]
    marks = box + ends[0] * 60000 + ends[1] + box + ends[2]
    df = spark.createDataFrame([(0, many), (1, crowd), (2, marks)], "i long, t array<bigint>")
    began = time.time()
    got = {r.i: r for r in df.select("i", tokens.parse_reactions(v, F.col("t")).alias("r"), F.size(tokens.parse_boxes(v, F.col("t"))).alias("n")).collect()}
    assert time.time() - began < 60
    assert (len(got[0].r), got[0].n) == (8000, 16000)
    assert [(len(r.reactants), len(r.conditions), len(r.products)) for r in got[1].r] == [(10000, 0, 10000)]
    assert [(len(r.reactants), len(r.conditions), len(r.products)) for r in got[2].r] == [(1, 0, 1)]


def test_no_sequence(spark):
    v = tokens.Vocabulary.of(pix2seq=True)
    box = [1, 2, 3, 4, v["[Mol]"]]
    rows = [(0, None, None), (1, [], []), (2, [None, *box, v["[Rct]"], None, v["[Cnd]"], *box, v["[Prd]"], v["[Rxn]"]], None), (3, [v["<eos>"], *box], [0.0] * 6), (4, box[:4], [0.5] * 4), (5, box, [0.1, 0.2, 0.3, 0.4, 0.5])]
    df = spark.createDataFrame(rows, "i long, t array<bigint>, s array<double>")
    got = {r.i: r for r in df.select("i", tokens.parse_reactions(v, F.col("t")).alias("r"), tokens.parse_boxes(v, F.col("t"), F.col("s")).alias("b")).collect()}
    assert [len(got[i].r) for i in range(6)] == [0, 0, 1, 0, 0, 0]
    assert [len(got[i].b) for i in range(6)] == [0, 0, 2, 0, 0, 1]
    assert got[5].b[0].score == 0.5 and got[2].b[0].score is None
