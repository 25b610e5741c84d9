import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxframe.operators import coco, meters
from boxframe.operators.scan import SEGMENT, scan, segments
from boxframe.plans import registry


@pytest.fixture
def many(spark):
    """Segments stay apart, however few rows they have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def made(seed, n, names):
    rng = random.Random(seed)
    return [(rng.choice(names), i, rng.choice([None, *range(-5, 40)])) for i in range(n)]


def test_one_name_in_many_tasks(many):
    rows = made(1, 500, ["only"])
    df = many.createDataFrame(rows, "name string, at int, value int").repartition(3)
    parts = segments(df, ["name"], [F.col("at")])
    assert parts.select(SEGMENT).distinct().count() >= 3
    total, got = 0, scan(parts, ["name"], [F.col("at")], {"s": F.col("value"), "n": F.lit(1)}, "value", 7).sort("at").collect()
    for i, r in enumerate(got):
        total += rows[i][2] or 0
        assert (r.s, r.n, r["__last"]) == (total, i + 1, [x[2] for x in rows[max(0, i - 6) : i + 1]])


@pytest.mark.parametrize("names", [["only"], ["a", "b", None], [f"n{i}" for i in range(200)]])
def test_meters_against_plain_reading(many, names):
    rows = made(2, 700, names)
    df = many.createDataFrame(rows, "name string, at int, value int").repartition(5)
    got = {r.at: r for r in meters.running(df, "name", "value", ["at"], count=1 + F.col("at") % 3).collect()}
    assert len(got) == len(rows)
    held, sums = defaultdict(list), defaultdict(lambda: [0, 0])
    for name, at, value in rows:
        held[name].append(value)
        sums[name][0] += (value or 0) * (1 + at % 3)
        sums[name][1] += 1 + at % 3
        last = sorted(x for x in held[name][-20:] if x is not None)
        r = got[at]
        assert (r.median, r.max, r.value_now) == (last[(len(last) - 1) // 2] if last else None, last[-1] if last else None, value)
        assert (r.avg is None and not last) or r.avg == pytest.approx(sum(last) / len(last))
        if any(x is not None for x in held[name]):
            assert r.global_avg == pytest.approx(sums[name][0] / sums[name][1])
    lines = meters.logged(df, "name", ["at"], 50, "value").collect()
    sizes = {n: len(v) for n, v in held.items()}
    assert len(lines) == sum(len({*range(0, n, 50), n - 1}) for n in sizes.values())
    for r in lines:
        own = [x for x in held[r["name"]][: r.i + 1] if x is not None]
        assert r.n == sizes[r["name"]] and ((r.eta is None and not own) or r.eta == pytest.approx(sum(own) / len(own) * (r.n - r.i)))


def curve_average(hits, total):
    """The area under one curve by reading it from its end."""
    points, h = [], 0
    for i, x in enumerate(hits, 1):
        h += x
        points.append((h / total, h / i))
    return sum(max((p for r, p in points if r + 1e-12 >= k / 100), default=0.0) for k in range(101)) / 101


@pytest.mark.parametrize("scores", [lambda i: 0.5, lambda i: i / 1000])
def test_equal_scores_are_ranked_in_many_tasks(many, scores):
    rng = random.Random(3)
    gold, pred, hits = [], [], []
    for i in range(600):
        x = float(rng.randrange(100))
        hit = rng.random() < 0.6
        gold.append((i, 1, 0, x, 0.0, x + 50, 50.0))
        pred.append((i, 1, 0, *((x, 0.0, x + 50, 50.0) if hit else (x + 200, 0.0, x + 250, 50.0)), scores(i)))
        hits.append((-scores(i), i, hit))
    columns = "image_id long, category_id long, box long, x1 double, y1 double, x2 double, y2 double"
    got = coco.evaluate(many.createDataFrame(gold, columns), many.createDataFrame(pred, columns + ", score double")).first()
    want = curve_average([h for _, _, h in sorted(hits)], 600)
    assert (got.ap, got.ap50, got.apm) == pytest.approx((want, want, want)) and got.ar1 == got.ar100 == pytest.approx(sum(h for *_, h in hits) / 600)
    assert got.aps == got.apl == -1


def test_coco_plan_matches_once(spark, sf_dir):
    plan = registry.QUERIES["coco_scores"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "matches-" in plan
