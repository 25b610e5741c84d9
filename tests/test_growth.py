import random

import pytest
from pyspark.sql import functions as F

from boxframe.functions import grammar, tokens
from boxframe.operators import matching
from boxframe.plans import registry


def test_places_are_told_apart_before_they_grow(spark, sf_dir):
    """Eight rows a place come after the shuffle, not before."""
    plan = registry.QUERIES["sine_position"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate posexplode") < plan.index("Aggregate")


@pytest.mark.parametrize("pix2seq", [True, False])
def test_tables_of_the_grammar(spark, pix2seq):
    """The fold over numbers says of each state and token what the plain rule does, and remembers no array that grows."""
    v = tokens.Vocabulary.of(pix2seq)
    said = [*v.ids.values(), v.first, v.first + v.bins - 1, v.size - 1, v.size, -1, 2**40]
    df = spark.createDataFrame([(s, t) for s in grammar.STATES for t in said], "s string, t long")
    kind = {r.t: r.k for r in df.select("t", grammar._kind(v, F.col("t")).alias("k")).distinct().collect()}
    for r in df.withColumn("ok", grammar.allowed(v, F.col("s"), F.col("t"))).collect():
        assert r.ok == grammar._allowed(r.s, kind[r.t]), (r.s, r.t)
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.choice(said) for _ in range(i)]) for i in range(30)], "i long, tokens array<long>")
    got = rows.select("tokens", grammar.states(v, F.col("tokens")).alias("states"), grammar.allowed_each(v, F.col("tokens")).alias("ok"))
    each = got.select("tokens", "states", "ok", F.zip_with("tokens", F.concat(F.array(F.lit(grammar.START)), F.slice("states", F.lit(1), F.greatest(F.size("states") - 1, F.lit(0)))), lambda t, s: grammar.allowed(v, s, t)).alias("plain"))
    for r in each.collect():
        assert len(r.states) == len(r.tokens) and r.ok == "".join(str(int(x)) for x in r.plain[: len(r.tokens)])
    plan = registry.QUERIES["fsm_allowed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index" not in plan


@pytest.mark.parametrize("name", ["eval_images", "eval_images_deduplicated"])
def test_images_are_counted_in_one_row(spark, sf_dir, name):
    """Gold and predicted boxes are numbered once each, and no row is made for a pair of reactions."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 2 and "inline" not in plan


def test_roles_after_one_that_differs_are_not_compared(spark):
    """Comparison stops at the first role that differs, and disjoint boxes have no IoU worked out."""
    box = lambda role, idx, x: (role, idx, 1, x, 0.0, x + 0.1, 0.1)
    kind = "array<struct<role:bigint,idx:bigint,category_id:bigint,x1:double,y1:double,x2:double,y2:double>>"
    left = [box(0, 0, 0.0), box(1, 2, 0.3), box(2, 1, 0.6)]
    rights = [left, [box(0, 0, 0.8), *left[1:]], [*left[:2], box(2, 1, 0.8)], left[:2]]
    df = spark.createDataFrame([(i, left, r) for i, r in enumerate(rights)], f"i int, l {kind}, r {kind}")
    same = matching.compare(F.col("l"), F.col("r"), digits=9)
    done = df.select("i", same.alias("same"))
    assert [r.same for r in done.orderBy("i").collect()] == [True, False, False, False]
    assert "forall(sequence(" in done._jdf.queryExecution().optimizedPlan().toString()
