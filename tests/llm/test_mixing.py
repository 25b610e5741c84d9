import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxframe.llm.mixing import mix, take, targets, word_count


def shared(sizes, weights=(3, 1, 2)):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    given, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            given[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if given[s] >= 2 * sizes[s]:
                left += given[s] - 2 * sizes[s]
                given[s] = 2.0 * sizes[s]
                open_.discard(s)
    return given


def test_targets(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {f"s{i}": rng.choice([0, 5, 100, 7000, rng.randrange(10**6)]) for i in range(rng.randrange(1, 9))} | {None: 50}
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        for s, t in shared(sizes).items():
            assert got[s] == pytest.approx(t, rel=1e-9, abs=1e-6)


def test_words(spark):
    texts = [None, "", " \n", "a", " a  b\tc\x0b", "a b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 0, 0, 1, 3, 2]


def test_mix_is_near_target(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.choice([1, 5, 40, 300])), rng.choice("aaaaab") if i % 3 else "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for favour, buckets in ((None, 16), (F.length("text") % 7 + 1, 1024)):
        mixed = mix(df, favour=favour, buckets=buckets).collect()
        assert len(mixed) == 3000
        taken, target = defaultdict(int), {}
        for r in mixed:
            assert 0 <= r.copies <= 2
            taken[r.source] += r.copies * r.size
            target[r.source] = r.target
        for s, t in target.items():
            assert abs(taken[s] - t) <= 2, (s, taken[s], t)
    again = {r.doc_id: r.copies for r in mix(df.repartition(7), favour=favour, buckets=1024).collect()}
    assert again == {r.doc_id: r.copies for r in mixed}


def test_inclusion_follows_favour(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.when(F.col("id") < 3000, "a").when(F.col("id") < 4000, "b").otherwise("c").alias("source"))
    mixed = mix(df, favour=F.when(F.col("doc_id") % 2 == 0, 1.5).otherwise(0.5))
    got = {(r.source, r.odd): r.n for r in mixed.groupBy("source", (F.col("doc_id") % 2).alias("odd")).agg(F.avg(F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("n")).collect()}
    part = {r.source: r.p for r in mixed.select("source", (F.col("target") / F.col("source_size") % 1).alias("p")).distinct().collect()}
    for s, p in part.items():
        if 0 < p < 0.6:
            assert got[s, 0] == pytest.approx(1.5 * p, abs=0.05) and got[s, 1] == pytest.approx(0.5 * p, abs=0.05)


def test_no_odds_above_one(spark):
    """Rows that would pass one are certain; the others share the rest, and are included as often as that says."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([20, 60, 200, 2000]), "abc"[i % 3]) for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    for favour, own in ((F.when(F.col("doc_id") % 2 == 0, 1.9).otherwise(0.1), lambda r: 1.9 if r.doc_id % 2 == 0 else 0.1), (lambda size: size, lambda r: r.size)):
        groups = defaultdict(list)
        for r in mix(df, favour=favour, keep=["doc_id", "source"]).collect():
            groups[r.source].append(r)
        for rows_ in groups.values():
            whole = int(rows_[0].target // rows_[0].source_size)
            rest = rows_[0].target - whole * rows_[0].source_size
            if not rest:
                continue
            low, high = 0.0, 1e9
            for _ in range(200):
                level = (low + high) / 2
                low, high = (low, level) if sum(r.size * min(1, level * own(r)) for r in rows_) > rest else (level, high)
            by = defaultdict(list)
            for r in rows_:
                by[round(min(1, level * own(r)), 6)].append(r.copies - whole)
            assert sum(r.size * min(1, level * own(r)) for r in rows_) == pytest.approx(rest, rel=0.01)
            for p, taken in by.items():
                assert sum(taken) / len(taken) == pytest.approx(p, abs=0.08), (p, len(taken))
                assert p < 1 or min(taken) == 1


def test_hard_rows(spark):
    rows = [(1, None, "a", 1), (2, "", None, 2), (None, "x y", None, 3), (None, "x y z", "b", 4), (5, "w " * 9000, "b", 5), (5, "w " * 9000, "b", 5), (7, "", "z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").withColumn("cut", F.lit("own")).withColumn("whole", F.lit("own"))
    mixed = mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "cut", "whole", "size", "source_size", "target", "copies"]
    got = mixed.collect()
    assert len(got) == 7 and {r.cut for r in got} == {"own"} and all(r.target == 0 for r in got if r.source in ("a", "z"))
    assert len({r.copies for r in got if r.doc_id == 5}) == 1
    assert mix(df.limit(0)).count() == 0
    assert take(mixed, df.columns[:3]).count() == sum(r.copies for r in got)


def test_query_against_plain_ranking(spark, sf_dir):
    from boxframe.llm.queries import op10_pareto_mixing

    got = op10_pareto_mixing(spark, sf_dir).collect()
    sizes, source = defaultdict(int), {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        sizes[r.source] += len(r.text.encode().split())
        source[r.doc_id] = r.source
    wanted, taken = shared(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(wanted[source[r.doc_id]])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    assert sum(abs(taken[s] - t) for s, t in wanted.items()) < 0.02 * sum(wanted.values())


def test_any_column_names(spark):
    rows = [(i, "w " * (i % 50 + 1), "ab"[i % 2], "x", "y", "z") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size string, u string, favour string")
    mixed = mix(df)
    assert mixed.columns == [*df.columns, "size", "source_size", "target", "copies"] and {(r["__size"], r.u, r.favour) for r in mixed.collect()} == {("x", "y", "z")}
    narrow = {r.doc_id: (r.size, r.target, r.copies) for r in mix(df, keep=["doc_id"]).collect()}
    assert narrow == {r.doc_id: (r.size, r.target, r.copies) for r in mixed.collect()}


def test_gap_left_is_bounded(spark):
    """At most half the smallest later document that isn't taken, with few large and no small ones."""
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(40, 400), "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix(df, favour=lambda size: size, buckets=4).collect()
    for s in "abc":
        own = [r for r in mixed if r.source == s]
        low = min(r.copies for r in own)
        rest = [r.size for r in own if r.copies == low]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(rest, default=0) / 2
