import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxframe.llm.components import components
from boxframe.llm.simhash import fingerprint, forest, links, near_dedup, simhash_components


def brute(prints, radius=3):
    """node -> least node reached, comparing all pairs."""
    parent = {n: n for n in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(prints)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def near(seed, n):
    rng = random.Random(seed)
    heart, out = rng.getrandbits(64), []
    for _ in range(n):
        x = heart if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.append(x - 2**64 if x >> 63 else x)
    return out


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_forest_joins_what_pairs_join(radius):
    prints = near(radius, 120)
    found = defaultdict(set)
    parent = list(range(len(prints)))
    for i, j in forest(prints, radius):
        parent[j] = i
    for i, p in enumerate(parent):
        found[p].add(i)
    wanted = defaultdict(set)
    for n, c in brute(dict(enumerate(prints)), radius).items():
        wanted[c].add(n)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize("tile", [3, 8192])
def test_links_against_all_pairs(spark, tile):
    prints = dict(enumerate(dict.fromkeys(near(7, 150))))
    nodes = spark.createDataFrame(list(prints.items()), "node long, fp long")
    got = dict.fromkeys(prints) | {r.node: r.component for r in components(links(nodes, 3, tile=tile)).collect()}
    assert {n: n if c is None else c for n, c in got.items()} == brute(prints)


def test_long_path_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components(edges).collect()} == {0}


def test_fingerprint_follows_spark_hash(spark):
    text = "The  cat\tsat ON the mat É"
    words = [w for w in "the cat sat on the mat É".split()]
    rows = spark.createDataFrame([(" ".join(words[i : i + 3]),) for i in range(len(words) - 2)], "s string").select(F.xxhash64("s").alias("h")).collect()
    bits = sum((2 * sum(r.h >> b & 1 for r in rows) > len(rows)) << b for b in range(64))
    assert fingerprint(text) == bits
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("A b") == fingerprint("a\nb") != 0


def test_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in simhash_components(docs).collect()}
    wanted = brute({r.doc_id: fingerprint(r.text) for r in docs.collect()})
    assert {n: r.component_id for n, r in got.items()} == wanted
    assert {n: r.fingerprint for n, r in got.items()} == {r.doc_id: f"{fingerprint(r.text):016x}" for r in docs.collect()}


def test_hard_rows(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, "one", None), (3, "one", None), (None, "one", "x"), (None, "two", "y"), (None, "two", "z"), (9, long, "x"), (8, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("clash"))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash_components(df).collect())
    assert [x for x in got if x[0] in "12"] == [("1", "0" * 16, "1"), ("2", "0" * 16, "1")]
    assert sum(x[2] == "3" for x in got) == 3 and sum(x[2] == "None" for x in got) == 2 and sum(x[2] == "8" for x in got) == 2
    kept = sorted((str(r.doc_id), r.text[:3] if r.text else r.text) for r in near_dedup(df).collect())
    assert kept == [("1", None), ("3", "one"), ("8", "w0 "), ("None", "two")]
    assert near_dedup(df).columns == df.columns
    twice = spark.createDataFrame([(3, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "quite another text here"), (5, "quite another text here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:5]) for r in near_dedup(twice).collect()) == [(3, "alpha"), (5, "quite")]
    assert simhash_components(df.limit(0)).count() == 0


def test_registered_query_against_all_pairs(spark, sf_dir):
    from boxframe.llm.queries import op3_simhash_near_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in docs}
    wanted = brute(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {n: (f"{prints[n]:016x}", wanted[n]) for n in prints}


def test_any_column_names(spark):
    rows = [(i, f"text number {i // 2} and more of it", "a", "b", "c") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __print string, gone string")
    kept = near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))
    assert near_dedup(df.limit(0)).count() == 0
