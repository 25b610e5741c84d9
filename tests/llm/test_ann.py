import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from boxframe.llm.ann import Index, fit, nearest


def brute(rows, query, top):
    scores = [(-float(np.sum(np.array(v) * np.array(query[1]))), i) for uid, (i, v) in enumerate(rows) if uid != query[2]]
    return sorted(scores)[:top]


def test_query_recall(spark, sf_dir):
    from boxframe.llm.queries import op6_nearest_neighbours

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    vectors, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in op6_nearest_neighbours(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        at = np.flatnonzero(ids == q)[0]
        scores = (vectors * vectors[at]).sum(axis=1)
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        for _, i, s in found:
            assert abs(s - scores[np.flatnonzero(ids == i)[0]]) < 1e-12
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        scores[at] = -np.inf
        hits += len({i for _, i, _ in found} & set(ids[np.argsort(-scores)[:20]]))
    assert hits / (20 * len(got)) >= 0.9


def test_small_shelves_crowds_and_lengths(spark):
    """Vectors of unequal length, a third of them equal, over many small shelves."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 8)) * rng.uniform(0.2, 3, (900, 1))
    vectors[:300] = vectors[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, top=5, list_rows=40, shelf_rows=64).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 900, 20):
        scores = (vectors * vectors[q]).sum(axis=1)
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-scores[i], i))[:5]
        hits += len({v for v, _ in found[q].values()} & set(order))
        if q < 300 and scores[0] >= scores.max() - 1e-12:
            assert [found[q][r][0] for r in range(1, 6)] == order
    assert hits / (5 * 45) >= 0.9


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (None, [9.0, 9.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") == 0, top=20).orderBy("rank").collect()]
    assert got == [(0, 1, 8, 1.0), (0, 2, 8, 1.0), (0, 3, 1, 0.5)]
    assert nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest(df.filter("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_graph_search_finds_all_within_ratio():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(2000, 6))
    index = fit(sample, float(np.linalg.norm(sample, axis=1).max()), 40, 10)
    assert isinstance(index, Index) and np.bincount(index.near(index.lift(sample, True), 1.0).argmin(axis=1), minlength=40).max() < 4 * 2000 / 40
    points = index.lift(rng.normal(size=(100, 6)), False)
    true = np.sqrt(((points[:, None] - index.centroids) ** 2).sum(axis=2))
    wanted = true <= 1.3 * true.min(axis=1, keepdims=True)
    found = np.isfinite(index.near(points, 1.3))
    assert (found & wanted).sum() >= 0.99 * wanted.sum() and not (found & ~wanted).any()


def test_query_on_a_centroid():
    """Copies of one vector of the largest norm are their cluster's mean, so queries lie on a centroid."""
    rng = np.random.default_rng(6)
    sample = rng.normal(size=(3000, 8))
    sample *= rng.uniform(0.2, 1, (3000, 1)) / np.linalg.norm(sample, axis=1, keepdims=True)
    sample[:1500] = np.eye(8)[0] * 2
    for lists in (30, 300):
        index = fit(sample, 2.0, lists, 20)
        row, own = index.stored_in(sample)
        member = np.zeros((len(sample), lists), bool)
        member[row, own] = True
        hits = []
        for q in range(1500, 3000, 10):
            reads = np.zeros(lists, bool)
            reads[index.read_by(sample[[q]])[1]] = True
            scores = sample @ sample[q]
            scores[q] = -np.inf
            hits.append(member[np.argsort(-scores, kind="stable")[:20]][:, reads].any(axis=1).mean())
        assert index.read_ratio > 1 and np.mean(hits) >= 0.85


def test_reads_on_until_there_are_enough(spark):
    """Lists of ten near-equal vectors each: twenty others lie in three of them at least."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 8))
    centres *= 3 / np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = np.repeat(centres, 10, axis=0)
    index = fit(vectors, 3.0, 60, 5)
    homes = np.bincount(index.near(index.lift(vectors, True), 1.0).argmin(axis=1), minlength=60)
    row, own, away = index.read_by(vectors, homes, 21)
    assert (np.bincount(row, weights=homes[own]) >= 21).all() and np.isfinite(away).all()
    row, own, _ = index.read_by(vectors[:2], homes, 601)
    assert (np.bincount(row) == 60).all()
    index.read_ratio = 1.0
    assert (np.bincount(index.read_by(vectors)[0]) < 21).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    counts = nearest(df, F.col("vec_id") % 50 == 0, top=20, list_rows=10, recall=0.01).groupBy("query_id").count().collect()
    assert sorted((r.query_id, r["count"]) for r in counts) == [(q, 20) for q in range(0, 600, 50)]


def test_each_length_is_searched_by_itself(spark):
    """One longer vector costs only itself, and two of another length find each other."""
    rows = [(i, [1.0 + i, 1.0]) for i in range(30)] + [(40, [9.0, 9.0, 9.0]), (50, [1.0]), (51, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 10 == 0, top=3).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got == {q: {k: (29 - k + 1, (1.0 + q) * (30 - k + 1) + 1) for k in (1, 2, 3)} for q in (0, 10, 20)} | {50: {1: (51, 2.0)}}


def test_large_components(spark):
    """Squares of these pass the largest double; their products don't."""
    rows = [(i, [1e150 * (1 + i % 7), 1e150 * (i % 5)]) for i in range(60)] + [(60, [1e-3, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = np.array([v for _, v in rows])
    for r in nearest(df, F.col("vec_id") % 20 == 0, top=3).collect():
        assert r.score == (vectors[r.query_id] * vectors[r.vec_id]).sum()
    got = nearest(df.filter("vec_id <> 60").unionByName(spark.createDataFrame([(61, [1e200, 1.0])], df.schema)), F.col("vec_id") % 20 == 0, top=3).collect()
    assert len(got) == 9 and all(r.vec_id == 61 for r in got if r.rank == 1)


def test_few_copies_and_even_lists():
    """Vectors without clusters, whose means would be short and draw all others."""
    rng = np.random.default_rng(8)
    sample = rng.normal(size=(8192, 32))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    index = fit(sample, 1.0, 100, 20)
    row, own = index.stored_in(sample)
    assert 1 < len(row) / len(sample) < 1.5
    assert np.bincount(own, minlength=100).max() < 5 * len(row) / 100 and np.bincount(own, minlength=100).min() > 0


def test_fit_holds_little():
    rng = np.random.default_rng(9)
    sample = rng.normal(size=(8192, 16))
    tracemalloc.start()
    fit(sample, float(np.linalg.norm(sample, axis=1).max()), 2048, 20, rounds=2)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
