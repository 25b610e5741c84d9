import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from boxframe.llm.toxicity import fit, held_out, score, term_ids, train


def test_pairs_are_learned():
    """Toxic only where both terms meet: no sum of weights can say that."""
    rng = random.Random(1)
    rows = [sorted(rng.sample(range(6), rng.randrange(4))) for _ in range(3000)]
    labels = np.array([float({0, 1} <= set(r)) for r in rows])
    model = fit([np.array(r, np.int64) for r in rows], labels, np.arange(6), decay=1e-3)
    odds = [model.score([int(x) for x in r]) for r in rows]
    assert np.mean((np.array(odds) >= 0.5) == labels) > 0.99


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = fit([np.array([0, 2]), np.array([1])], np.array([1.0, 0.0]), np.array([10, 20, 30]), epochs=3)
    at = [0, 1, 2]
    odds = model.bias + model.weights.sum() + sum(model.factors[i] @ model.factors[j] for i in at for j in at if i < j)
    assert np.isclose(model.score([10, 20, 30, 77]), 1 / (1 + np.exp(-odds)))
    assert model.score([]) == model.score([99]) and rng is not None


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = train(docs, labels)
    rows = score(docs.join(labels, "doc_id"), model).filter(held_out("doc_id")).select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.85 and hit / sum(r.predicted for r in rows) > 0.9
    again = train(docs.repartition(5), labels)
    assert again.bias == model.bias and (again.weights == model.weights).all()


def test_held_out_rows(spark):
    ids = [0, 1, 2, 77, 10**12, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out("doc_id").alias("h")).collect()
    assert [r.h for r in rows] == [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]


def test_hard_rows(spark):
    df = spark.createDataFrame([(1, None, 9.0), (2, "", None), (3, "Bad " * 50_000, None), (3, "bad", None), (None, "bad", None)], "doc_id long, text string, score double")
    for rows in ([], [(1, 1), (2, None), (None, 0)], [(3, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = score(df, train(df, labels)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert got[0].score == got[1].score and got[2].score == got[3].score
    assert score(df.limit(0), train(df, labels)).count() == 0
    assert sorted(term_ids("Bad BAD")) == term_ids("bad") and df.columns == ["doc_id", "text", "score"] and F is not None


def test_a_pair_of_common_terms_is_learned_from_texts(spark):
    """Toxic where two words meet that are each as common in clean texts."""
    rng = random.Random(3)
    words = ["north", "south", "east", "west", "up", "down"]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(1, 4)))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("north" in t and "down" in t)) for i, t in rows], "doc_id long, toxic int")
    got = score(docs.filter(held_out("doc_id")), train(docs, labels)).collect()
    assert np.mean([r.predicted == ("north" in r.text and "down" in r.text) for r in got]) > 0.98


def test_query_against_a_plain_scorer(spark, sf_dir):
    """Every row of the query, by a loop over pairs with the trained model."""
    from boxframe.llm.queries import op8_toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    place = {int(t): i for i, t in enumerate(model.ids)}
    df = op8_toxicity(spark, sf_dir)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and [f.dataType.simpleString() for f in df.schema.fields[1:]] == ["boolean", "double", "int"]
    got = {r.doc_id: r for r in df.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        at = sorted(place[t] for t in set(term_ids(texts[i])) if t in place)
        odds = model.bias + sum(float(model.weights[a]) for a in at) + sum(float(model.factors[a] @ model.factors[b]) for n, a in enumerate(at) for b in at[:n])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(odds, -30, 30)))) < 1e-9
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
