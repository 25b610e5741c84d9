import math
from collections import Counter

from pyspark.sql import functions as F

from boxframe.llm.sharding import communication_matrix, hypergeometric, shuffle_to_shards


def cdf(total, good, drawn):
    ways = {k: math.comb(good, k) * math.comb(total - good, drawn - k) for k in range(max(0, drawn + good - total), min(good, drawn) + 1)}
    return {k: w / math.comb(total, drawn) for k, w in ways.items()}


def test_hypergeometric_is_exact(spark):
    for total, good, drawn in [(10, 4, 5), (60, 30, 7), (5, 5, 3), (7, 0, 4), (9, 3, 9), (8, 2, 0)]:
        n = 1000
        u = (F.col("id") + 0.5) / n
        rows = spark.range(n).select(hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), u).alias("x")).groupBy("x").count().collect()
        seen = {r.x: r["count"] / n for r in rows}
        for k, p in cdf(total, good, drawn).items():
            assert abs(seen.get(k, 0) - p) < 2 / n, (total, good, drawn, k)
    big = spark.range(60).select(hypergeometric(F.lit(10**8), F.lit(10**7), F.lit(5 * 10**7), (F.col("id") + 0.5) / 60).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(big[0] - 5e6) < 100 and abs(big[1] / math.sqrt(5e7 * 0.1 * 0.9 * 0.5) - 1) < 0.05


def test_matrix_adds_up(spark):
    blocks = spark.createDataFrame([(i, n) for i, n in enumerate([5, 0, 17, 100, 3, 1, 40])], "block int, n long")
    rows = communication_matrix(blocks, 4).collect()
    assert len(rows) == 7 and all(sum(r.counts) == r.n and min(r.counts) >= 0 for r in rows)
    assert sorted(sum(r.counts[j] for r in rows) for j in range(4)) == [41, 41, 42, 42]
    means = Counter()
    for seed in range(12):
        for r in communication_matrix(blocks, 4, seed).collect():
            means[r.block] += r.counts[0] / 12
    assert abs(means[3] - 25) < 4


def test_shards(spark):
    df = spark.range(0, 10_007, 1, 5).select(F.col("id").alias("doc_id"), F.lit("clash").alias("slot"), F.lit(None).cast("string").alias("uid"))
    for block_rows in (100_000, 150):
        rows = shuffle_to_shards(df, 8, block_rows=block_rows).collect()
        assert sorted(r.doc_id for r in rows) == list(range(10_007))
        by = {j: sorted(r.slot for r in rows if r.shard == j) for j in range(8)}
        assert all(slots == list(range(len(slots))) for slots in by.values())
        assert sorted(map(len, by.values())) == [1250] + [1251] * 7
        first = [r.doc_id for r in rows if r.shard == 0]
        assert abs(sum(first) / len(first) - 5003) < 400
        half = [r.slot for r in rows if r.doc_id < 2000]
        assert abs(sum(half) / len(half) - 625) < 60
    assert rows[0].asDict().keys() == {"doc_id", "uid", "shard", "slot"}
    again = {r.doc_id: (r.shard, r.slot) for r in shuffle_to_shards(df, 8, block_rows=150).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_hard_tables(spark):
    df = spark.createDataFrame([(None, None)] * 9 + [(1, "x")] * 7, "doc_id long, shard string")
    rows = shuffle_to_shards(df, 3).collect()
    assert sorted(Counter(r.shard for r in rows).values()) == [5, 5, 6] and sum(r.doc_id is None for r in rows) == 9
    assert shuffle_to_shards(df.limit(0), 3).count() == 0
    assert len(shuffle_to_shards(df.limit(2), 8).collect()) == 2


def test_query(spark, sf_dir):
    from boxframe.llm.queries import op4_hypergeometric_sharding

    rows = op4_hypergeometric_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    import zlib

    assert len(rows) == len(docs)
    for r in rows:
        data = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
