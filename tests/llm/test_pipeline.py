from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from boxframe.llm.common import checkpointed
from boxframe.llm.mixing import mix
from boxframe.llm.simhash import fingerprint

from .test_simhash import brute


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "mixing", "byte_bpe"]
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
        seen.append(docs)
        if len(seen) < 4:
            assert docs.columns == start
    clean, single, mixed, done = (d.collect() for d in seen)
    prints = [fingerprint(r.text) for r in single]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert {r.doc_id for r in single} == set(brute({r.doc_id: fingerprint(r.text) for r in clean}).values())
    copies = {r.doc_id: r.copies for r in mix(seen[1]).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({d: c for d, c in copies.items() if c})
    assert Counter(r.doc_id for r in done) == Counter(r.doc_id for r in mixed)
    by = defaultdict(set)
    for r in done:
        by[r.doc_id].add((r.n_tokens, r.ids_sha256, len(r.ids)))
    assert all(len(x) == 1 for x in by.values())
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").collect()
    assert Counter(again) == Counter((r.doc_id, r.ids_sha256) for r in done)


def test_extra_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    more = ["score", "predicted", "size", "copies", "target", "__id", "fp", "component_id"]
    wide = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in more))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns, name
        assert all(r[c] == f"own {c}" for r in got.select(*more).collect() for c in more), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide.limit(0), sf_dir).count() == 0, name
