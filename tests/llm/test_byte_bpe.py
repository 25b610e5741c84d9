import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from boxframe.llm.byte_bpe import Chunks, Pieces, PrefixEncoder, decode, encode, load, tokenize

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return load(PATH)


@pytest.fixture(scope="module")
def plain(vocabulary):
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_random_bytes(vocabulary):
    whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(1)
    for alphabet in ("ab", "aeinrst ", "aA0 .é\n", "=-_ "):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))
            encoder = PrefixEncoder(vocabulary, text.encode())
            assert encoder.ids() == whole.encode_ordinary(text)


def test_appends_and_edits(vocabulary):
    rng = random.Random(2)
    data, grown = b"", PrefixEncoder(vocabulary)
    for _ in range(200):
        if rng.random() < 0.4:
            more = bytes(rng.choice(b"then aing") for _ in range(rng.randrange(1, 30)))
            grown.append(more)
            data += more
        else:
            a, b = sorted(rng.randrange(len(data) + 1) for _ in range(2))
            b = min(b, a + 5)
            new = bytes(rng.choice(b"then aing") for _ in range(rng.randrange(4)))
            grown.replace(a, b, new)
            data = data[:a] + new + data[b:]
        fresh = PrefixEncoder(vocabulary, data)
        assert grown.data == data and grown.last == fresh.last and grown.ids() == fresh.ids()
    words = b" ".join([b"something"] * 2000)
    long = PrefixEncoder(vocabulary, words)
    assert long.replace(50, 52, b"zz") < 1000
    assert long.ids(60) == PrefixEncoder(vocabulary, long.data[:60]).ids()


def test_documents_against_tiktoken(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in tokenize(docs, PATH, P.PATTERN, keep=["doc_id"]).collect()}
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text)
        g = got[r.doc_id]
        assert g.ids == ids and g.n_tokens == len(ids) and g.ids_sha256 == digest(ids)
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_spaces(vocabulary, plain):
    rng, chunks = random.Random(3), Chunks(Pieces(vocabulary), P.PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b1", "'s", "'", ".", " ", " ", " ", "\n", "\t", "\u00a0", "\x1c", "\x85", "é"]) for _ in range(rng.randrange(12)))
        ids = plain.encode_ordinary(text)
        assert encode(text, chunks) == encode(text, chunks, False) == np.array(ids, dtype="<u4").tobytes(), text


def test_hard_texts(spark, plain, vocabulary):
    texts = [None, "", " ", "  \n\t x", "a" * 5000, "<|endoftext|> don't I'LL", "日本語 текст 😀   ", "1234567 ½ ²", "=" * 3000, "\x00\x7f"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id int, text string, ids string")
    rows = tokenize(df, PATH, P.PATTERN).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        assert r.ids == plain.encode_ordinary(texts[r.doc_id] or "")
    assert tokenize(df.limit(0), PATH, P.PATTERN).count() == 0
    chunks = Chunks(Pieces(vocabulary), P.PATTERN)
    tokens = [vocabulary.bytes.get(i, b"") for i in range(50256)]
    assert all(decode(encode(t, chunks, s), tokens) == (t or "").encode() for t in texts for s in (True, False))
    assert tokenize(df.withColumn("more", F.lit(1)), PATH, P.PATTERN, with_ids=False).columns == ["doc_id", "text", "ids", "more", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registered_query_against_the_library(spark, sf_dir, plain):
    from boxframe.llm.queries import op5_byte_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(ids), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
