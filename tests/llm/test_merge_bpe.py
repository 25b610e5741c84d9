import hashlib
import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxframe.llm.merge_bpe import Merges, chunks_of, decoded, encode, load, tokenize

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return np.frombuffer(encode(text, load(PATH), chunks_of(PATH)), "<u4").tolist()


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_random_texts(plain):
    rng = random.Random(1)
    for alphabet in ("ab", "aeinrst ", "aA0 .é\n", "=-_ ", " \t\n 　x", "日本語текст😀 "):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(200)]
        for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids_of(text) == want.ids, text


def test_added_tokens_in_texts(plain):
    end = "<|endoftext|>"
    for text in (end, f"a {end} b", f"{end}{end}", f" {end}\n", f"<|{end}|>", f"don't{end}'t", "<|endoftext", f"x {end[:-1]}{end}  "):
        want = plain.encode(text, add_special_tokens=False).ids
        assert ids_of(text) == want
        assert decoded(np.array(want, "<u4").tobytes(), load(PATH)) == plain.decode(want, skip_special_tokens=False).encode()


def slow(merges, data):
    """Merging by looking at all pairs again each time."""
    own = [merges.start[b] for b in data]
    while True:
        best = min(((r, i) for i in range(len(own) - 1) if (r := merges.rank.get(own[i] << 32 | own[i + 1])) is not None), default=None)
        if best is None:
            return own
        own[best[1] : best[1] + 2] = [merges.makes[best[0]]]


def test_queue_against_plain_merging():
    rng, merges = random.Random(2), load(PATH)
    for _ in range(500):
        data = bytes(rng.choice(b"then aing=\xc3\xa9") for _ in range(rng.randrange(1, 40)))
        assert merges.merge(data) == slow(merges, data)


def test_long_pieces(plain):
    for text in ("a" * 20_000, "=" * 9_999, " " * 5_001 + "x", "ab" * 8_000, "\n" * 3_000, "é" * 4_000):
        assert ids_of(text) == plain.encode(text, add_special_tokens=False).ids
    assert len(load(PATH).merge(b"a" * 1_000_000)) > 1_000


def test_broken_bytes_become_replacements():
    merges = load(PATH)
    half = np.array([merges.start[0xC3], merges.start[0x41]], "<u4").tobytes()
    assert decoded(half, merges) == "�A".encode()


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"added_tokens": [dict(spec["added_tokens"][0], lstrip=True)]}):
        path = tmp_path / "own.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            Merges(str(path))


def test_cases(spark, plain):
    texts = [None, "", " ", "  \n\t x", "a" * 5000, "<|endoftext|> don't I'LL", "日本語 текст 😀   ", "\x00\x7f", "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id int, text string, ids string")
    rows = tokenize(df, PATH).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        want = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
    assert tokenize(df.limit(0), PATH).count() == 0
    assert tokenize(df.withColumn("more", F.lit(1)), PATH, with_ids=False).columns == ["doc_id", "text", "ids", "more", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registered_query_against_the_library(spark, sf_dir, plain):
    from boxframe.llm.queries import op12_merge_bpe

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op12_merge_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(back.encode()))
