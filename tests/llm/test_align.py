import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from boxframe.llm import align as module
from boxframe.llm.align import align, shared_ends
from boxframe.llm.merge_bpe import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """The groups of a text, from the libraries' ids and a walk along both sides."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two, letter = sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()

    def groups(text):
        if not text:
            return []
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        spell_a = [bytes(letter[c] for c in one.id_to_token(i)) for i in a]
        spell_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + text).encode()
        if b"".join(spell_a) != whole or b"".join(spell_b) != whole:
            return []
        ends = [set(np.cumsum([len(x) for x in s]).tolist()) for s in (spell_a, spell_b)]
        out, sides = [], []
        for ids, spelled in ((a, spell_a), (b, spell_b)):
            at, own, lists = 0, [], []
            for i, x in zip(ids, spelled, strict=True):
                own.append(i)
                at += len(x)
                if at in ends[0] & ends[1]:
                    lists.append((at, own))
                    own = []
            sides.append(lists)
        for (stop, own_a), (_, own_b) in zip(*sides, strict=True):
            out.append((stop, own_a, own_b))
        return out

    return groups


def brute(texts, plain):
    """The contract's columns, text by text."""
    groups = [plain(t) for t in texts]
    links = [Counter((x, y) for _, a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for own in links for p in own)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    for g, own in zip(groups, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, a, b in g)
        yield (
            sum(len(a) for _, a, _ in g),
            sum(len(b) for _, _, b in g),
            len(g),
            sum(own.values()),
            sum(n for p, n in own.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(said.encode()).hexdigest() if g else "",
        )


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_shared_ends_against_sets():
    rng = random.Random(1)
    for _ in range(400):
        ends_a, ends_b, starts, stops = [], [], [], []
        end = 0
        for _ in range(rng.randrange(1, 5)):
            n = rng.randrange(1, 300)
            often = rng.choice([0.02, 0.3, 0.9])
            a, b = ([i for i in range(1, n) if rng.random() < often] + [n] for _ in range(2))
            starts.append(len(ends_a))
            ends_a += [end + i for i in a]
            ends_b += [end + i for i in b]
            stops.append(len(ends_a))
            end += n
        cut_a, cut_b = shared_ends(*(np.array(x) for x in (ends_a, ends_b, starts, stops)))
        assert np.array(ends_a)[cut_a].tolist() == np.array(ends_b)[cut_b].tolist() == sorted({*ends_a} & {*ends_b})


def test_long_stretches_without_cuts():
    # Even ends here, odd ends there, but for the last of both.
    n = 400_000
    cuts, _ = shared_ends(np.append(np.arange(2, n, 2), n + 1), np.append(np.arange(1, n, 2), n + 1), np.array([0]), np.array([n // 2]))
    assert len(cuts) == 1


TEXTS = [None, "", " ", "a", "plain words here", "double  spaces   in it ", " leads", "tab\tand\nline\r\n", "<|endoftext|> <s> </s> <unk>", "▁ low line", "日本語 текст 😀", "é ﬁ ①", "=" * 500, "ab" * 700, "x" * 300 + " y", "\x00\x7f \x1c.", " no　break", "same text", "same text", "don't we'll", " " * 40 + "z"]


def test_cases(spark, plain):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id int, text string, groups string, block int")
    rows = align(df.repartition(3), A, B).sort("doc_id").collect()
    for r, want in zip(rows, brute(TEXTS, plain), strict=True):
        assert tuple(r[c] for c in COLUMNS) == want, r.text
        assert [(g.stop, g.a, g.b) for g in r.groups] == plain(r.text)
        assert r.block == 1
    assert align(df.limit(0), A, B).count() == 0
    assert align(df.withColumn("n_a", F.lit("old")), A, B, with_groups=False).columns == ["doc_id", "text", "groups", "block", *COLUMNS]
    empty = align(df.filter("text = ''"), A, B, keep=["doc_id"]).first()
    assert (empty.n_a, empty.count_sum, empty.groups_sha256, empty.groups) == (0, 0, "", [])


def test_wide_groups_and_small_blocks(spark, plain, monkeypatch):
    monkeypatch.setattr(module, "WIDE", 4)
    p, q = np.array([1, 3, 2]), np.array([2, 2, 5])
    a, b, doc = np.array([7, 7, 8, 7, 9, 9]), np.array([1, 2, 1, 1, 3, 3, 3, 1, 3]), np.array([0, 0, 1])
    keys, times = module._pairs(a, b, p, q, doc, 100)
    want = Counter((0, 7 * 100 + y) for y in (1, 2)) + Counter((0, x * 100 + y) for x in (7, 8, 7) for y in (1, 1)) + Counter((1, x * 100 + y) for x in (9, 9) for y in (3, 3, 3, 1, 3))
    assert dict(zip(((int(k) >> 40, int(k) & ((1 << 40) - 1)) for k in keys), times.tolist(), strict=True)) == want
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").coalesce(1)
    table = align(rows, A, B, keep=["doc_id"], with_groups=False, block_bytes=60).sort("doc_id").collect()
    assert [tuple(r)[1:] for r in table] == list(brute(TEXTS, plain))


def test_registered_query_against_brute_force(spark, sf_dir, plain):
    from boxframe.llm.queries import op11_token_alignment

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").sort("doc_id").collect()
    rows = op11_token_alignment(spark, sf_dir).sort("doc_id").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in docs]
    assert [tuple(r[c] for c in COLUMNS) for r in rows] == list(brute([r.text for r in docs], plain))
