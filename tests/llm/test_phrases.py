import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from boxframe.llm.phrases import collocations, frequent_phrases
from boxframe.llm.queries import ORACLE_SQL, op13_phrase_collocations
from tests.oracle import difference

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counts(rows, longest=3):
    found = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, longest + 1):
                found[lang or "und"].update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return found


def plain(rows, least=10, longest=3, inside=50, top=2000):
    for lang, f in counts(rows, longest).items():
        total = sum(n for p, n in f.items() if " " not in p)
        candidates = {p: n for p, n in f.items() if n >= least and " " in p}
        scored = []
        for p, a in candidates.items():
            words = p.split(" ")
            if any(len(q) > len(p) and f" {p} " in f" {q} " and 100 * b >= inside * a for q, b in candidates.items()):
                continue
            cuts = []
            for k in range(1, len(words)):
                x, y = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1_000_000 * a * a // (x * y), k, x, y))
            score, _, x, y = min(cuts)
            scored.append((-score, -a, p.encode(), x, y))
        for rank, (score, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            yield lang, rank, p.decode(), -a, x, y, total, -score


def made(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "é", "É", "of", "the", "a", "日本", "x1", "\x00", "\x1c"]
    ends = [" ", " ", "  ", "\t", ". ", ",", "\n", "!", "\x0b"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(30)))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, lang string, text string").repartition(3)


def test_against_plain_reading(spark):
    rows = [*made(1, 200), ("en", None), ("en", ""), (None, " . "), ("fr", "only once")]
    for least, top in ((10, 2000), (2, 7), (1, 2000)):
        got = {tuple(r) for r in collocations(frame(spark, rows), least=least, top=top).collect()}
        assert got == set(plain(rows, least=least, top=top))
    two = {tuple(r) for r in collocations(frame(spark, rows), longest=2, inside=0, top=None).collect()}
    assert two == set(plain(rows, longest=2, inside=0, top=10**9))


def test_border_failures_are_counted_until_closed(spark):
    rows = made(2, 150)
    want = {(lang, p): n for lang, f in counts(rows).items() for p, n in f.items() if n >= 5}
    for sample in (0.0, 0.05, 0.5, 1.0):
        passes = []
        got = frequent_phrases(frame(spark, rows), least=5, sample=sample, passes=passes).filter("words > 0").collect()
        assert len(got) == len(want) and {(r.lang, r.phrase): r.f for r in got} == want
        assert passes[-1] == 0 and (len(passes) > 1) == (sample < 1)


def test_small_blocks_and_small_sets(spark):
    rows = made(3, 80)
    want = set(plain(rows, least=3))
    for more in ({"block_words": 50}, {"block_words": 200, "bits": 9, "sample": 0.1}):
        assert {tuple(r) for r in collocations(frame(spark, rows), least=3, **more).collect()} == want


def test_scores_beyond_64_bits(spark):
    # 3,000,000 occurrences of one pair: 10^6 a a is 9 * 10^18 and l r the square of 3,000,000.
    rows = spark.range(30).select(F.lit("en").alias("lang"), F.expr("repeat('big deal. ', 100000)").alias("text"))
    assert [tuple(r) for r in collocations(rows).collect()] == [("en", 1, "big deal", 3_000_000, 3_000_000, 3_000_000, 6_000_000, 1_000_000)]


def test_defined_cases(spark):
    df = frame(spark, made(4, 20)).withColumn("phrase", F.lit(1)).withColumn("rank", F.lit("x"))
    assert collocations(df.limit(0)).count() == 0
    assert collocations(df, least=2).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations(df.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_registered_query_against_sql(spark, sf_dir):
    assert difference(spark, sf_dir, op13_phrase_collocations, ORACLE_SQL["op13_phrase_collocations"]) is None
