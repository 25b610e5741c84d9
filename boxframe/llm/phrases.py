"""Phrase collocations by Toivonen mining: a sample proposes, full passes count exactly until closed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.llm.common import LOWER, UPPER, written

#: Words of one block, which is counted before anything is shuffled, and its distinct words at most.
BLOCK_WORDS, BLOCK_VOCABULARY = 4_000_000, 1 << 20
#: Bits of a set of known phrases: it takes this much memory (two to the power, in bits) whatever the table's size.
SET_BITS = 27
#: Parts of such a set, by which sets of tasks are united.
SET_PARTS = 64
#: Rows that go from Python to Spark, or are looked up, at once.
SLICE = 1 << 16
#: Lower case for A-Z, a line feed for what ends a piece, a space for a tab.
_BYTES = bytes.maketrans((UPPER + ".,;:!?\x0b\x0c\r\t").encode(), (LOWER + "\n" * 9 + " ").encode())
#: A phrase, a line feed and its language are one key, since no word has a line feed.
_ROWS = pa.schema([("key", pa.string()), ("f", pa.int64())])


class _Ids(dict):
    """Numbers of words, from 1; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(w) for w in words), np.uint64, len(words)) ^ np.uint64(of(lang, seed=1))


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their first word or words and of the next."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0x632BE59BD9B4E019))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _slots(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(8 * len(known) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(36)) & mask).astype(np.int64)


def _holds(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a set of bits has the phrases of these hashes; it may say yes of a few others."""
    has = lambda at: (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    found = np.empty(len(hashes), bool)
    for i in range(0, len(hashes), SLICE):
        one, two = _slots(known, hashes[i : i + SLICE])
        found[i : i + SLICE] = has(one) & has(two)
    return found


def _put(known: np.ndarray, hashes: np.ndarray) -> None:
    for at in _slots(known, hashes):
        np.bitwise_or.at(known, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _rows(lang: str, n: int, keys: np.ndarray, bits: int, counts: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Phrases of n words, whose numbers are ``bits`` of a key each, and their counts."""
    for i in range(0, len(keys), SLICE):
        some = keys[i : i + SLICE]
        own = [words.take(pa.array(((some >> (bits * k)) & ((1 << bits) - 1)) - 1)) for k in range(n - 1, -1, -1)]
        phrase = own[0] if n == 1 else pc.binary_join_element_wise(*own, " ")
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(phrase, lang, "\n"), pa.array(counts[i : i + SLICE].astype(np.int64))], schema=_ROWS)


def _counted(lang: str, ids: _Ids, numbers: np.ndarray, longest: int, every: int, known: np.ndarray | None, before: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Counts of a block's phrases of one language.

    Phrases of up to ``every`` words are counted whatever they are. Longer
    ones are if all their parts of a word less are in ``known``, but not if
    all are in ``before``, since then an earlier pass has counted them.
    """
    vocabulary = pa.array(list(ids), pa.binary()).cast(pa.string())
    if every:
        counts = np.bincount(numbers, minlength=len(ids) + 1)[1:]
        yield pa.RecordBatch.from_arrays([pa.array(["\n" + lang]), pa.array([int(counts.sum())])], schema=_ROWS)
        yield from _rows(lang, 1, np.arange(1, len(ids) + 1), 63, counts, vocabulary)
    own = np.append(np.uint64(0), _word_hashes(lang, list(ids)))
    hashes = own[numbers]
    #: For each place: whether a phrase of this many words starts there, its hash, and whether the sets have it.
    starts = numbers > 0
    for n in range(2, longest + 1):
        sets = [None if n <= every else _holds(s, hashes) for s in (known, before) if s is not None]
        starts = starts[:-1] & (numbers[n - 1 :] > 0)
        chosen = starts
        if n > every:
            both = [s[:-1] & s[1:] for s in sets]
            chosen = chosen & both[0] & ~both[1] if len(both) > 1 else chosen & both[0]
        at = np.flatnonzero(chosen)
        bits = 63 // longest
        key = numbers[at].astype(np.int64)
        for i in range(1, n):
            key = (key << bits) | numbers[at + i]
        keys, counts = np.unique(key, return_counts=True)
        del key
        yield from _rows(lang, n, keys, bits, counts, vocabulary)
        if n < longest:
            hashes = _joined(hashes[:-1], own[numbers[n - 1 :]])


def _passed(df: DataFrame, longest: int, every: int, block_words: int, known=None, before=None) -> DataFrame:
    """(lang, words, phrase, f) over all of ``df`` (lang, text): counted in blocks, then summed. Rows of no words have a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [None if s is None else np.frombuffer(s.value, np.uint8) for s in (known, before)]
        ids, numbers, held = defaultdict(_Ids), defaultdict(list), 0

        def put() -> Iterator[pa.RecordBatch]:
            while numbers:
                lang, lists = numbers.popitem()
                yield from _counted(lang, ids.pop(lang), np.concatenate(lists), longest, every, *sets)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = ids[lang]
                found: list[int] = []
                for piece in text.as_py().translate(_BYTES).split(b"\n"):
                    found.extend(map(own.__getitem__, piece.split()))
                    found.append(0)
                numbers[lang].append(np.array(found, np.int32))
                held += len(found)
                if held >= block_words or len(own) >= BLOCK_VOCABULARY:
                    yield from put()
                    held = 0
        yield from put()

    # A block has each phrase once, so there is nothing to sum before rows with a key meet.
    summed = df.mapInArrow(run, "key string, f long").repartition("key").groupBy("key").agg(F.sum("f").alias("f"))
    phrase, lang = F.substring_index("key", "\n", 1), F.expr("substring(key, locate('\n', key) + 1)")
    return summed.select(lang.alias("lang"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), phrase.alias("phrase"), "f")


def _hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """Hashes of phrases, as ``_counted`` makes them."""
    split = pc.split_pattern(phrase, " ")
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    words = np.fromiter(map(xxhash.xxh64_intdigest, split.flatten().cast(pa.binary()).to_pylist()), np.uint64, int(sizes.sum()))
    of = {x: np.uint64(xxhash.xxh64_intdigest(x, seed=1)) for x in pc.unique(lang).to_pylist()}
    own = np.array([of[x] for x in lang.to_pylist()], np.uint64)
    first = np.cumsum(sizes) - sizes
    hashes = words[first] ^ own
    for i in range(1, int(sizes.max(initial=1))):
        longer = np.flatnonzero(sizes > i)
        hashes[longer] = _joined(hashes[longer], words[first[longer] + i] ^ own[longer])
    return hashes


def _united(phrases: DataFrame, bits: int, old=None) -> bytes:
    """A set of the phrases (lang, phrase), with those of the set ``old``: of fixed size, so the driver may hold it."""
    size = (1 << bits) // 8 // SET_PARTS

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(size * SET_PARTS, np.uint8)
        for batch in batches:
            if batch.num_rows:
                _put(known, _hashes(batch.column(0), batch.column(1)))
        parts = known.reshape(SET_PARTS, size)
        used = np.flatnonzero(parts.any(axis=1))
        for i in used:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], ["part", "bits"])

    def unite(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(size, np.uint8)
        for batch in rows:
            for bits in batch.column("bits"):
                whole |= np.frombuffer(bits.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["part", "bits"])

    known = np.zeros(size * SET_PARTS, np.uint8) if old is None else np.frombuffer(old.value, np.uint8).copy()
    made = phrases.select("lang", "phrase").mapInArrow(make, "part int, bits binary").groupBy("part").applyInArrow(unite, "part int, bits binary")
    for row in made.collect():
        known[row.part * size : (row.part + 1) * size] |= np.frombuffer(row.bits, np.uint8)
    return known.tobytes()


def _failed(frequent: DataFrame, known) -> DataFrame:
    """Frequent phrases that the set ``known`` lacks: the border's failures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~_holds(bits, _hashes(batch.column(0), batch.column(1)))))

    return frequent.select("lang", "phrase").mapInArrow(run, "lang string, phrase string")


def frequent_phrases(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, sample: float = 0.3, slack: float = 1.0, block_words: int = BLOCK_WORDS, bits: int = SET_BITS, passes: list | None = None) -> DataFrame:
    """(lang, words, phrase, f): all phrases of 1 to ``longest`` words that occur ``least`` times or more, with exact counts; rows of 0 words have a language's words.

    Toivonen's way: phrases of a sample of the documents (a share, by a hash
    of the text) that are frequent there at a lowered threshold are proposed.
    A pass over all documents counts every word, and each longer phrase whose
    parts of a word less are proposed, that is, the proposed phrases and
    their negative border. Where one is frequent that wasn't proposed, the
    border failed, and a further pass counts the phrases that this one adds,
    until none is missing. What is proposed is known to the tasks as a bit
    set of fixed size; a phrase taken for a proposed one is only counted in
    vain. ``bits`` is the size of that set (two to the power), ``block_words``
    how many words are counted together; neither changes the result.
    ``passes`` gets the number of failures after each pass.
    """
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words at most")
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    proposed = _passed(rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < round(sample * 1_000_000)), longest - 1, longest - 1, block_words)
    known = spark.sparkContext.broadcast(_united(proposed.filter((F.col("words") > 0) & (F.col("f") >= max(1, int(least * sample * slack)))), bits))
    before, parts = None, []
    while True:
        counted = _passed(rows, longest, 0 if parts else 1, block_words, known, before)
        parts.append(written(counted.filter((F.col("words") == 0) | (F.col("f") >= least)), "phrases"))
        missing = written(_failed(parts[-1].filter(F.col("words").between(1, longest - 1)), known), "phrases-missing")
        failures = missing.count()
        if passes is not None:
            passes.append(failures)
        if not failures:
            return reduce(DataFrame.unionByName, parts)
        before, known = known, spark.sparkContext.broadcast(_united(missing, bits, known))


def _words(at: str, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(F.split(at, " "), start, length), " ")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, inside: int = 50, top: int | None = 2000, **mining) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two to ``longest`` words by how their words attract one another.

    A-Z are lower-cased, texts are cut into pieces at ``.,;:!?`` and line
    ends, these into words at spaces and tabs. A phrase that occurs a times
    (``least`` at least) and is cut into two parts with l and r occurrences
    scores floor(1000000 a a / (l r)); the cut that scores least counts, of
    equal ones the first. Phrases inside a longer one that occurs ``inside``
    percent as often or more are left out. Each language's first ``top`` (all,
    if None) come by score, then a (both descending), then phrase. n is the
    number of the language's words. Numbers are exact (decimals of 38 digits,
    enough for a below 10 to the 16th). ``mining`` goes to ``frequent_phrases``.

    Defined cases: a null language is ``und``; null text is empty; repeated
    rows count as often as they stand; ties are ordered by the phrase, so
    ranks are the same in every run; an empty table gives an empty result;
    other columns of ``df`` are not looked at.
    """
    known = frequent_phrases(df, lang_col, text_col, least, longest, **mining)
    part = lambda name, f: known.filter(F.col("words") > 0).select(F.col("lang").alias("lang_"), F.col("phrase").alias(name), F.col("f").alias(f))
    candidates = known.filter(F.col("words") > 1).select("lang", "words", "phrase", F.col("f").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", _words("phrase", F.lit(1), F.col("k")).alias("first"), _words("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(part("first_", "l"), F.expr("lang = lang_ and first = first_")).drop("lang_").join(part("rest_", "r"), F.expr("lang = lang_ and rest = rest_")).drop("lang_")
    big = lambda c: F.col(c).cast("decimal(16,0)")
    cuts = cuts.withColumn("over", (big("a") * big("a")).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", (big("l") * big("r")).cast("decimal(32,0)"))
    cuts = cuts.withColumn("score", F.expr("cast(over div under as bigint)"))
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, n), " "))))).alias("inner_")
    longer = candidates.filter("words > 2").select(F.col("lang").alias("lang_"), inner, "a").groupBy("lang_", "inner_").agg(F.max("a").alias("f_longer"))
    left = scored.join(longer, F.expr("lang = lang_ and phrase = inner_"), "left").filter(f"f_longer is null or 100 * f_longer < {inside} * a")
    total = known.filter("words = 0").groupBy(F.col("lang").alias("lang_")).agg(F.sum("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    placed = left.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    if top is not None:
        # Within a part of a language first, so that no task gets all of it.
        salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
        placed = placed.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= top)
    placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        placed = placed.filter(F.col("rank") <= top)
    return placed.join(total, F.expr("lang = lang_")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
