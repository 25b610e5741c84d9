"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.llm.common import checkpointed

_WORD = re.compile(r"\w+")
#: Starts of words that are terms of their own, for inflected and compound forms.
STARTS = (4, 5, 6)


def term_ids(text: str | None) -> list[int]:
    """Distinct hashed terms of a text: its words in lower case, and starts of longer words. 31 bits each."""
    words = set(_WORD.findall((text or "").lower()))
    terms = words | {word[:n] + "*" for n in STARTS for word in words if len(word) > n}
    digest = xxhash.xxh32_intdigest
    return [digest(t) >> 1 for t in terms]


@dataclass
class FactorizationMachine:
    """Log odds b + sum w_i + sum over pairs <v_i, v_j> of the terms a text holds.

    Only hashed terms in ``ids`` (ascending) have weights: those that tell
    most in training. Other terms count nothing.
    """

    ids: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def known(self, terms: list[int]) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(0, np.int64)
        own = np.array(terms, np.int64)
        at = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
        return np.sort(at[self.ids[at] == own])

    def score(self, terms: list[int]) -> float:
        at = self.known(terms)
        v = self.factors[at]
        odds = self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their number in ``rows``, ``n`` of them."""
    return np.column_stack([np.bincount(rows, values[:, i], n) for i in range(values.shape[1])])


def fit(examples: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, rank: int = 8, epochs: int = 30, batch: int = 128, rate: float = 0.02, decay: float = 1e-2, seed: int = 42) -> FactorizationMachine:
    """Logistic loss by Adam over shuffled batches; ``examples`` are sorted places in ``ids``."""
    rng = np.random.default_rng(seed)
    k = len(ids)
    share = np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3)
    theta = [np.array([np.log(share / (1 - share))]), np.zeros(k), rng.normal(0, 0.05, (k, rank))]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            rows = np.repeat(np.arange(len(chosen)), [len(examples[j]) for j in chosen])
            at = np.concatenate([examples[j] for j in chosen]) if len(rows) else np.zeros(0, np.int64)
            b, w, v = theta
            held = v[at]
            sums = _sums(rows, held, len(chosen))
            squares = np.bincount(rows, (held**2).sum(axis=1), len(chosen))
            odds = b[0] + np.bincount(rows, w[at], len(chosen)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels[chosen]) / len(chosen)
            slopes = [np.array([error.sum()]), np.bincount(at, error[rows], k) + decay / batch * w, decay / batch * v]
            slopes[2] += _sums(at, error[rows, None] * (sums[rows] - held), k)
            step += 1
            for t, m, s, g in zip(theta, first, second, slopes, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                t -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(ids, float(theta[0][0]), theta[1], theta[2])


def held_out(id_col: str) -> Column:
    """Rows never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 16_384, max_terms: int = 4_096, min_rows: int = 3, min_ratio: float = 10.0, max_common: int = 256) -> FactorizationMachine:
    """A model fit on at most ``max_rows`` labelled rows that aren't held out.

    Rows are taken in the order of a hash of their id; of several texts with
    one id, the least in code point order. The ids chosen are broadcast (their
    number is bounded), so texts aren't shuffled to find them. Terms are
    counted by Spark; the ``max_terms`` with the largest likelihood ratio, of
    those more common among labels 1, in at least ``min_rows`` of them and
    with a log likelihood ratio of ``min_ratio`` or more, are the model's, and
    of the others the ``max_common`` most common ones that half of the rows
    lack, which matter in pairs only. What reaches the driver is bounded by
    these parameters: terms chosen and, for each row, which of them it holds.
    """
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = found.groupBy("id", "label").agg(F.min("text").alias("text"))

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                terms = [term_ids(text.as_py()) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.int32()))], ["label", "terms"])

    rows = checkpointed(found.select("label", "text").mapInArrow(terms_of, "label int, terms array<int>"))
    all_rows, all_bad = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    none = np.zeros(0, np.int64)
    if not 0 < all_bad < all_rows:
        return fit([none] * all_rows, np.full(all_rows, float(all_bad > 0)), none, epochs=0)
    counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("n"), F.sum("label").cast("double").alias("bad"))
    counted = checkpointed(counted.filter(F.col("n") >= min_rows))
    n, bad = F.col("n"), F.col("bad")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    rate = all_bad / all_rows
    ratio = part(bad, n * rate) + part(n - bad, n * (1 - rate)) + part(all_bad - bad, (all_rows - n) * rate) + part(all_rows - all_bad - n + bad, (all_rows - n) * (1 - rate))
    leaning = (bad >= min_rows) & (bad * all_rows > 1.5 * n * all_bad) & (ratio >= min_ratio)
    top = counted.filter(leaning).select("term", ratio.alias("ratio")).orderBy(F.desc("ratio"), "term").limit(max_terms).collect()
    # Common terms say nothing by themselves, or that a text is clean; in pairs they may.
    top += counted.filter(~leaning & (n <= all_rows / 2)).orderBy(F.desc("n"), "term").limit(max_common).select("term").collect()
    ids = np.sort(np.array([r.term for r in top], np.int64))
    empty = FactorizationMachine(ids, 0.0, np.zeros(len(ids)), np.zeros((len(ids), 1)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [empty.known(terms).astype(np.int32) for terms in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["label", "at"])

    # Sorted, so that the model doesn't depend on which task ended first.
    seen = sorted((tuple(r.at), r.label) for r in rows.mapInArrow(places, "label int, at array<int>").collect())
    return fit([np.array(at, np.int64) for at, _ in seen], np.array([label for _, label in seen], float), ids)


def score(df: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from ``threshold`` on), of whole texts.

    Defined cases: null and empty texts hold no term and get the score of the
    bias; equal texts get equal scores; rows are treated by themselves, so
    repeated rows and empty tables need no care; columns named score or
    predicted are replaced.
    """

    # Arrow arrays, read text by text: no second copy of a batch's texts in the worker.
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(term_ids(t.as_py())) for t in texts], pa.float64())

    kept = [c for c in df.columns if c not in ("score", "predicted")]
    out = df.select(*kept, scored(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
