"""A corpus pipeline of four stages over documents; each stage is written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boxframe.llm import toxicity
from boxframe.llm.byte_bpe import tokenize
from boxframe.llm.common import table, written
from boxframe.llm.mixing import mix, take
from boxframe.llm.simhash import near_dedup


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named by their place, so that none has a name that an operator adds; and these names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic.

    Defined cases: null and empty texts get the score of the model's bias;
    repeated rows are judged alike; without labels of both kinds nothing is
    dropped; an empty table gives an empty result; extra columns are kept,
    whatever their names.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows, at = _numbered(docs)
    return toxicity.score(rows, model, at["text"]).filter("predicted = 0").select(rows.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that with the smallest doc_id.

    Defined cases: null and empty texts are one group; rows with the same id
    and fingerprint are one; rows without id stay if no row with an id has
    their fingerprint, one for each fingerprint; an empty table gives an empty
    result; extra columns are kept.
    """
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Defined cases: null and empty texts have no words and are taken with their
    source's certain copies; a null source is a source; rows equal in id and
    text are taken alike; an empty table gives an empty result; extra columns
    are kept, whatever their names.
    """
    rows, at = _numbered(docs)
    return take(mix(rows, at["doc_id"], at["text"], at["source"]), rows.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and of what they decode to.

    Defined cases: null and empty texts have no tokens; repeated rows are
    encoded as often as they come; an empty table gives an empty result; of
    other columns lang and source are kept.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokenize(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the trained model, the fingerprint groups or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
