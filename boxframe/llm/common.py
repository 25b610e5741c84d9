"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only in a local session, where driver and executors are one process, may it
    be unset; then a temporary one is made. Elsewhere that is an error, since
    no other folder is known to be shared.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if known is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    known = known or tempfile.mkdtemp(prefix="boxframe-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage is cut, and sizes and columns are known to later plans."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
