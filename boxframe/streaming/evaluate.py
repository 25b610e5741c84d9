"""Running evaluation of prediction files as they arrive: an extension, not part of the batch semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxframe.operators.metrics import evaluate


def stream_counts(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of image counts (gold_hits, gold_total, pred_hits, pred_total, at) from parquet files put into ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def running_scores(counts: DataFrame) -> DataFrame:
    """Scores over all that came so far; for the output mode complete."""
    return evaluate(counts)


def windowed_scores(counts: DataFrame, time: str = "at", every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Scores by time window; rows later than ``late`` are left out, so that state is bounded."""
    return evaluate(counts.withWatermark(time, late).withColumn("window", F.window(time, every)), ["window"])
