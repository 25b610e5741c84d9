"""Precision, recall and F1 of reactions, overall and by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scores(gold_hits: Column, gold_total: Column, pred_hits: Column, pred_total: Column) -> list[Column]:
    precision = pred_hits / F.greatest(pred_total, F.lit(1))
    recall = gold_hits / F.greatest(gold_total, F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-6))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def per_image(flags: DataFrame, images: DataFrame, image: list[str], mode: str) -> DataFrame:
    """Hits and totals of both sides for each row of ``images``; images without reactions count 0."""
    hit, gold = F.col(mode).cast("int"), F.col("side") == "gold"
    one = flags.groupBy(*image).agg(
        F.sum(F.when(gold, hit).otherwise(0)).alias("gold_hits"),
        F.sum(gold.cast("int")).alias("gold_total"),
        F.sum(F.when(gold, 0).otherwise(hit)).alias("pred_hits"),
        F.sum((~gold).cast("int")).alias("pred_total"),
    )
    numbers = ("gold_hits", "gold_total", "pred_hits", "pred_total")
    return images.join(one, image, "left").select(*images.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers))


NUMBERS = ("gold_hits", "gold_total", "pred_hits", "pred_total")


def evaluate(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of hits and totals, number of images and scores, for each value of ``by`` (all in one, if None)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in NUMBERS]
    done = counts.groupBy(*(by or [])).agg(*sums, F.count("*").alias("images"))
    return done.select(*(by or []), *NUMBERS, "images", *scores(*map(F.col, NUMBERS)))


def by_size(counts: DataFrame) -> DataFrame:
    """For each number of gold reactions in an image."""
    return evaluate(counts.withColumn("size", F.col("gold_total")), ["size"])


def summarize(counts: DataFrame) -> DataFrame:
    """By number of gold reactions, with a row (size null) over all: one pass of grouping sets."""
    done = counts.withColumn("size", F.col("gold_total")).rollup("size").agg(*(F.sum(c).cast("long").alias(c) for c in NUMBERS), F.count("*").alias("images"))
    return done.select("size", *NUMBERS, "images", *scores(*map(F.col, NUMBERS)))


def table(df: DataFrame, name: Column) -> DataFrame:
    """One text line for each row of scores, in percent."""
    parts = [F.format_string("%5.1f", 100 * F.col(c)) for c in ("precision", "recall", "f1")]
    return df.select(F.concat_ws("  ", F.rpad(name, 20, " "), *parts).alias("line"))
