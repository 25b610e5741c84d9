"""Batches: fixed numbers of examples, padded sequences and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_number(place: Column, size: int) -> Column:
    return F.floor(place / size).cast("long")


def padded(df: DataFrame, batch: str, sequence: str, pad: int) -> DataFrame:
    """``df`` with each batch's sequences filled up to its longest, and length.

    The longest is found by an aggregate and joined back, so sequences are
    not gathered by batch.
    """
    rows = df.withColumn("length", F.size(sequence).cast("long"))
    most = rows.groupBy(batch).agg(F.max("length").alias("__most"))
    filled = F.concat(F.col(sequence), F.array_repeat(F.lit(pad).cast("long"), (F.col("__most") - F.col("length")).cast("int")))
    return rows.join(most, batch).withColumn(sequence, filled).drop("__most")


def padding_mask(df: DataFrame, batch: str, width: str, height: str) -> DataFrame:
    """``df`` with the batch's largest sides and how many pixels of each picture are padding."""
    w = Window.partitionBy(batch)
    rows = df.withColumn("batch_width", F.max(width).over(w)).withColumn("batch_height", F.max(height).over(w))
    return rows.withColumn("masked", F.col("batch_width") * F.col("batch_height") - F.col(width) * F.col(height))


def batch_sides(df: DataFrame, batch: str, width: str, height: str) -> DataFrame:
    """``df`` with its batch's largest sides, found by an aggregate of narrow rows and joined back."""
    most = df.groupBy(batch).agg(F.max(width).alias("batch_width"), F.max(height).alias("batch_height"))
    return df.join(most, batch)


def mask_bands(width: Column, height: Column, batch_width: Column, batch_height: Column) -> Column:
    """The mask of a picture in its batch by runs: bands of equal rows, from the top, each with how many pixels are kept and how many then are padding.

    A mask has as many bits as the batch's largest picture has pixels, but one
    band if the picture is as high as the batch, else two; bands without rows
    are left out.
    """
    band = lambda first, rows, kept: F.struct(*(c.cast("long").alias(n) for n, c in (("first", first), ("rows", rows), ("kept", kept), ("padded", batch_width - kept))))
    return F.filter(F.array(band(F.lit(0), height, width), band(height, batch_height - height, F.lit(0))), lambda b: b["rows"] > 0)


def mask_bits(bands: Column) -> Column:
    """The bits of ``bands``, row by row, as text: 1 is padding."""
    row = lambda b: F.concat(F.repeat(F.lit("0"), b["kept"].cast("int")), F.repeat(F.lit("1"), b["padded"].cast("int")))
    return F.array_join(F.transform(bands, lambda b: F.repeat(row(b), b["rows"].cast("int"))), "")


def cells_kept(kept: Column, side: Column, cells: Column) -> Column:
    """How many of ``cells`` along a side of a mask are kept, where each takes the bit of its first pixel, floor(cell * side / cells).

    So a mask at a model's resolution is one of runs again, and the mask of
    pixels is never expanded.
    """
    return F.floor((kept * cells + side - 1) / side).cast("long")
