"""Running sums and last values in order, for groups of any size: a scan in segments.

A window over a group sorts and reads the group in one task. Here rows are
dealt to tasks by ranges of (group, order), each task scans its segment of a
group, and a small table of segments carries what came before: sums, and the
last values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.storage import written

SEGMENT = "__segment"


def segments(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` written by ranges of ``by`` and ``order``, with the number of its range. Numbers rise with the order."""
    return written(df.repartitionByRange(*map(F.col, by), *order).withColumn(SEGMENT, F.spark_partition_id()), "segments")


def scan(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column], last: str | None = None, window: int = 0) -> DataFrame:
    """``rows`` (of ``segments``) with running ``sums`` of each group, the row itself included.

    Sums of nothing but nulls are null. ``last`` names a column: ``__last``
    then has its values of the last ``window`` rows, up to the row itself, in
    order, nulls among them. A group's segments are put in order in one
    task: a row each, as many as there are tasks at most.
    """
    by, own = list(by), [f"__own_{i}" for i in range(len(sums))]
    inside = Window.partitionBy(SEGMENT, *by).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    named = dict(zip(own, sums.values(), strict=True))
    local = rows.withColumns({n: F.sum(c).over(so_far) for n, c in named.items()})
    ends = [F.sum(c).alias(f"{n}_end") for n, c in named.items()]
    source = rows
    if last is not None:
        back = Window.partitionBy(SEGMENT, *by).orderBy(*order)
        # Places from a segment's end: those of its last rows are few, so what is collected is bounded.
        source = rows.withColumn("__place", F.row_number().over(back)).withColumn("__size", F.count("*").over(Window.partitionBy(SEGMENT, *by)))
        ends.append(F.sort_array(F.collect_list(F.when(F.col("__place") > F.col("__size") - (window - 1), F.struct(F.col("__place").alias("at"), F.col(last).alias("v"))))).alias("__tail"))
        local = local.withColumn("__held", F.collect_list(F.struct(F.col(last).alias("v"))).over(inside.rowsBetween(-(window - 1), 0)))
    table = source.groupBy(SEGMENT, *by).agg(*ends)
    across = Window.partitionBy(*by).orderBy(SEGMENT)
    before = [F.sum(f"{n}_end").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{n}_before") for n in own]
    if last is not None:
        # Each earlier segment of the group has a row at least, so window - 1 of them are enough.
        held = F.flatten(F.collect_list(F.transform("__tail", lambda x: F.struct(x["v"].alias("v")))).over(across.rowsBetween(-(window - 1), -1)))
        before.append(held.alias("__before"))
    carried = table.select(F.col(SEGMENT).alias("__s"), *(F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)), *before)
    same = F.col(SEGMENT) == F.col("__s")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{i}"))
    done = local.join(carried, same)
    total = lambda n: F.when(F.col(f"{n}_before").isNull(), F.col(n)).otherwise(F.col(f"{n}_before") + F.coalesce(F.col(n), F.lit(0)))
    out = {name: total(n) for name, n in zip(sums, own, strict=True)}
    if last is not None:
        missing = F.lit(window) - F.size("__held")
        earlier = F.slice("__before", F.greatest(F.size("__before") - missing + 1, F.lit(1)), missing)
        out["__last"] = F.transform(F.concat(earlier, F.col("__held")), lambda x: x["v"])
    return done.select(*(c for c in rows.columns), *(c.alias(n) for n, c in out.items()))
