"""Running meters: windows over a stream of values by name, totals and progress lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxframe.operators.scan import scan, segments

#: Values a meter's window holds.
WINDOW = 20


def running(df: DataFrame, name: str, value: str, order: list[str], count: Column | None = None, window: int = WINDOW) -> DataFrame:
    """``df`` with the meter's state after each row: median, avg, max and latest value of the window, and global_avg.

    The median is the lower of the two in the middle. ``count`` is how many
    values a row stands for; it weighs the global average only. Values are
    scanned in segments (see ``scan``), so a name may have any number of them.
    """
    if not isinstance(df.schema[value].dataType, T.NumericType):
        raise TypeError(f"a meter's values are numbers, {value} is {df.schema[value].dataType.simpleString()}")
    n = F.lit(1) if count is None else count
    rows, placed = segments(df.withColumn("__n", n), [name], [F.col(c) for c in order]), [F.col(c) for c in order]
    known = scan(rows, [name], placed, {"__total": F.col(value) * F.col("__n"), "__count": F.col("__n")}, value, window)
    held = F.sort_array(F.filter("__last", lambda x: x.isNotNull()))
    mean = F.aggregate(F.filter("__last", lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(held), F.lit(0))
    state = {"median": F.get(held, F.floor((F.size(held) - 1) / 2).cast("int")), "avg": mean, "max": F.array_max(held), "value_now": F.col(value), "global_avg": F.col("__total") / F.col("__count")}
    return known.withColumns(state).select(*df.columns, *(c for c in state if c not in df.columns))


def totals(df: DataFrame, name: str, value: str, count: Column | None = None) -> DataFrame:
    """(name, count, total, global_avg) over all processes: windows aren't part of it."""
    n = F.lit(1) if count is None else count
    return df.groupBy(name).agg(F.sum(n).cast("long").alias("count"), F.sum(F.col(value) * n).alias("total")).withColumn("global_avg", F.col("total") / F.col("count"))


def reduced(df: DataFrame, name: str, value: str, average: bool = True) -> DataFrame:
    """Mean (or sum) of each name's values over the processes."""
    return df.groupBy(name).agg((F.avg if average else F.sum)(value).alias(value))


def logged(df: DataFrame, name: str, order: list[str], every: int, seconds: str) -> DataFrame:
    """Each ``every``-th row of a name and the last one, with i, n and the seconds left at the average so far."""
    placed = [F.col(c) for c in order]
    rows = segments(df, [name], placed)
    known = scan(rows, [name], placed, {"__i": F.lit(1), "__total": F.col(seconds), "__count": F.col(seconds).isNotNull().cast("long")})
    sizes = rows.groupBy(name).agg(F.count("*").alias("n")).withColumnRenamed(name, "__name")
    timed = known.join(sizes, F.col(name).eqNullSafe(F.col("__name"))).withColumn("i", (F.col("__i") - 1).cast("long"))
    timed = timed.withColumn("eta", F.col("__total") / F.nullif(F.col("__count"), F.lit(0)) * (F.col("n") - F.col("i")))
    return timed.filter((F.col("i") % every == 0) | (F.col("i") == F.col("n") - 1)).select(*df.columns, "i", "n", "eta")


def line(df: DataFrame, name: str, columns: list[str]) -> Column:
    """One text of a row's meters."""
    return F.concat_ws("  ", *(F.concat(F.lit(f"{c}: "), F.format_string("%.4f", F.col(c))) for c in columns))
