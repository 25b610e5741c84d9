"""Uniform shuffles into shards of exact size by a hypergeometric communication matrix.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.llm.common import checkpointed

#: Matrix levels drawn before the nodes are spread over the cluster.
LEVELS_TOGETHER = 5


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def _steps(first: Column, last: Column, down: bool) -> Column:
    none = F.expr("cast(array() as array<bigint>)")
    return F.when((last < first) if not down else (last > first), none).otherwise(F.sequence(first, last))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are among ``drawn``: an exact draw by inversion.

    Probabilities relative to the mode follow from their ratios, so no
    factorial is needed; the sums run over 12 standard deviations and 40 more
    on either side, beyond which nothing is left in double precision.
    """
    d = lambda c: c.cast("double")

    def draw(p: Column) -> Column:
        big, k_all, n = d(p["total"]), d(p["good"]), d(p["drawn"])
        low, high = F.greatest(F.lit(0).cast("long"), p["drawn"] + p["good"] - p["total"]), F.least(p["drawn"], p["good"])
        share = k_all / F.greatest(big, F.lit(1.0))
        spread = F.sqrt(n * share * (1 - share) * (big - n) / F.greatest(big - 1, F.lit(1.0)))
        far = (F.ceil(12 * spread) + 40).cast("long")
        mode = F.least(high, F.greatest(low, F.floor((n + 1) * (k_all + 1) / (big + 2)).cast("long")))
        up = lambda w, k: w * (k_all - k + 1) * (n - k + 1) / (k * (big - k_all - n + k))
        down = lambda w, k: w * (k + 1) * (big - k_all - n + k + 1) / ((k_all - k) * (n - k))

        def summed(over: Column, ratio: Callable) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
            return F.aggregate(over, start, lambda a, k: _let(ratio(a["w"], d(k)), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"))))["s"]

        def found(over: Column, ratio: Callable, mode: Column, at: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("s"), mode.alias("x"))
            step = lambda a, k: F.when(a["s"] > at, a).otherwise(_let(ratio(a["w"], d(k)), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s"), k.alias("x"))))
            return F.aggregate(over, start, step)["x"]

        sides = F.struct(mode.alias("mode"), _steps(mode + 1, F.least(high, mode + far), False).alias("up"), _steps(mode - 1, F.greatest(low, mode - far), True).alias("down"))

        def chosen(s: Column) -> Column:
            sums = F.struct(summed(s["up"], up).alias("up"), summed(s["down"], down).alias("down"))

            def cast(t: Column) -> Column:
                at = p["u"] * (1 + t["up"] + t["down"])
                return F.when(at < 1 + t["up"], found(s["up"], up, s["mode"], at)).otherwise(found(s["down"], down, s["mode"], at - t["up"]))

            return _let(sums, cast)

        return _let(sides, chosen)

    return _let(F.struct(total.cast("long").alias("total"), good.cast("long").alias("good"), drawn.cast("long").alias("drawn"), u.alias("u")), draw)


def communication_matrix(blocks: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """(block, n, counts): how many of each block's rows go to each shard.

    ``blocks`` is (block, n). Shards get floor or ceiling of all rows over
    ``shards``. The matrix has the law of a uniform shuffle: a tree halves the
    list of blocks, and at each node the shards' counts split between the two
    halves by a multivariate hypergeometric draw. The tree starts from one row
    with a number for each block (not for each row of data).
    """
    root = blocks.agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    parts = root.select("parts").first()["parts"]
    if not parts:
        return blocks.select("block", "n", F.expr("cast(array() as array<bigint>)").alias("counts"))
    numbers = F.sequence(F.lit(0), F.lit(shards - 1))
    nodes = root.select("blocks", F.transform(numbers, lambda j: (F.floor(F.col("n") / shards) + F.when(j < F.pmod("n", F.lit(shards)), 1).otherwise(0)).cast("long")).alias("counts"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    for depth in range((parts - 1).bit_length()):
        level = F.lit(depth)
        half = F.floor(F.size("blocks") / 2).cast("int")
        nodes = nodes.select("blocks", "counts", half.alias("half"), F.aggregate(F.slice("blocks", 1, half), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("left_n"))
        start = F.struct(F.expr("cast(array() as array<bigint>)").alias("got"), total(F.col("counts")).alias("total"), F.col("left_n").alias("drawn"))

        def split(a: Column, j: Column) -> Column:
            good = F.get("counts", j)
            x = hypergeometric(a["total"], good, a["drawn"], _uniform(F.lit(seed), level, F.col("blocks")[0]["block"], j))
            return _let(x, lambda x: F.struct(F.concat(a["got"], F.array(x)).alias("got"), (a["total"] - good).alias("total"), (a["drawn"] - x).alias("drawn")))

        left = F.aggregate(numbers, start, split)["got"]
        nodes = nodes.select("blocks", "counts", "half", F.when(F.col("half") > 0, left).alias("left"))
        halves = F.when(F.col("half") == 0, F.array(F.struct("blocks", "counts"))).otherwise(
            F.array(
                F.struct(F.slice("blocks", F.lit(1), F.col("half")).alias("blocks"), F.col("left").alias("counts")),
                F.struct(F.slice("blocks", F.col("half") + 1, F.size("blocks")).alias("blocks"), F.zip_with("counts", "left", lambda x, y: x - y).alias("counts")),
            )
        )
        nodes = nodes.select(F.explode(halves).alias("node")).select("node.blocks", "node.counts")
        if depth == LEVELS_TOGETHER:
            nodes = nodes.repartition(F.col("blocks")[0]["block"])
    return nodes.select(F.col("blocks")[0]["block"].alias("block"), F.col("blocks")[0]["n"].alias("n"), "counts")


def shuffle_to_shards(df: DataFrame, shards: int = 8, seed: int = 42, block_rows: int = 100_000) -> DataFrame:
    """``df`` with shard (int) and slot (long): a uniform shuffle into shards of exact size.

    Row counts of shards differ by one at most; slots run from 0 without gaps.
    The rows' blocks are pieces of up to ``block_rows`` rows of the input's
    partitions. The matrix says how many rows of each block go to each shard;
    every block permutes its rows and deals them out by its counts; every shard
    permutes what it got, in ranges of a random key whose counts give the
    first slot of each. No task holds a shard or more than about a block.

    Rows are written once to the checkpoint folder with a number each, so a
    lost executor cannot change what was counted; pass narrow rows. A rerun on
    the same files and settings gives the same result.

    Defined cases: any column may be null, repeated rows are rows of their own
    and get a place each, an empty table gives an empty result, columns named
    shard or slot are replaced, other columns are returned as they are.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    rows = checkpointed(df.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)), F.monotonically_increasing_id().alias("uid")))
    block = F.struct(F.shiftright("uid", 33).alias("part"), F.floor(F.col("uid").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows).alias("piece"))
    rows = rows.withColumn("block", block)
    counted = checkpointed(rows.groupBy("block").agg(F.count("*").alias("n")))
    matrix = communication_matrix(counted, shards, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("counts", F.lit(1), j), F.lit(0).cast("long"), lambda a, x: a + x))
    matrix = matrix.select("block", ends.alias("ends"))
    key = lambda n: F.xxhash64(F.lit(seed + n), F.col("uid"))
    dealt = rows.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(key(1), "uid")) - 1).join(matrix, "block")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int")).drop("ends", "place", "block")
    ranges = max(1, -(-counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // (shards * block_rows)))
    dealt = dealt.withColumn("range", F.floor(_uniform(F.lit(seed + 2), F.col("uid")) * ranges))
    first = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    first = first.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("first"))
    order = Window.partitionBy("shard", "range").orderBy(key(3), "uid")
    placed = dealt.withColumn("slot", F.row_number().over(order) - 1).join(first, ["shard", "range"])
    return placed.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)), "shard", (F.col("slot") + F.col("first")).cast("long").alias("slot"))
