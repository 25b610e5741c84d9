"""Mixing sources to target weights by Pareto order sampling.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.llm.common import checkpointed

#: Sources up to which their table (a few numbers each) is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 20_000
#: Bits of a place in the Pareto order.
PLACES = 52
_BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """The number of runs of characters other than ASCII white space; 0 for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from ``sizes`` (source, source_size), one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``cap`` times its source's
    size, and what is over goes to the others by weight. A source i is at its
    cap where the shares at i's own level, c = cap_i / weight_i, do not exceed
    what there is to share; the others get the level at which all is given out.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    level = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    known = sizes.withColumn("w", w).withColumn("most", cap * F.col("source_size")).withColumn("level", F.col("most") / F.col("w"))
    known = known.withColumn("all", share * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    given = F.sum("most").over(level) + F.col("level") * (F.col("all_w") - F.sum("w").over(level))
    known = known.withColumn("full", given <= F.col("all"))
    left = F.col("all") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    left_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    known = known.withColumn("c", left / F.nullif(left_w, F.lit(0.0)))
    return known.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("c") * F.col("w")).alias("target"))


def _uniform(seed: int, *cols: Column) -> Column:
    """A number in (0, 1), the same for the same values: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *cols)
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``, where the keys agree (nulls as well); ``right`` is broadcast if it's small."""
    right = right.select(*(F.col(k).alias(f"__key_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys))
    right = F.broadcast(right) if right.count() <= BROADCAST_SOURCES else right
    return left.join(right, same, how).drop(*(f"__key_{k}" for k in keys))


def _crossing(ranked: DataFrame, keys: Sequence[str], buckets: int, most_rows: int = 8192) -> DataFrame:
    """(keys, cut, till): the last place up to which a group's sizes fit into ``rest``, and their sum up to there.

    ``ranked`` has the keys, ``at`` (a place of ``PLACES`` bits), ``size`` and
    ``rest``. A group's places are cut into ``buckets`` ranges; sums by range,
    made before any shuffle, tell in which one ``rest`` is passed. That one is
    cut again until none holds more than ``most_rows`` rows or there's but one
    place in it, and only its rows are put in order. Rows at one place are
    taken or left together. Groups that fit whole aren't in the result.
    """
    keys, bits = list(keys), max(1, (buckets - 1).bit_length())
    slim = ranked.select(*keys, "at", "size")
    whole = ranked.groupBy(*keys).agg(F.sum("size").alias("all"), F.first("rest").alias("rest")).filter("all > rest")
    ranges, shift = checkpointed(whole.select(*keys, F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"), "rest")), PLACES
    inside = lambda: _beside(slim, ranges, keys, "inner").filter(F.shiftright("at", shift) == F.col("prefix"))
    while shift:
        rows, shift = inside(), max(0, shift - bits)
        sums = rows.groupBy(*keys, "before", "rest", F.shiftright("at", shift).alias("prefix")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        running = Window.partitionBy(*keys).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        passed = sums.withColumn("till", F.col("before") + F.sum("words").over(running)).filter("till > rest")
        first = passed.groupBy(*keys).agg(F.min(F.struct("prefix", (F.col("till") - F.col("words")).alias("before"), "rest", "rows")).alias("m"))
        ranges = checkpointed(first.select(*keys, "m.*"))
        if not ranges.filter(F.col("rows") > most_rows).limit(1).count():
            break
        ranges = ranges.drop("rows")
    ties = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    ended = inside().withColumn("till", F.col("before") + F.sum("size").over(ties))
    fits = ended.groupBy(*keys, "prefix", "before").agg(F.max(F.when(F.col("till") <= F.col("rest"), F.struct("at", "till"))).alias("m"))
    return fits.select(*keys, F.coalesce("m.at", F.shiftleft("prefix", shift) - 1).alias("cut"), F.coalesce("m.till", "before").alias("till"))


def _filling(later: DataFrame) -> DataFrame:
    """(source, size, rest): how many of a source's later rows of each size fill its gap.

    ``later`` has source, size and gap. Of the largest size that fits, as many
    as fit; then of the next, and so on; or at some size one more than fits and
    then no more, if that comes nearer. Rows are counted by size before any
    shuffle; a source's sizes below twice its gap (a document's length at most)
    meet in one fold.
    """
    sizes = later.filter((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap"))).groupBy("source", "size", "gap").agg(F.count("*").alias("n"))
    listed = sizes.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    start = F.struct(F.col("gap").alias("left"), F.expr("cast(null as struct<off:double,less:bigint>)").alias("over"), F.expr("cast(array() as array<struct<size:bigint,rest:bigint>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        k = F.least(x["n"], F.floor(s["left"] / x["size"]))
        left = s["left"] - k * x["size"]
        over = F.when(x["n"] > k, F.struct((x["size"] - left).alias("off"), (-x["size"]).alias("less")))
        return F.struct(left.alias("left"), F.least(s["over"], over).alias("over"), F.when(k > 0, F.concat(s["out"], F.array(F.struct(x["size"].alias("size"), k.alias("rest"))))).otherwise(s["out"]).alias("out"))

    filled = listed.select("source", F.aggregate("sizes", start, step).alias("f"))
    last = F.when(F.col("f.over.off") < F.col("f.left"), -F.col("f.over.less"))
    put = F.concat(F.filter("f.out", lambda x: last.isNull() | (x["size"] >= last)), F.when(last.isNull(), F.expr("cast(array() as array<struct<size:bigint,rest:bigint>>)")).otherwise(F.array(F.struct(last.alias("size"), F.lit(1).cast("long").alias("rest")))))
    return filled.select("source", F.explode(put).alias("x")).groupBy("source", "x.size").agg(F.sum("x.rest").alias("rest"))


def _level(levels: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, level): what favour is multiplied by, so that inclusion probabilities of one at most add up to ``rest`` words.

    ``levels`` is (source, favour, words), summed. Rows whose favour times the
    level reaches one are certain, and what they leave is shared anew by the
    others; so the level rises, and more may become certain, until none does.
    """
    rows = checkpointed(_beside(levels, plan.filter("part > 0 and rest > 0").select("source", "rest"), ["source"], "inner"))
    state = rows.groupBy("source").agg((F.first("rest") / F.nullif(F.sum(F.col("words") * F.col("favour")), F.lit(0.0))).alias("level"))
    while True:
        certain = F.col("favour") * F.col("level") >= 1
        shared = _beside(rows, checkpointed(state), ["source"]).groupBy("source").agg(
            F.first("level").alias("last"),
            F.first("rest").alias("rest"),
            F.coalesce(F.sum(F.when(certain, F.col("words"))), F.lit(0)).alias("taken"),
            F.sum(F.when(certain, 0.0).otherwise(F.col("words") * F.col("favour"))).alias("favoured"),
            F.max(F.when(~certain, F.col("favour"))).alias("most"),
        )
        state = shared.withColumn("level", F.coalesce((F.col("rest") - F.col("taken")) / F.nullif(F.col("favoured"), F.lit(0.0)), F.col("last")))
        state = checkpointed(state.select("source", "level", (F.col("most") * F.col("level") >= 1).alias("more")))
        if not state.filter("more").limit(1).count():
            return state.drop("more")
        state = state.drop("more")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    favour: Callable[[Column], Column] | Column | None = None,
    seed: int = 42,
    buckets: int = 1024,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The ``keep`` columns of ``df`` (all, if None) with size, source_size, target and copies: how often the mix takes each row.

    A source whose target is f times its size takes every row floor(f) times;
    those copies are certain. For the rest, a row's inclusion probability p is
    in proportion to ``favour`` (a column of ``df``, or a function of the
    size; equal for all, if None), one at most, and the words expected are
    those left of the target: rows that would pass one are certain, and the
    others share what is left anew. Certain rows come first, the others are
    ranked by the Pareto order: random odds u / (1 - u) divided by
    inclusion odds p / (1 - p). The first rows in that order are taken as long
    as their words fit what is left of the target; later rows then fill the
    gap, the largest that fit first. What is left of the gap, or passed, is at
    most half the size of the smallest later row not taken.

    No source is ranked in one task: see ``_crossing``. What comes out is one
    threshold a source, and one for each size that fills its gap, so the rows
    themselves are never shuffled. Without ``text_col`` among ``keep`` texts
    are read once.

    Defined cases: null text has size 0; a null source is a source, the last;
    a source of size 0 has target 0; a null favour is 0; rows equal in id and
    text tie and are taken alike, so a source may miss its target by such a
    block; null ids are told apart by their text; an empty table gives an empty
    result; columns of ``df`` with the names added are replaced, any other
    names are free.
    """
    added = ("size", "source_size", "target", "copies")
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    size = word_count(F.col(text_col))
    liked = favour(size) if callable(favour) and not isinstance(favour, Column) else favour
    own = {
        "source": F.col(source_col),
        "size": size,
        "u": _uniform(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))),
        "favour": F.coalesce(liked.cast("double"), F.lit(0.0)) if liked is not None else F.lit(1.0),
    }
    rows = df.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)), *(c.alias(n) for n, c in own.items()))
    if text_col in kept:
        slim = checkpointed(rows.select(*own))
    else:
        rows = slim = checkpointed(rows)
    levels = checkpointed(slim.groupBy("source", "favour").agg(F.sum("size").alias("words")))
    plan = targets(levels.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    f = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(f)).withColumn("part", f - F.col("whole"))
    plan = checkpointed(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    plan = checkpointed(_beside(plan, _level(levels, plan), ["source"]))
    p = F.least(F.greatest(F.coalesce(F.col("favour") * F.col("level"), F.lit(0.0)), F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = F.col("u") / (1 - F.col("u")) / (p / (1 - p))
    #: The Pareto order as a whole number, so that ranges of it are cut exactly.
    at = F.floor(odds / (1 + odds) * float(1 << PLACES)).cast("long")
    ranked = _beside(slim, plan.select("source", "part", "rest", "level"), ["source"]).filter("part > 0 and rest > 0").select("source", "size", "rest", at.alias("at"))
    cuts = checkpointed(_crossing(ranked, ["source"], buckets))
    later = _beside(ranked, cuts, ["source"], "inner").filter("at > cut").select("source", "size", "at", (F.col("rest") - F.col("till")).alias("gap"))
    filling = checkpointed(_filling(later))
    chosen = _beside(later.drop("gap"), filling, ["source", "size"], "inner")
    last = _crossing(chosen.select("source", F.col("size").alias("length"), "at", F.lit(1).cast("long").alias("size"), "rest"), ["source", "length"], buckets)
    last = filling.select(F.col("source").alias("s"), "size").join(last, F.expr("s <=> source and size = length"), "left").select(F.col("s").alias("source"), "size", F.coalesce("cut", F.lit((1 << 62))).alias("last"))
    done = _beside(rows, plan.join(cuts.select(F.col("source").alias("s"), "cut"), F.expr("source <=> s"), "left").drop("s"), ["source"])
    done = _beside(done, checkpointed(last), ["source", "size"])
    taken = (F.col("part") > 0) & (F.col("rest") > 0) & ((at <= F.coalesce("cut", F.lit(1 << 62))) | (at <= F.coalesce("last", F.lit(-1))))
    return done.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)), "size", "source_size", "target", (F.col("whole") + F.when(taken, 1).otherwise(0)).cast("long").alias("copies"))


def take(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of a mix, each as often as it is taken."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__time")
    return mixed.filter("copies > 0").select(*columns, times).select(*columns)
