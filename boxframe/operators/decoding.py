"""Beam search steps over tables of log probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxframe.functions.vectors import FORCED


def beam_step(beams_df: DataFrame, length: int, beams: int) -> DataFrame:
    """(batch, rank, origin, token, score): the best continuations of each batch's beams.

    ``beams_df`` is (batch, beam, beam_logp, logp array). Scores are divided by
    the length; of equal ones the lower beam, then the lower token, wins. Each
    beam's own best are picked before the exchange, so at most ``beams`` rows
    of a beam are sent.
    """
    scored = F.transform("logp", lambda x, i: F.struct((-(F.col("beam_logp") + x) / length).alias("less"), i.cast("long").alias("token")))
    own = beams_df.select("batch", "beam", F.explode(F.slice(F.sort_array(scored), 1, beams)).alias("t"))
    order = Window.partitionBy("batch").orderBy("t.less", "beam", "t.token")
    ranked = own.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < beams)
    return ranked.select("batch", "rank", F.col("beam").alias("origin"), "t.token", (-F.col("t.less")).alias("score"))


def best_hypotheses(hypotheses: DataFrame, n_best: int) -> DataFrame:
    """The ``n_best`` finished hypotheses (batch, hypothesis, score) of each batch, best first."""
    order = Window.partitionBy("batch").orderBy(F.desc("score"), "hypothesis")
    return hypotheses.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < n_best)


def beam_search(steps: DataFrame, key: str, beams: int, n_best: int, eos: int, min_length: int, max_length: int) -> DataFrame:
    """(key, tokens, score) of the ``n_best`` sequences by length-normalised log probability.

    ``steps`` is (key, step, logp array): log probabilities that depend on the
    step only, as a table of them can. A fold over a key's steps keeps the
    open beams and the finished hypotheses; ending is forbidden under
    ``min_length`` tokens, all are finished at ``max_length``, and a key is
    done when its best open beam can't be reached any more: when the best one
    has ended and there are ``n_best`` hypotheses.
    """
    kind = "array<struct<less:double,logp:double,tokens:array<bigint>>>"
    runs = steps.groupBy(key).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("step", "logp"))), 1, max_length), lambda s: s["logp"]).alias("all"))
    first = F.expr(f"cast(array(named_struct('less', 0D, 'logp', 0D, 'tokens', cast(array() as array<bigint>))) as {kind})")
    start = F.struct(first.alias("open"), F.expr(f"cast(array() as {kind})").alias("ended"), F.lit(False).alias("over"))

    def step(s: Column, logp: Column) -> Column:
        def grown(b: Column) -> Column:
            length = F.size(b["tokens"]) + 1
            p = lambda x, i: b["logp"] + F.when((i == eos) & (length < min_length), F.lit(FORCED)).otherwise(x)
            return F.transform(logp, lambda x, i: F.struct((-p(x, i) / length).alias("less"), p(x, i).alias("logp"), F.concat(b["tokens"], F.array(i.cast("long"))).alias("tokens")))

        best = F.slice(F.sort_array(F.flatten(F.transform(s["open"], grown))), 1, beams)

        def sorted_out(best: Column) -> Column:
            last = lambda b: F.element_at(b["tokens"], -1) == eos
            done = lambda b: last(b) | (F.size(b["tokens"]) >= max_length)
            ended = F.concat(s["ended"], F.filter(best, done))
            return F.struct(F.filter(best, lambda b: ~done(b)).alias("open"), ended.alias("ended"), (done(best[0]) & (F.size(ended) >= n_best)).alias("over"))

        return F.when(s["over"] | (F.size(s["open"]) == 0), s).otherwise(F.transform(F.array(best), sorted_out)[0])

    done = runs.select(key, F.aggregate("all", start, step).alias("s"))
    ended = F.when(F.size("s.ended") > 0, F.col("s.ended")).otherwise(F.col("s.open"))
    rows = done.select(key, F.explode(F.slice(F.sort_array(ended), 1, n_best)).alias("h"))
    return rows.select(key, "h.tokens", (-F.col("h.less")).alias("score"))


def greedy_search(steps: DataFrame, key: str, eos: int, min_length: int, max_length: int) -> DataFrame:
    """(key, tokens, score, finished): the best token of each step up to the first end token, and the last one's log probability.

    ``steps`` is as for ``beam_search``. Ending is forbidden under
    ``min_length`` tokens; a key is finished at its end token or at
    ``max_length``, and later steps are left out.
    """
    pick = F.struct((F.array_position("logp", F.array_max("logp")) - 1).alias("token"), F.array_max("logp").alias("logp"))
    early = F.transform("logp", lambda x, i: F.when(i == eos, F.lit(FORCED)).otherwise(x))
    known = steps.filter(F.col("step") < max_length).withColumn("logp", F.when(F.col("step") + 1 < min_length, early).otherwise(F.col("logp")))
    runs = known.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", pick.alias("p")))), lambda s: s["p"]).alias("all"))
    end = F.array_position(F.transform("all", lambda p: p["token"]), F.lit(eos).cast("long"))
    kept = runs.withColumn("n", F.when(end > 0, end).otherwise(F.size("all")).cast("int")).withColumn("ended", (end > 0) | (F.size("all") >= max_length))
    return kept.select(key, F.transform(F.slice("all", F.lit(1), F.col("n")), lambda p: p["token"]).alias("tokens"), F.get("all", F.col("n") - 1)["logp"].alias("score"), F.col("ended").alias("finished"))


def model_search(keys: DataFrame, key: str, model: Callable[[DataFrame], DataFrame], beams: int, n_best: int, eos: int, min_length: int, max_length: int, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, tokens, score) of the ``n_best`` sequences, with a model that looks at what was said before.

    ``model`` gets a row for each hypothesis (key, tokens, …) and adds
    ``next``, the log probabilities of the token after it; it may be a join or
    a ``mapInPandas``. The rules of ending are those of ``beam_search``. Each
    step is one call of the model and one window by key; a hypothesis that
    ended goes along as a row of its own. For many steps ``cut`` should write
    each step's table (a checkpoint), since plans grow with the steps.
    """
    own = "struct<less:double,logp:double,tokens:array<bigint>,ended:boolean>"
    state = keys.select(key, F.expr(f"cast(named_struct('less', 0D, 'logp', 0D, 'tokens', cast(array() as array<bigint>), 'ended', false) as {own})").alias("h"), F.lit(False).alias("over"))
    for n in range(max_length):
        seen = model(state.select(key, F.col("h.tokens").alias("tokens"), "h", "over"))
        p = F.transform("next", lambda x, i: F.col("h.logp") + (F.when(i == eos, F.lit(FORCED)).otherwise(x) if n + 1 < min_length else x))  # noqa: B023
        grown = F.transform(p, lambda x, i: F.struct((-x / (n + 1)).alias("less"), x.alias("logp"), F.concat("tokens", F.array(i.cast("long"))).alias("tokens"), ((i == eos) | (n + 1 >= max_length)).alias("ended")))  # noqa: B023
        best = F.slice(F.sort_array(grown), 1, beams)
        rows = seen.select(key, "over", F.col("h.ended").alias("was"), F.explode(F.when(F.col("h.ended"), F.array("h")).otherwise(best)).alias("h"))
        ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(key, "was").orderBy("h.less", "h.logp", "h.tokens"))).filter(F.col("was") | (F.col("k") <= beams))
        every = Window.partitionBy(key)
        first = F.max(F.when(~F.col("was") & (F.col("k") == 1), F.col("h.ended"))).over(every)
        over = F.col("over") | (F.coalesce(first, F.lit(False)) & (F.count_if("h.ended").over(every) >= n_best))
        state = cut(ranked.withColumn("over", over).filter(F.col("h.ended") | ~F.col("over")).select(key, "h", "over"))
    order = Window.partitionBy(key).orderBy("h.less", "h.logp", "h.tokens")
    done = state.filter("h.ended").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n_best)
    return done.select(key, "h.tokens", (-F.col("h.less")).alias("score"))
