"""Queries: tokens, grammar, decoding, losses and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxframe.functions import grammar, schedules, tokens, vectors
from boxframe.functions.geometry import Box
from boxframe.operators import decoding
from boxframe.plans import proxies as P

V = tokens.Vocabulary.of(pix2seq=True)


def tokenize_boxes(spark, d):
    box = Box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return P.gold_box(spark, d).select("image_id", "box_idx", F.array_join(tokens.box_tokens(V, box, F.col("category_id")).cast("array<string>"), " ").alias("tokens"))


def quantize_plain(spark, d):
    """Tokens and values back in the plain layout, with ranges of their own for x and y."""
    v = tokens.Vocabulary.of(pix2seq=False)
    x, y = v.x_token(F.col("x1")), v.y_token(F.col("y1"))
    return P.gold_box(spark, d).select("image_id", "box_idx", x.alias("x_token"), y.alias("y_token"), F.round(v.x_value(x), 9).alias("x"), F.round(v.y_value(y, 0.5), 9).alias("y"), v.is_x(y).alias("y_is_x"))


def _sequences(spark, d):
    rxns = P.gold(spark, d).select("image_id", "rxn_id", tokens.reaction_tokens(V, F.col("boxes")).alias("part"))
    parts = rxns.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rxn_id", "part"))), lambda r: r["part"]).alias("parts"))
    said, wanted = tokens.sequence(V, F.col("parts"))
    return parts.select("image_id", said.alias("tokens"), wanted.alias("targets"))


def _joined(c):
    return F.array_join(F.transform(c, lambda t: t.cast("string")), " ")


def tokenize_reactions(spark, d):
    rxns = P.gold(spark, d).select("image_id", "rxn_id", tokens.reaction_tokens(V, F.col("boxes")).alias("part"))
    return rxns.select("image_id", "rxn_id", _joined(F.col("part")).alias("tokens"))


def tokenize_images(spark, d):
    return _sequences(spark, d).select("image_id", F.size("tokens").cast("long").alias("n"), _joined(F.col("tokens")).alias("tokens"))


def truncate_labels(spark, d):
    return _sequences(spark, d).select("image_id", _joined(tokens.truncated(F.col("tokens"), 40)).alias("tokens"))


def tokens_to_strings(spark, d):
    return _sequences(spark, d).select("image_id", F.array_join(tokens.strings(V, F.col("tokens")), " ").alias("words"))


def detokenize_roundtrip(spark, d):
    """Boxes read back from each image's sequence."""
    read = _sequences(spark, d).select("image_id", F.posexplode(tokens.parse_reactions(V, F.col("tokens"))).alias("rxn", "r"))
    roles = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("role"), F.col(f"r.{n}").alias("boxes")) for i, n in enumerate(("reactants", "conditions", "products"))))).alias("s")
    rows = read.select("image_id", F.col("rxn").cast("long").alias("rxn"), roles).select("image_id", "rxn", "s.role", F.posexplode("s.boxes").alias("place", "b"))
    return rows.select("image_id", "rxn", "role", F.col("place").cast("long").alias("place"), F.col("b.category_id").alias("category_id"), *(F.round(f"b.{c}", 9).alias(c) for c in ("x1", "y1", "x2", "y2")))


def detokenize_boxes(spark, d):
    """Boxes with scores read back from each image's sequence of all its boxes."""
    box = Box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    boxes = P.gold_box(spark, d).select("image_id", "box_idx", tokens.box_tokens(V, box, F.col("category_id")).alias("part"))
    images = boxes.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("box_idx", "part"))), lambda r: r["part"]).alias("parts"))
    said = images.select("image_id", tokens.sequence(V, F.col("parts"))[0].alias("tokens"))
    scores = F.transform("tokens", lambda t, i: i.cast("double") / 100.0)
    rows = said.select("image_id", F.posexplode(tokens.parse_boxes(V, F.col("tokens"), scores)).alias("place", "b"))
    return rows.select("image_id", F.col("place").cast("long").alias("place"), F.col("b.box.category_id").alias("category_id"), F.round("b.box.x1", 9).alias("x1"), F.round("b.score", 6).alias("score"))


def fsm_trace(spark, d):
    """States of the grammar after each token of each reaction."""
    rxns = P.gold(spark, d).select("image_id", "rxn_id", tokens.reaction_tokens(V, F.col("boxes")).alias("tokens"))
    return rxns.select("image_id", "rxn_id", F.array_join(grammar.states(V, F.col("tokens")), " ").alias("states"))


def fsm_allowed(spark, d):
    """For each token of each reaction, whether the grammar allows it after those before.

    In every image but one of four, each reaction has one token doubled, left
    out or put in the place of the next, so that some are forbidden.
    """
    rxns = P.gold(spark, d).select("image_id", "rxn_id", tokens.reaction_tokens(V, F.col("boxes")).alias("said")).filter(F.size("said") > 0)
    at = ((F.col("image_id") * 7 + F.col("rxn_id")) % F.size("said")).cast("int")
    kind = F.col("image_id") % 4
    begin, own, rest = F.slice("said", F.lit(1), at), F.slice("said", at + 1, F.lit(1)), F.slice("said", at + 2, F.size("said"))
    changed = F.when(kind == 0, F.col("said")).when(kind == 1, F.concat(begin, own, own, rest)).when(kind == 2, F.concat(begin, rest)).otherwise(F.concat(begin, F.slice(rest, 1, 1), own, F.slice(rest, F.lit(2), F.size("said"))))
    return rxns.select("image_id", "rxn_id", grammar.allowed_each(V, changed).alias("allowed"))


def _logits(spark, d):
    return P.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.col("label").cast("long").alias("target"))


def log_softmax(spark, d):
    rows = _logits(spark, d).select("vec_id", F.posexplode(vectors.log_softmax(F.col("logits"))).alias("place", "v"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.round("v", 9).alias("logp"))


def greedy_argmax(spark, d):
    g = vectors.greedy(vectors.log_softmax(F.col("logits")), 62)
    return _logits(spark, d).select("vec_id", g["token"].alias("token"), F.round(g["score"], 9).alias("score"))


def masked_argmax(spark, d):
    """The best token where all in the target's half of the vocabulary are forbidden."""
    no = F.transform(F.col("logits"), lambda x, i: (i % 2) == F.col("target") % 2)
    return _logits(spark, d).select("vec_id", vectors.argmax(vectors.masked(F.col("logits"), no)).alias("token"))


def topk_tokens(spark, d):
    rows = _logits(spark, d).select("vec_id", F.posexplode(vectors.top_k(F.col("logits"), 5)).alias("rank", "t"))
    return rows.select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("t.place").alias("token"), F.col("t.value").alias("value"))


def sampled_tokens(spark, d):
    return _logits(spark, d).select("vec_id", vectors.sampled(F.col("logits"), F.col("vec_id"), 0.7, 5).alias("token"))


def accuracy_at_k(spark, d):
    better = F.col("logits")
    rank = F.size(F.filter(better, lambda x: x > F.get("logits", F.col("target").cast("int"))))
    rows = _logits(spark, d).select(rank.alias("rank"))
    return rows.agg(*(F.round(100.0 * F.avg((F.col("rank") < k).cast("double")), 9).alias(f"top{k}") for k in (1, 5, 10)))


def cross_entropy(spark, d):
    """Mean loss overall and with targets 0 and 1 ignored."""
    logp = vectors.log_softmax(F.col("logits"))
    rows = _logits(spark, d).select(vectors.nll(logp, F.col("target")).alias("a"), vectors.nll(logp, F.col("target"), [0, 1]).alias("b"))
    return rows.agg(F.round(F.avg("a"), 6).alias("loss"), F.round(F.avg("b"), 6).alias("loss_ignoring"))


def label_smoothing(spark, d):
    rows = _logits(spark, d).select(vectors.smoothed_kl(vectors.log_softmax(F.col("logits")), F.col("target"), 0.1, 0).alias("kl"))
    return rows.agg(F.round(F.sum("kl") / F.count("*"), 6).alias("loss"))


def criterion(spark, d):
    """Losses by name and their sum: odd and even rows stand for two formats."""
    rows = _logits(spark, d).select(F.when(F.col("vec_id") % 2 == 0, "bbox").otherwise("reaction").alias("name"), vectors.nll(vectors.log_softmax(F.col("logits")), F.col("target")).alias("loss"))
    each = rows.groupBy("name").agg(F.avg("loss").alias("loss"))
    return each.unionByName(each.agg(F.lit("total").alias("name"), F.sum("loss").alias("loss"))).select("name", F.round("loss", 6).alias("loss"))


def eos_lengths(spark, d):
    """Greedy decoding of runs of eight vectors; tokens under ten are end tokens."""
    steps = _logits(spark, d).select(F.floor(F.col("vec_id") / 8).alias("run"), F.col("vec_id").alias("step"), vectors.argmax(F.col("logits")).alias("token"))
    runs = steps.groupBy("run").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "token"))), lambda s: F.when(s["token"] < 10, F.lit(0)).otherwise(s["token"]).cast("long")).alias("tokens"))
    return runs.select("run", vectors.end_length(F.col("tokens"), 0).alias("length"), vectors.end_length(F.col("tokens"), 0, 8).alias("length_open"))


def _beams(spark, d):
    return _logits(spark, d).select(F.floor(F.col("vec_id") / 4).alias("batch"), (F.col("vec_id") % 4).alias("beam"), (-(F.col("vec_id") % 7) / 10.0).alias("beam_logp"), F.transform(vectors.log_softmax(F.col("logits")), lambda x: F.round(x, 9)).alias("logp"))


def beam_step(spark, d):
    done = decoding.beam_step(_beams(spark, d), length=3, beams=4)
    return done.select("batch", "rank", "origin", "token", F.round("score", 9).alias("score"))


def beam_finish(spark, d):
    hypotheses = _beams(spark, d).select("batch", F.col("beam").alias("hypothesis"), (F.col("beam_logp") + F.array_max("logp")).alias("score"))
    return decoding.best_hypotheses(hypotheses, 2).select("batch", "rank", "hypothesis", F.round("score", 9).alias("score"))


def beam_search(spark, d):
    """Three beams over runs of eight vectors as steps; token 0 ends."""
    steps = _logits(spark, d).select(F.floor(F.col("vec_id") / 8).alias("run"), (F.col("vec_id") % 8).alias("step"), vectors.log_softmax(F.col("logits")).alias("logp"))
    done = decoding.beam_search(steps, "run", beams=3, n_best=1, eos=0, min_length=2, max_length=8)
    return done.select("run", _joined(F.col("tokens")).alias("tokens"), F.round("score", 6).alias("score"))


def greedy_search(spark, d):
    """The best tokens over runs of eight vectors as steps; tokens under six stand for the end token."""
    ends = F.transform(F.col("logits"), lambda x, i: F.when(i == 0, F.array_max(F.slice("logits", 1, 6)) + 0.5).otherwise(x))
    steps = _logits(spark, d).select(F.floor(F.col("vec_id") / 8).alias("run"), (F.col("vec_id") % 8).alias("step"), ends.alias("logits")).select("run", "step", vectors.log_softmax(F.col("logits")).alias("logp"))
    done = decoding.greedy_search(steps, "run", eos=0, min_length=3, max_length=8)
    return done.select("run", _joined(F.col("tokens")).alias("tokens"), F.round("score", 6).alias("score"), "finished")


def prefix_search(spark, d):
    """Three beams for each run of eight vectors; what comes next is said by the vector that run, step and last token lead to."""
    logits = _logits(spark, d)
    n = logits.count()
    table = logits.select(F.col("vec_id").alias("__at"), F.transform(vectors.log_softmax(F.col("logits")), lambda x: F.round(x, 9)).alias("next"))

    def model(rows):
        at = (F.col("run") * 7 + F.coalesce(F.try_element_at("tokens", F.lit(-1)), F.lit(0)) + F.size("tokens")) % n
        return rows.withColumn("__at", at).join(table, "__at").drop("__at")

    runs = logits.select(F.floor(F.col("vec_id") / 8).alias("run")).distinct()
    done = decoding.model_search(runs, "run", model, beams=3, n_best=1, eos=0, min_length=2, max_length=4)
    return done.select("run", _joined(F.col("tokens")).alias("tokens"), F.round("score", 6).alias("score"))


def _steps(spark, d):
    return P.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 301).alias("step"))


def lr_schedule(spark, d):
    lrs = [F.round(schedules.warmup_linear_decay(0.1, F.col("step"), method=m), 12).alias(m) for m in ("linear", "constant", "burnin")]
    return _steps(spark, d).select("o_orderkey", *lrs)


def cosine_schedule(spark, d):
    return _steps(spark, d).select("o_orderkey", F.round(schedules.cosine(3e-4, F.col("step"), 300, 0.02), 12).alias("cosine"), F.round(schedules.constant(3e-4, F.col("step"), 300, 0.02), 12).alias("constant"))


def training_steps(spark, d):
    sizes = P.image(spark, d).groupBy("split").agg(F.count("*").alias("n"))
    return sizes.select("split", schedules.training_steps(F.col("n"), 4, 4, 2, 600).alias("steps"))


def sine_position(spark, d):
    """Eight values of each place of an order that has a line; lines of the same place are one before they're expanded."""
    places = P.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = places.select("l_orderkey", "l_linenumber", F.posexplode(vectors.sine_position(F.col("l_linenumber").cast("double"), 8, scale=6.283185307179586, last=F.lit(7.0))).alias("i", "v"))
    return rows.select("l_orderkey", "l_linenumber", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("v"))


def sinusoid_position(spark, d):
    rows = P.read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(vectors.sinusoid(F.col("turn").cast("double"), 6)).alias("i", "v"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("i").cast("long").alias("i"), F.round("v", 9).alias("v"))


def window_grid(spark, d):
    """Windows of eight of each vector, by their sums; put together again they're the vector."""
    cut = vectors.windows(F.col("logits"), 8)
    rows = _logits(spark, d).select("vec_id", (F.flatten(cut) == F.col("logits")).alias("whole"), F.posexplode(cut).alias("window", "w"))
    return rows.select("vec_id", "whole", F.col("window").cast("long").alias("window"), F.round(vectors.total(F.col("w")), 9).alias("total"))


def frozen_norm(spark, d):
    return _logits(spark, d).select("vec_id", F.round(vectors.total(vectors.frozen_norm(F.col("logits"), 0.1, 0.5, 2.0, 0.3)), 6).alias("total"))


QUERIES = {f.__name__: f for f in (tokenize_boxes, quantize_plain, tokenize_reactions, tokenize_images, truncate_labels, tokens_to_strings, detokenize_roundtrip, detokenize_boxes, fsm_trace, fsm_allowed, log_softmax, greedy_argmax, masked_argmax, topk_tokens, sampled_tokens, accuracy_at_k, cross_entropy, label_smoothing, criterion, eos_lengths, beam_step, beam_finish, beam_search, greedy_search, prefix_search, lr_schedule, cosine_schedule, training_steps, sine_position, sinusoid_position, window_grid, frozen_norm)}

_W = P.VIEWS
_CAT = "CASE category_id WHEN 1 THEN 2011 WHEN 2 THEN 2012 WHEN 3 THEN 2010 WHEN 4 THEN 2013 ELSE 2014 END"
_BIN = lambda c: f"CAST(round_even({c} * 1999e0, 0) AS BIGINT)"
_FIVE = f"concat_ws(' ', {_BIN('x1')}, {_BIN('y1')}, {_BIN('x2')}, {_BIN('y2')}, {_CAT})"
_RXN = f"""five AS (SELECT image_id, rxn_id, role, box_idx, {_FIVE} AS five FROM gold_box),
said AS (SELECT image_id, rxn_id, CASE WHEN count(*) FILTER (WHERE role = 0) = 0 OR count(*) FILTER (WHERE role = 2) = 0 THEN '' ELSE
  concat_ws(' ', string_agg(five, ' ' ORDER BY box_idx) FILTER (WHERE role = 0), '2007', string_agg(five, ' ' ORDER BY box_idx) FILTER (WHERE role = 1), '2009', string_agg(five, ' ' ORDER BY box_idx) FILTER (WHERE role = 2), '2008', '2006') END AS tokens FROM five GROUP BY ALL)"""
_IMG = f"{_RXN}, img AS (SELECT image_id, concat_ws(' ', '2002', string_agg(tokens, ' ' ORDER BY rxn_id) FILTER (WHERE tokens <> ''), '2092') AS tokens FROM said GROUP BY ALL)"
_NAMES = {i: n for n, i in V.ids.items()}
_NAME = "CASE t " + " ".join(f"WHEN '{i}' THEN '{n}'" for i, n in _NAMES.items()) + " ELSE t END"
_LOGP = "l AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings), n AS (SELECT vec_id, max(x) + ln(sum(exp(x - m))) AS n FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM l) GROUP BY 1), lp AS (SELECT l.vec_id, l.label, l.place, l.x, l.x - n.n AS logp FROM l JOIN n USING (vec_id))"
_STATES = f"""tok AS (SELECT image_id, rxn_id, unnest(string_split(tokens, ' ')) AS t, generate_subscripts(string_split(tokens, ' '), 1) AS i FROM said WHERE tokens <> ''),
kind AS (SELECT image_id, rxn_id, i, CAST(t AS INT) AS t, CASE WHEN CAST(t AS INT) < 2000 THEN 'x' WHEN CAST(t AS INT) BETWEEN 2010 AND 2014 THEN 'c' ELSE 'e' END AS k,
  CASE CAST(t AS INT) WHEN 2007 THEN 'Rct' WHEN 2009 THEN 'Cnd' WHEN 2008 THEN 'Prd' WHEN 2006 THEN 'Rxn' END AS closes FROM tok),
sect AS (SELECT *, coalesce(closes, first_value(closes IGNORE NULLS) OVER (PARTITION BY image_id, rxn_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS s,
  i - coalesce(max(CASE WHEN k <> 'x' THEN i END) OVER (PARTITION BY image_id, rxn_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS within FROM kind),
states AS (SELECT image_id, rxn_id, string_agg(s || ',' || CASE k WHEN 'c' THEN 'c' WHEN 'e' THEN 'e' ELSE ['x1', 'y1', 'x2', 'y2'][within] END, ' ' ORDER BY i) AS states FROM sect GROUP BY ALL)"""
_DECAY = "CASE WHEN step <= 10 THEN 1e0 ELSE 0.003e0 * ((step - 10) / 290e0) + 1 - (step - 10) / 290e0 END"
_WARM = lambda rising: f"CASE WHEN step >= 10 THEN 1e0 ELSE {rising} END"
_STEP = "s AS (SELECT o_orderkey, o_orderkey % 301 AS step FROM orders)"
_BEAM = f"b AS (SELECT vec_id // 4 AS batch, vec_id % 4 AS beam, -(vec_id % 7) / 10e0 AS beam_logp, place, round(logp, 9) AS logp FROM lp)"

#: The grammar step by step over the changed sequences: section and slot after each token, and whether it was allowed.
_FSM = """o AS (SELECT image_id, rxn_id, list_transform(string_split(tokens, ' '), lambda x: CAST(x AS INT)) AS l FROM said WHERE tokens <> ''),
c AS (SELECT *, CAST((image_id * 7 + rxn_id) % len(l) AS INT) AS pos FROM o),
e AS (SELECT image_id, rxn_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS j, pos, image_id % 4 AS kind FROM c),
f AS (SELECT *, CASE WHEN kind = 3 AND j = pos THEN j + 1.5 ELSE j END AS place FROM e WHERE NOT (kind = 2 AND j = pos) UNION ALL SELECT *, j + 0.5 FROM e WHERE kind = 1 AND j = pos),
tok AS MATERIALIZED (SELECT image_id, rxn_id, t, row_number() OVER (PARTITION BY image_id, rxn_id ORDER BY place) AS i FROM f),
run AS (SELECT DISTINCT image_id, rxn_id, CAST(0 AS BIGINT) AS i, 'Rxn' AS s, 'e' AS k, true AS ok FROM tok
  UNION ALL SELECT r.image_id, r.rxn_id, n.i,
    CASE WHEN r.k <> 'e' OR r.s = 'EOS' THEN r.s WHEN r.s = 'Rxn' THEN CASE WHEN n.t < 2000 THEN 'Rct' ELSE 'EOS' END WHEN r.s = 'Rct' THEN 'Cnd' WHEN r.s = 'Cnd' THEN 'Prd' ELSE 'Rxn' END,
    CASE r.k WHEN 'x1' THEN 'y1' WHEN 'y1' THEN 'x2' WHEN 'x2' THEN 'y2' WHEN 'y2' THEN 'c' WHEN 'c' THEN CASE WHEN n.t < 2000 THEN 'x1' ELSE 'e' END
      ELSE CASE WHEN r.s = 'EOS' OR r.s = 'Prd' THEN 'e' WHEN r.s = 'Cnd' OR n.t < 2000 THEN 'x1' ELSE 'e' END END,
    CASE r.k WHEN 'x1' THEN n.t < 2000 WHEN 'y1' THEN n.t < 2000 WHEN 'x2' THEN n.t < 2000 WHEN 'y2' THEN n.t BETWEEN 2010 AND 2013
      WHEN 'c' THEN n.t < 2000 OR n.t = CASE r.s WHEN 'Rct' THEN 2007 WHEN 'Cnd' THEN 2009 WHEN 'Prd' THEN 2008 ELSE -1 END
      ELSE CASE r.s WHEN 'Rct' THEN n.t < 2000 OR n.t = 2009 WHEN 'Cnd' THEN n.t < 2000 WHEN 'Prd' THEN n.t IN (2006, 2014) WHEN 'Rxn' THEN n.t < 2000 OR n.t = 2092 ELSE n.t = 2092 END END
  FROM run r JOIN tok n ON n.image_id = r.image_id AND n.rxn_id = r.rxn_id AND n.i = r.i + 1)"""
_SEARCH = """st AS MATERIALIZED (SELECT vec_id // 8 AS run, vec_id % 8 AS step, place, logp FROM lp),
b AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, 0e0 AS logp, CAST([] AS BIGINT[]) AS tokens, 0e0 AS less, false AS done, false AS over FROM st
  UNION ALL SELECT run, n, logp, tokens, less, done, over FROM (
    SELECT *, first_value(done) OVER w AS over, row_number() OVER w AS k FROM (
      SELECT b.run, b.n + 1 AS n, b.logp + x.logp AS logp, list_append(b.tokens, x.place) AS tokens, -(b.logp + x.logp) / (b.n + 1) AS less, x.place = 0 OR b.n + 1 >= 8 AS done
      FROM b JOIN (SELECT run, step, place, CASE WHEN place = 0 AND step < 1 THEN -1e20 ELSE logp END AS logp FROM st) x ON x.run = b.run AND x.step = b.n WHERE NOT b.done AND NOT b.over)
    WINDOW w AS (PARTITION BY run ORDER BY less, logp, tokens)) WHERE k <= 3),
h AS (SELECT *, bool_or(done) OVER (PARTITION BY run) AS any_done, max(n) OVER (PARTITION BY run) AS last FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY less, logp, tokens) AS k FROM h WHERE CASE WHEN any_done THEN done ELSE n = last END)
SELECT run, array_to_string(tokens, ' ') AS tokens, round(-less, 6) AS score FROM r WHERE k = 1"""

ORACLE_SQL = {
    "tokenize_boxes": f"{_W} SELECT image_id, box_idx, {_FIVE} AS tokens FROM gold_box",
    "quantize_plain": f"{_W}, q AS (SELECT image_id, box_idx, 14 + CAST(round_even(x1 * 99e0, 0) AS BIGINT) AS x_token, 114 + CAST(round_even(y1 * 99e0, 0) AS BIGINT) AS y_token FROM gold_box) SELECT *, round((x_token - 14) / 99e0, 9) AS x, round((y_token - 114) / 99e0 / 0.5e0, 9) AS y, y_token BETWEEN 14 AND 113 AS y_is_x FROM q",
    "tokenize_reactions": f"{_W}, {_RXN} SELECT image_id, rxn_id, tokens FROM said",
    "tokenize_images": f"{_W}, {_IMG} SELECT image_id, len(string_split(tokens, ' ')) AS n, tokens FROM img",
    "truncate_labels": f"{_W}, {_IMG} SELECT image_id, array_to_string(string_split(tokens, ' ')[1:40], ' ') AS tokens FROM img",
    "tokens_to_strings": f"{_W}, {_IMG}, w AS (SELECT image_id, unnest(string_split(tokens, ' ')) AS t, generate_subscripts(string_split(tokens, ' '), 1) AS i FROM img) SELECT image_id, string_agg({_NAME}, ' ' ORDER BY i) AS words FROM w GROUP BY ALL",
    "detokenize_roundtrip": f"{_W}, ok AS (SELECT image_id, rxn_id, row_number() OVER (PARTITION BY image_id ORDER BY rxn_id) - 1 AS rxn FROM gold_box GROUP BY image_id, rxn_id HAVING bool_or(role = 0) AND bool_or(role = 2)) SELECT image_id, ok.rxn, role, row_number() OVER (PARTITION BY image_id, rxn_id, role ORDER BY box_idx) - 1 AS place, category_id, {', '.join(f'round({_BIN(c)} / 1999e0, 9) AS {c}' for c in ('x1', 'y1', 'x2', 'y2'))} FROM gold_box JOIN ok USING (image_id, rxn_id)",
    "detokenize_boxes": f"{_W} SELECT image_id, box_idx AS place, category_id, round({_BIN('x1')} / 1999e0, 9) AS x1, round((5 * box_idx + 5) / 100e0, 6) AS score FROM gold_box",
    "fsm_trace": f"{_W}, {_RXN}, {_STATES} SELECT image_id, rxn_id, coalesce(states, '') AS states FROM said LEFT JOIN states USING (image_id, rxn_id)",
    "fsm_allowed": f"{_W.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_RXN}, {_FSM} SELECT image_id, rxn_id, string_agg(CASE WHEN ok THEN '1' ELSE '0' END, '' ORDER BY i) AS allowed FROM run WHERE i > 0 GROUP BY ALL",
    "greedy_search": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place, CAST(CASE WHEN generate_subscripts(embedding, 1) = 1 THEN CAST(list_max(embedding[1:6]) AS DOUBLE) + 0.5e0 ELSE CAST(unnest(embedding) AS DOUBLE) END AS DOUBLE) AS x FROM embeddings),
n AS (SELECT vec_id, max(x) + ln(sum(exp(x - m))) AS n FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS m FROM x) GROUP BY 1),
p AS (SELECT x.vec_id // 8 AS run, x.vec_id % 8 AS step, place, x - n AS logp FROM x JOIN n USING (vec_id)),
b AS (SELECT run, step, arg_max(place, (logp, -place)) AS token, max(logp) AS logp FROM p WHERE NOT (place = 0 AND step < 2) GROUP BY ALL),
e AS (SELECT *, min(step) FILTER (WHERE token = 0) OVER (PARTITION BY run) AS stop, count(*) OVER (PARTITION BY run) AS steps FROM b)
SELECT run, string_agg(CAST(token AS VARCHAR), ' ' ORDER BY step) AS tokens, round(arg_max(logp, step), 6) AS score, any_value(stop) IS NOT NULL OR any_value(steps) >= 8 AS finished FROM e WHERE stop IS NULL OR step <= stop GROUP BY run""",
    "prefix_search": f"""WITH RECURSIVE {_LOGP}, st AS MATERIALIZED (SELECT vec_id, place, round(logp, 9) AS logp FROM lp), size AS (SELECT count(*) AS size FROM embeddings),
b AS (SELECT DISTINCT vec_id // 8 AS run, CAST(0 AS BIGINT) AS n, 0e0 AS logp, CAST([] AS BIGINT[]) AS tokens, 0e0 AS less, false AS done, false AS over FROM embeddings
  UNION ALL SELECT run, n, logp, tokens, less, done, over FROM (
    SELECT *, first_value(done) OVER w AS over, row_number() OVER w AS k FROM (
      SELECT b.run, b.n + 1 AS n, b.logp + x.p AS logp, list_append(b.tokens, x.place) AS tokens, -(b.logp + x.p) / (b.n + 1) AS less, x.place = 0 OR b.n + 1 >= 4 AS done
      FROM (SELECT b.*, (b.run * 7 + coalesce(b.tokens[-1], 0) + b.n) % size AS vec FROM b, size) b JOIN (SELECT vec_id, place, logp AS p FROM st) x ON x.vec_id = b.vec WHERE NOT b.done AND NOT b.over AND NOT (x.place = 0 AND b.n < 1))
    WINDOW w AS (PARTITION BY run ORDER BY less, logp, tokens)) WHERE k <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY less, logp, tokens) AS k FROM b WHERE done)
SELECT run, array_to_string(tokens, ' ') AS tokens, round(-less, 6) AS score FROM r WHERE k = 1""",
    "beam_search": f"WITH RECURSIVE {_LOGP}, {_SEARCH}",
    "log_softmax": f"WITH {_LOGP} SELECT vec_id, place, round(logp, 9) AS logp FROM lp",
    "greedy_argmax": f"WITH {_LOGP} SELECT vec_id, place AS token, round(logp, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS k FROM lp WHERE place < 62) WHERE k = 1",
    "masked_argmax": f"WITH {_LOGP} SELECT vec_id, place AS token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS k FROM lp WHERE place % 2 <> label % 2) WHERE k = 1",
    "topk_tokens": f"WITH {_LOGP} SELECT vec_id, k - 1 AS rank, place AS token, x AS value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS k FROM lp) WHERE k <= 5",
    "accuracy_at_k": f"WITH {_LOGP}, r AS (SELECT a.vec_id, count(*) FILTER (WHERE b.x > a.x) AS rank FROM lp a JOIN lp b USING (vec_id) WHERE a.place = a.label GROUP BY 1) SELECT {', '.join(f'round(100e0 * avg(CAST(rank < {k} AS DOUBLE)), 9) AS top{k}' for k in (1, 5, 10))} FROM r",
    "cross_entropy": f"WITH {_LOGP} SELECT round(avg(-logp), 6) AS loss, round(avg(-logp) FILTER (WHERE label NOT IN (0, 1)), 6) AS loss_ignoring FROM lp WHERE place = label",
    "label_smoothing": f"WITH {_LOGP}, w AS (SELECT *, CASE WHEN place = label THEN 0.9e0 WHEN place = 0 THEN 0e0 ELSE 0.1e0 / 62e0 END AS w FROM lp) SELECT round(sum(CASE WHEN label <> 0 AND w > 0 THEN w * (ln(w) - logp) ELSE 0e0 END) / count(DISTINCT vec_id), 6) AS loss FROM w",
    "criterion": f"WITH {_LOGP}, e AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'bbox' ELSE 'reaction' END AS name, avg(-logp) AS loss FROM lp WHERE place = label GROUP BY 1) SELECT name, round(loss, 6) AS loss FROM e UNION ALL SELECT 'total', round(sum(loss), 6) FROM e",
    "eos_lengths": f"WITH {_LOGP}, t AS (SELECT vec_id // 8 AS run, vec_id % 8 AS step, place AS token FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS k FROM lp) WHERE k = 1), f AS (SELECT run, min(step) FILTER (WHERE token < 10) AS e FROM t GROUP BY 1) SELECT run, coalesce(e, 0) AS length, coalesce(e, 8) AS length_open FROM f",
    "beam_step": f"WITH {_LOGP}, {_BEAM}, r AS (SELECT *, (beam_logp + logp) / 3e0 AS score, row_number() OVER (PARTITION BY batch ORDER BY (beam_logp + logp) / 3e0 DESC, beam, place) AS k FROM b) SELECT batch, k - 1 AS rank, beam AS origin, place AS token, round(score, 9) AS score FROM r WHERE k <= 4",
    "beam_finish": f"WITH {_LOGP}, {_BEAM}, h AS (SELECT batch, beam AS hypothesis, any_value(beam_logp) + max(logp) AS score FROM b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, hypothesis) AS k FROM h) SELECT batch, k - 1 AS rank, hypothesis, round(score, 9) AS score FROM r WHERE k <= 2",
    "lr_schedule": f"WITH {_STEP} SELECT o_orderkey, round(0.1e0 * {_WARM('0.001e0 * (1 - step / 10e0) + step / 10e0')} * {_DECAY}, 12) AS linear, round(0.1e0 * {_WARM('0.001e0')} * {_DECAY}, 12) AS constant, round(0.1e0 * {_WARM('pow(step / 10e0, 4e0)')} * {_DECAY}, 12) AS burnin FROM s",
    "cosine_schedule": f"WITH {_STEP} SELECT o_orderkey, round(3e-4 * CASE WHEN step < 6 THEN step / 6e0 ELSE greatest(0e0, 0.5e0 * (1 + cos(pi() * ((step - 6) / 294e0)))) END, 12) AS cosine, round(3e-4 * CASE WHEN step < 6 THEN step / 6e0 ELSE 1e0 END, 12) AS constant FROM s",
    "training_steps": f"{_W} SELECT split, CAST(ceil(count(*) / 32e0) * 600 AS BIGINT) AS steps FROM image GROUP BY split",
    "sine_position": "WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i), a AS (SELECT l_orderkey, l_linenumber, i, CAST(l_linenumber AS DOUBLE) / (7e0 + 1e-6) * 6.283185307179586e0 / pow(10000e0, 2e0 * (i // 2) / 8) AS a FROM p, i) SELECT l_orderkey, l_linenumber, i, round(CASE WHEN i % 2 = 0 THEN sin(a) ELSE cos(a) END, 9) AS v FROM a",
    "sinusoid_position": "WITH i AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i), a AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, i, turn * exp(-(2 * (i // 2)) * ln(10000e0) / 6) AS a FROM conversations, i) SELECT conv_id, turn, i, round(CASE WHEN i % 2 = 0 THEN sin(a) ELSE cos(a) END, 9) AS v FROM a",
    "window_grid": f"WITH {_LOGP} SELECT vec_id, true AS whole, place // 8 AS window, round(sum(x ORDER BY place), 9) AS total FROM lp GROUP BY ALL",
    "sampled_tokens": f"WITH {_LOGP}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, place) AS k FROM lp), g AS (SELECT vec_id, place, x / 0.7e0 - ln(-ln((CAST('0x' || substr(md5(concat_ws(':', CAST(vec_id AS VARCHAR), CAST(place AS VARCHAR))), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)) AS noisy FROM r WHERE k <= 5) SELECT vec_id, arg_max(place, noisy) AS token FROM g GROUP BY vec_id",
    "frozen_norm": f"WITH {_LOGP} SELECT vec_id, round(sum(x * (2e0 / sqrt(0.5e0 + 1e-5)) + (0.3e0 - 0.1e0 * (2e0 / sqrt(0.5e0 + 1e-5)))), 6) AS total FROM lp GROUP BY vec_id",
}
