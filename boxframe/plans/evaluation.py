"""Queries: geometry of boxes, matching, comparison, evaluation and duplicates."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxframe.functions import geometry as G
from boxframe.operators import dedup, matching, metrics, overlap
from boxframe.plans import proxies as P

W, H = P.WIDTH, P.HEIGHT
KEY = ["image_id", "box_idx"]


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, G.Box]:
    return P.gold_box(spark, d), G.Box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))


def bbox_normalize(spark, d):
    boxes, box = _boxes(spark, d)
    return boxes.select(*KEY, *G.from_xywh(*map(F.col, "xywh"), W, H).named())


def bbox_unnormalize(spark, d):
    boxes, box = _boxes(spark, d)
    return boxes.select(*KEY, *(F.round(c, 6).alias(n) for n, c in zip(box._fields, G.to_pixels(box, W, H), strict=True)))


def bbox_flags(spark, d):
    boxes, box = _boxes(spark, d)
    return boxes.select(*KEY, G.is_mol(F.col("category_id")).alias("is_mol"), G.is_empty(box).alias("is_empty"))


def bbox_crop_rect(spark, d):
    boxes, box = _boxes(spark, d)
    return boxes.select(*KEY, *G.crop_rectangle(box, W, H).named())


def bbox_to_coco(spark, d):
    boxes, box = _boxes(spark, d)
    return boxes.select(*KEY, *(F.round(c, 6).alias(n) for n, c in zip("xywh", G.to_xywh(box, W, H), strict=True)))


def bbox_center(spark, d):
    boxes, box = _boxes(spark, d)
    center = G.to_center(box)
    back = G.from_center(*center)
    return boxes.select(*KEY, *(F.round(c, 9).alias(n) for n, c in zip(("cx", "cy", "w", "h"), center, strict=True)), *(F.round(c, 9).alias(n) for n, c in zip(back._fields, back, strict=True)))


def clamp_boxes(spark, d):
    boxes, _ = _boxes(spark, d)
    x, y, w, h = map(F.col, "xywh")
    inside = G.clamp(G.Box(x, y, x + w, y + h), F.lit(600.0), F.lit(400.0))
    return boxes.select(*KEY, *inside.named(), (w * h).alias("area"))


def _pairs(spark, d):
    return P.gold(spark, d).withColumnRenamed("boxes", "gb").join(P.pred(spark, d).withColumnRenamed("boxes", "pb"), ["image_id", "rxn_id"])


def iou_pairs(spark, d):
    """IoU of each box with the boxes of the predicted reaction of the same number."""
    pairs = _pairs(spark, d).select("image_id", F.explode("gb").alias("g"), "pb").select("image_id", "g", F.explode("pb").alias("p"))
    return pairs.select("image_id", F.col("g.idx").alias("gold_idx"), F.col("p.idx").alias("pred_idx"), matching.overlap(F.col("g"), F.col("p"), digits=P.DIGITS).alias("iou"))


def _match(spark, d, category):
    m = matching.box_match(F.col("gb"), F.col("pb"), match_category=category, digits=P.DIGITS)
    rows = _pairs(spark, d).select("image_id", "rxn_id", "gb", F.posexplode(m).alias("at", "m"))
    return rows.select("image_id", "rxn_id", F.get("gb", F.col("at"))["idx"].alias("gold_idx"), F.col("m.place").alias("place"), F.col("m.iou").alias("iou"))


def bbox_match(spark, d):
    return _match(spark, d, False)


def bbox_match_category(spark, d):
    return _match(spark, d, True)


def reaction_schema(spark, d):
    """Numbers of boxes by role that a comparison of molecules looks at."""
    names = ("reactants", "conditions", "products")
    return P.gold(spark, d).select("image_id", "rxn_id", *(F.size(matching.role_places(F.col("boxes"), r, True)).cast("long").alias(n) for r, n in enumerate(names)))


def _compared(spark, d, **how):
    return _pairs(spark, d).select("image_id", "rxn_id", matching.compare(F.col("gb"), F.col("pb"), digits=P.DIGITS, **how).alias("same"))


def reaction_compare_exact(spark, d):
    return _compared(spark, d)


def reaction_compare_soft(spark, d):
    return _compared(spark, d, mol_only=True, merge_condition=True)


def whole_pred(spark, d):
    """Predictions as a scored image holds them: without duplicates and reactions that lack a reactant or product."""
    return dedup.kept_reactions(P.pred(spark, d), ["image_id"], digits=P.DIGITS)


def _counts(spark, d, mode, pred):
    return matching.image_counts(P.gold(spark, d), pred(spark, d), P.image(spark, d), ["image_id"], mode, P.DIGITS)


def eval_exact_overall(spark, d, pred=P.pred):
    return metrics.evaluate(_counts(spark, d, "exact", pred))


def eval_soft_overall(spark, d, pred=P.pred):
    return metrics.evaluate(_counts(spark, d, "soft", pred))


def eval_by_size(spark, d, pred=P.pred):
    return metrics.by_size(_counts(spark, d, "exact", pred))


def eval_by_group(spark, d, pred=P.pred):
    return metrics.evaluate(_counts(spark, d, "exact", pred), ["diagram_type"])


def eval_by_group_soft(spark, d, pred=P.pred):
    return metrics.evaluate(_counts(spark, d, "soft", pred), ["diagram_type"])


def eval_summarize(spark, d, pred=P.pred):
    return metrics.summarize(_counts(spark, d, "exact", pred))


def eval_cv_union(spark, d, pred=P.pred):
    """Five test splits, scored by split in one pass."""
    return metrics.evaluate(_counts(spark, d, "exact", pred), ["split"])


def score_table(spark, d, pred=P.pred):
    """Printed lines of exact scores by kind of diagram."""
    return metrics.table(metrics.evaluate(_counts(spark, d, "exact", pred), ["diagram_type"]), F.col("diagram_type"))


def eval_images(spark, d, pred=P.pred):
    return _counts(spark, d, "exact", pred).select("image_id", *metrics.NUMBERS)


def dedup_boxes(spark, d):
    rows = P.gold(spark, d).select("image_id", "rxn_id", "boxes", F.explode(dedup.kept_boxes(F.col("boxes"), P.DIGITS)).alias("place"))
    return rows.select("image_id", "rxn_id", F.get("boxes", F.col("place").cast("int"))["idx"].alias("box_idx"))


def dedup_boxes_all(spark, d):
    rows = P.gold(spark, d).select("image_id", "rxn_id", "boxes", F.explode(dedup.all_earlier(F.col("boxes"), P.DIGITS)).alias("place"))
    return rows.select("image_id", "rxn_id", F.get("boxes", F.col("place").cast("int"))["idx"].alias("box_idx"))


def _doubled(spark, d):
    """Predictions with every third image's reactions said twice, so that there are duplicates."""
    rxn = F.col("rxn_id")
    again = F.when(F.col("image_id") % 3 == 0, F.array(rxn, rxn + 1000)).otherwise(F.array(rxn))
    return P.pred(spark, d).select("image_id", F.explode(again).alias("rxn_id"), "boxes")


def dedup_reactions(spark, d):
    return dedup.kept_reactions(_doubled(spark, d), ["image_id"], digits=P.DIGITS).select("image_id", "rxn_id")


def postprocess_reactions(spark, d):
    done = dedup.in_roles(dedup.postprocess(_doubled(spark, d), ["image_id"], P.DIGITS))
    return done.select("image_id", "rxn_id", F.size("boxes").cast("long").alias("n_boxes"))


def bbox_match_images(spark, d):
    """Each box of an image with the predicted one of that image, whatever its reaction, that fits best; paired by grid cells."""
    side = lambda boxes: boxes.select("image_id", F.col("box_idx").alias("place"), F.struct("category_id", "x1", "y1", "x2", "y2").alias("box"))
    # Some IoUs, such as 101/1024, lie just between two numbers of nine digits, where engines round either way.
    found = overlap.best_matches(side(P.gold_box(spark, d)), side(P.pred_box(spark, d)), ["image_id"], digits=12)
    return found.select("image_id", F.col("place").alias("gold_idx"), F.col("place_found").alias("pred_idx"), "iou")


def reaction_hits_exact(spark, d):
    """Hit flags of both sides' reactions, from boxes paired by grid cells."""
    return overlap.hits(P.gold(spark, d), P.pred(spark, d), ["image_id"], "exact", P.DIGITS)


def reaction_hits_soft(spark, d):
    return overlap.hits(P.gold(spark, d), P.pred(spark, d), ["image_id"], "soft", P.DIGITS)


def dedup_reactions_rounds(spark, d):
    return overlap.kept_reactions(_doubled(spark, d), ["image_id"], digits=P.DIGITS).select("image_id", "rxn_id")


def postprocess_reactions_rounds(spark, d):
    done = dedup.in_roles(overlap.postprocess(_doubled(spark, d), ["image_id"], P.DIGITS))
    return done.select("image_id", "rxn_id", F.size("boxes").cast("long").alias("n_boxes"))


QUERIES = {f.__name__: f for f in (bbox_normalize, bbox_unnormalize, bbox_flags, bbox_crop_rect, bbox_to_coco, bbox_center, clamp_boxes, iou_pairs, bbox_match, bbox_match_category, reaction_schema, reaction_compare_exact, reaction_compare_soft, eval_exact_overall, eval_soft_overall, eval_by_size, eval_by_group, eval_by_group_soft, eval_summarize, eval_cv_union, score_table, eval_images, dedup_boxes, dedup_boxes_all, dedup_reactions, postprocess_reactions, bbox_match_images, reaction_hits_exact, reaction_hits_soft, dedup_reactions_rounds, postprocess_reactions_rounds)}
#: Evaluations of predictions as they are, by their SQL; each has a twin that removes duplicates first, as the reference does.
SCORED = ("eval_exact_overall", "eval_soft_overall", "eval_by_size", "eval_by_group", "eval_by_group_soft", "eval_summarize", "eval_cv_union", "score_table", "eval_images")
QUERIES |= {f"{n}_deduplicated": partial(QUERIES[n], pred=whole_pred) for n in SCORED}

V = P.VIEWS
_FOUND = f"best AS (SELECT g.image_id, g.rxn_id, g.box_idx AS gold_idx, p.place, %s AS iou FROM g JOIN p USING (image_id, rxn_id)), ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, rxn_id, gold_idx ORDER BY iou DESC, place) AS k FROM best)"
_MATCHED = "SELECT image_id, rxn_id, gold_idx, CASE WHEN iou >= 0.5e0 THEN place ELSE -1 END AS place, iou FROM ranked WHERE k = 1"
_SAME = "SELECT g.image_id, g.rxn_id, coalesce(bool_or(e.l IS NOT NULL), false) AS same FROM (SELECT DISTINCT image_id, rxn_id FROM g) g JOIN (SELECT DISTINCT image_id, rxn_id FROM p) p USING (image_id, rxn_id) LEFT JOIN %s e ON e.image_id = g.image_id AND e.l = g.rxn_id AND e.r = g.rxn_id GROUP BY ALL"
_TURN = "CASE role WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END"
#: Boxes in scan order; a fold by recursion over a reaction's boxes.
_FOLD = f"""turns AS (SELECT *, row_number() OVER (PARTITION BY image_id, rxn_id ORDER BY {_TURN}, place) AS t, abs(x2 - x1) <= 0.01e0 OR abs(y2 - y1) <= 0.01e0 AS empty FROM g),
near AS (SELECT b.image_id, b.rxn_id, b.t, a.t AS s FROM turns a JOIN turns b ON a.image_id = b.image_id AND a.rxn_id = b.rxn_id AND a.t < b.t WHERE {P.iou_sql('a', 'b')} > 0.6e0),
fold AS (SELECT image_id, rxn_id, 0 AS t, CAST([] AS BIGINT[]) AS stay FROM (SELECT DISTINCT image_id, rxn_id FROM turns)
  UNION ALL SELECT f.image_id, f.rxn_id, f.t + 1, CASE WHEN c.empty OR list_has_any(f.stay, coalesce(n.s, CAST([] AS BIGINT[]))) THEN f.stay ELSE list_append(f.stay, c.t) END
  FROM fold f JOIN turns c ON c.image_id = f.image_id AND c.rxn_id = f.rxn_id AND c.t = f.t + 1 LEFT JOIN (SELECT image_id, rxn_id, t, list(s) AS s FROM near GROUP BY ALL) n ON n.image_id = c.image_id AND n.rxn_id = c.rxn_id AND n.t = c.t)"""
_RECURSIVE = V.replace("WITH ", "WITH RECURSIVE ", 1)
_DOUBLE = "d AS (SELECT image_id, rxn_id, box_idx, role, category_id, x1, y1, x2, y2, place FROM p UNION ALL SELECT image_id, rxn_id + 1000, box_idx, role, category_id, x1, y1, x2, y2, place FROM p WHERE image_id % 3 = 0)"
_EQUAL = P.compare_sql("eq", "d", "d", extra="AND l.rxn_id < r.rxn_id")
_REACTION_FOLD = """whole AS (SELECT image_id, rxn_id, row_number() OVER (PARTITION BY image_id ORDER BY rxn_id) AS t, bool_or(role = 0) AND bool_or(role = 2) AS whole FROM d GROUP BY image_id, rxn_id),
before AS (SELECT image_id, r, list(l) AS ls FROM eq GROUP BY ALL),
fold AS (SELECT image_id, 0 AS t, CAST([] AS BIGINT[]) AS stay FROM (SELECT DISTINCT image_id FROM d)
  UNION ALL SELECT f.image_id, f.t + 1, CASE WHEN NOT w.whole OR list_has_any(f.stay, coalesce(b.ls, CAST([] AS BIGINT[]))) THEN f.stay ELSE list_append(f.stay, w.rxn_id) END
  FROM fold f JOIN whole w ON w.image_id = f.image_id AND w.t = f.t + 1 LEFT JOIN before b ON b.image_id = w.image_id AND b.r = w.rxn_id)"""

ORACLE_SQL = {
    "bbox_normalize": f"{V} SELECT image_id, box_idx, x1, y1, x2, y2 FROM gold_box",
    "bbox_unnormalize": f"{V} SELECT image_id, box_idx, round(x1 * 1000e0, 6) AS x1, round(y1 * 800e0, 6) AS y1, round(x2 * 1000e0, 6) AS x2, round(y2 * 800e0, 6) AS y2 FROM gold_box",
    "bbox_flags": f"{V} SELECT image_id, box_idx, category_id = 1 AS is_mol, abs(x2 - x1) <= 0.01e0 OR abs(y2 - y1) <= 0.01e0 AS is_empty FROM gold_box",
    "bbox_crop_rect": f"{V} SELECT image_id, box_idx, greatest(CAST(trunc(x1 * 1000e0) AS BIGINT), 0) AS x1, greatest(CAST(trunc(y1 * 800e0) AS BIGINT), 0) AS y1, least(CAST(trunc(x2 * 1000e0) AS BIGINT), 1000) AS x2, least(CAST(trunc(y2 * 800e0) AS BIGINT), 800) AS y2 FROM gold_box",
    "bbox_to_coco": f"{V} SELECT image_id, box_idx, round(x1 * 1000e0, 6) AS x, round(y1 * 800e0, 6) AS y, round((x2 - x1) * 1000e0, 6) AS w, round((y2 - y1) * 800e0, 6) AS h FROM gold_box",
    "bbox_center": f"{V} SELECT image_id, box_idx, round((x1 + x2) / 2e0, 9) AS cx, round((y1 + y2) / 2e0, 9) AS cy, round(x2 - x1, 9) AS w, round(y2 - y1, 9) AS h, round((x1 + x2) / 2e0 - (x2 - x1) / 2e0, 9) AS x1, round((y1 + y2) / 2e0 - (y2 - y1) / 2e0, 9) AS y1, round((x1 + x2) / 2e0 + (x2 - x1) / 2e0, 9) AS x2, round((y1 + y2) / 2e0 + (y2 - y1) / 2e0, 9) AS y2 FROM gold_box",
    "clamp_boxes": f"{V} SELECT image_id, box_idx, least(greatest(x, 0e0), 600e0) AS x1, least(greatest(y, 0e0), 400e0) AS y1, least(greatest(x + w, 0e0), 600e0) AS x2, least(greatest(y + h, 0e0), 400e0) AS y2, w * h AS area FROM gold_px",
    "iou_pairs": f"{V} SELECT g.image_id, g.box_idx AS gold_idx, p.box_idx AS pred_idx, {P.iou_sql('g', 'p')} AS iou FROM g JOIN p USING (image_id, rxn_id)",
    "bbox_match": f"{V}, {_FOUND % P.iou_sql('g', 'p')} {_MATCHED}",
    "bbox_match_category": f"{V}, {_FOUND % ('CASE WHEN g.category_id <> p.category_id THEN 0e0 ELSE ' + P.iou_sql('g', 'p') + ' END')} {_MATCHED}",
    "reaction_schema": f"{V}, c AS (SELECT image_id, rxn_id, role, count(*) AS n, count(*) FILTER (WHERE category_id = 1) AS m FROM g GROUP BY ALL) SELECT image_id, rxn_id, CAST(coalesce(sum(CASE WHEN m > 0 THEN m ELSE n END) FILTER (WHERE role = 0), 0) AS BIGINT) AS reactants, CAST(coalesce(sum(m) FILTER (WHERE role = 1), 0) AS BIGINT) AS conditions, CAST(coalesce(sum(CASE WHEN m > 0 THEN m ELSE n END) FILTER (WHERE role = 2), 0) AS BIGINT) AS products FROM c GROUP BY ALL",
    "reaction_compare_exact": f"{V}, {P.EXACT} {_SAME % 'exact'}",
    "reaction_compare_soft": f"{V}, {P.SOFT} {_SAME % 'soft'}",
    "eval_exact_overall": P.scores_sql("exact"),
    "eval_soft_overall": P.scores_sql("soft"),
    "eval_by_size": f"{V}, {P.EXACT}, {P.counts_sql('exact')} SELECT size, {P.SCORES} FROM (SELECT {P.RATES} FROM (SELECT gold_total AS size, {P.SUMS} FROM counts GROUP BY counts.gold_total))",
    "eval_by_group": P.scores_sql("exact", "diagram_type"),
    "eval_by_group_soft": P.scores_sql("soft", "diagram_type"),
    "eval_summarize": f"{V}, {P.EXACT}, {P.counts_sql('exact')}, sized AS (SELECT *, gold_total AS size FROM counts) SELECT size, {P.SCORES} FROM (SELECT {P.RATES} FROM (SELECT size, {P.SUMS} FROM sized GROUP BY ROLLUP (size)))",
    "eval_cv_union": P.scores_sql("exact", "split"),
    "score_table": f"SELECT concat_ws('  ', rpad(diagram_type, 20, ' '), {', '.join(f"printf('%5.1f', 100 * {c})" for c in ('precision', 'recall', 'f1'))}) AS line FROM ({P.scores_sql('exact', 'diagram_type')})",
    "eval_images": f"{V}, {P.EXACT}, {P.counts_sql('exact')} SELECT image_id, gold_hits, gold_total, pred_hits, pred_total FROM counts",
    "dedup_boxes": f"{_RECURSIVE}, {_FOLD}, done AS (SELECT image_id, rxn_id, arg_max(stay, t) AS stay FROM fold GROUP BY ALL) SELECT t.image_id, t.rxn_id, t.box_idx FROM turns t JOIN done USING (image_id, rxn_id) WHERE list_contains(done.stay, t.t)",
    "dedup_boxes_all": f"{V} SELECT b.image_id, b.rxn_id, b.box_idx FROM g b WHERE NOT EXISTS (SELECT 1 FROM g a WHERE a.image_id = b.image_id AND a.rxn_id = b.rxn_id AND a.place < b.place AND {P.iou_sql('a', 'b')} > 0.6e0)",
    "dedup_reactions": f"{_RECURSIVE}, {_DOUBLE}, {_EQUAL}, {_REACTION_FOLD}, done AS (SELECT image_id, arg_max(stay, t) AS stay FROM fold GROUP BY ALL) SELECT image_id, unnest(stay) AS rxn_id FROM done",
}

#: The views, with p as what the fold over the predictions keeps.
_WHOLE = f"""{_RECURSIVE.replace(P._placed("p", "pred_box"), P._placed("d", "pred_box"))}, {_EQUAL}, {_REACTION_FOLD.replace("AS (SELECT image_id, r", "AS MATERIALIZED (SELECT image_id, r")},
done AS MATERIALIZED (SELECT image_id, arg_max(stay, t) AS stay FROM fold GROUP BY ALL),
p AS (SELECT d.* FROM d JOIN done USING (image_id) WHERE list_contains(done.stay, d.rxn_id))"""
ORACLE_SQL |= {f"{n}_deduplicated": ORACLE_SQL[n].replace(V, _WHOLE) for n in SCORED}

_BOX_FOLD = _FOLD.replace("FROM g)", "FROM d1)").replace("fold AS", "box_fold AS").replace("FROM fold f", "FROM box_fold f")
_KEPT_FOLD = (
    _REACTION_FOLD.replace("bool_or(role = 0) AND bool_or(role = 2)", "coalesce(bool_or(role = 0) FILTER (WHERE kept), false) AND coalesce(bool_or(role = 2) FILTER (WHERE kept), false)")
    .replace("FROM d ", "FROM d2 ").replace("FROM d)", "FROM d2)").replace("FROM eq", "FROM eq2")
    .replace("whole AS (", "whole2 AS (").replace("before AS (", "before2 AS (").replace("fold AS (", "fold2 AS (").replace("FROM fold f", "FROM fold2 f").replace("JOIN whole w", "JOIN whole2 w").replace("JOIN before b", "JOIN before2 b")
)
ORACLE_SQL["postprocess_reactions"] = f"""{_RECURSIVE}, {_DOUBLE}, {_EQUAL}, {_REACTION_FOLD},
done AS MATERIALIZED (SELECT image_id, arg_max(stay, t) AS stay FROM fold GROUP BY ALL),
d1 AS MATERIALIZED (SELECT d.* FROM d JOIN done USING (image_id) WHERE list_contains(done.stay, d.rxn_id)),
{_BOX_FOLD},
box_done AS MATERIALIZED (SELECT image_id, rxn_id, arg_max(stay, t) AS stay FROM box_fold GROUP BY ALL),
d2 AS MATERIALIZED (SELECT turns.*, list_contains(box_done.stay, turns.t) AS kept FROM turns JOIN box_done USING (image_id, rxn_id)),
{P.compare_sql("eq2", "d2", "d2", extra="AND l.rxn_id < r.rxn_id", kept=True)},
{_KEPT_FOLD},
done2 AS MATERIALIZED (SELECT image_id, arg_max(stay, t) AS stay FROM fold2 GROUP BY ALL)
SELECT image_id, rxn_id, count(*) FILTER (WHERE kept) AS n_boxes FROM d2 JOIN done2 USING (image_id) WHERE list_contains(done2.stay, rxn_id) GROUP BY ALL"""

_HITS = "SELECT s.image_id, 'gold' AS side, s.rxn_id, EXISTS (SELECT 1 FROM %s e WHERE e.image_id = s.image_id AND e.l = s.rxn_id) AS hit FROM (SELECT DISTINCT image_id, rxn_id FROM g) s UNION ALL SELECT s.image_id, 'pred', s.rxn_id, EXISTS (SELECT 1 FROM %s e WHERE e.image_id = s.image_id AND e.r = s.rxn_id) FROM (SELECT DISTINCT image_id, rxn_id FROM p) s"
ORACLE_SQL |= {
    "bbox_match_images": f"""{V}, every AS (SELECT g.image_id, g.box_idx AS gold_idx, p.box_idx AS pred_idx, coalesce({P.iou_sql('g', 'p', 12)}, 0e0) AS iou FROM g LEFT JOIN p ON p.image_id = g.image_id)
SELECT image_id, gold_idx, CASE WHEN iou >= 0.5e0 THEN pred_idx ELSE -1 END AS pred_idx, iou FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gold_idx ORDER BY iou DESC, pred_idx) AS k FROM every) WHERE k = 1""",
    "reaction_hits_exact": f"{V}, {P.EXACT} {_HITS % ('exact', 'exact')}",
    "reaction_hits_soft": f"{V}, {P.SOFT} {_HITS % ('soft', 'soft')}",
    "dedup_reactions_rounds": ORACLE_SQL["dedup_reactions"],
    "postprocess_reactions_rounds": ORACLE_SQL["postprocess_reactions"],
}
