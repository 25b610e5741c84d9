"""Queries: target transforms, batching, meters, files and COCO scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxframe.functions import geometry as G
from boxframe.operators import augment, batching, coco, inference, meters
from boxframe.plans import proxies as P
from boxframe.sources import annotations

W, H = P.WIDTH, P.HEIGHT
KEY = ["image_id", "box_idx"]


def _px() -> G.Box:
    return G.Box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))


def _put(spark, d, box, *more, digits=6):
    return P.gold_box(spark, d).select(*KEY, *(F.round(c, digits).alias(n) for n, c in zip(box._fields, box, strict=True)), *more)


def hflip(spark, d):
    return _put(spark, d, G.hflip(_px(), W))


def rotate90(spark, d):
    return _put(spark, d, G.rotate90(_px(), W))


def crop_boxes(spark, d):
    box = G.crop(_px(), F.lit(100.0), F.lit(50.0), F.lit(400.0), F.lit(300.0))
    return _put(spark, d, box, F.round(box.area, 6).alias("area"))


def center_crop_boxes(spark, d):
    return _put(spark, d, augment.center_crop(_px(), W, H, F.lit(501.0), F.lit(300.0)))


def resize_boxes(spark, d):
    """Shorter side at 480 unless the longer would pass 640; each order's picture has its own shape."""
    boxes = P.gold_box(spark, d).withColumn("width", 300 + F.col("image_id") % 701).withColumn("height", 200 + F.col("image_id") % 601)
    w, h = G.resized(F.col("width"), F.col("height"), 480, 640)
    box = G.scaled(_px(), w / F.col("width"), h / F.col("height"))
    return boxes.select(*KEY, w.alias("new_width"), h.alias("new_height"), *(F.round(c, 6).alias(n) for n, c in zip(box._fields, box, strict=True)))


def jitter_eval_scale(spark, d):
    box, sx, sy = augment.jitter(_px(), W, H)
    return _put(spark, d, box, F.round(sx, 9).alias("scale_x"), F.round(sy, 9).alias("scale_y"))


def normalize_targets(spark, d):
    return _put(spark, d, G.normalised(_px(), F.lit(600.0), F.lit(500.0)), digits=9)


def free_spans(spark, d):
    """Parts of each picture's width that no reaction covers."""
    spans = P.gold_box(spark, d).groupBy("image_id", "rxn_id").agg(F.min("x").alias("low"), F.max(F.col("x") + F.col("w")).alias("high"))
    return augment.free_spans(spans, ["image_id"], "low", "high", W)


def concat_targets(spark, d):
    """Each even picture with the next one below it, if there is one: boxes moved down, reactions' box numbers rebased."""
    boxes = P.gold_box(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("box_idx", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), "rxn_id"))).alias("boxes"))
    first = boxes.filter(F.col("image_id") % 2 == 0)
    second = boxes.filter(F.col("image_id") % 2 == 1).select((F.col("image_id") - 1).alias("image_id"), F.col("boxes").alias("more"))
    both = first.join(second, "image_id", "left").withColumn("more", F.coalesce("more", F.slice("boxes", 1, 0)))
    put = augment.below(F.col("boxes"), F.col("more"), H, F.lit(25.0))
    numbers = F.concat(F.transform("boxes", lambda b: b["box_idx"]), augment.rebased(F.transform("more", lambda b: b["box_idx"]), F.size("boxes").cast("long")))
    rows = both.select("image_id", F.posexplode(F.arrays_zip(put.alias("b"), numbers.alias("n"))).alias("place", "z"))
    return rows.select("image_id", F.col("place").cast("long").alias("place"), F.col("z.n").alias("number"), F.round("z.b.x1", 6).alias("x1"), F.round("z.b.y1", 6).alias("y1"), F.round("z.b.x2", 6).alias("x2"), F.round("z.b.y2", 6).alias("y2"))


def _sequences(spark, d):
    words = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), lambda w: F.length(w).cast("long"))
    return P.read(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), batching.batch_number(F.col("conv_id"), 8).alias("batch"), words.alias("sequence"))


def pad_sequences(spark, d):
    done = batching.padded(_sequences(spark, d), "batch", "sequence", 2001)
    return done.select("conv_id", "turn", "batch", "length", F.array_join(F.transform("sequence", lambda x: x.cast("string")), " ").alias("sequence"))


def pad_masks(spark, d):
    images = P.image(spark, d).select("image_id", batching.batch_number(F.col("image_id"), 16).alias("batch"), (300 + F.col("image_id") % 701).alias("width"), (200 + F.col("image_id") % 601).alias("height"))
    return batching.padding_mask(images, "batch", "width", "height")


def _sides(spark, d):
    images = P.image(spark, d).select("image_id", batching.batch_number(F.col("image_id"), 16).alias("batch"), (300 + F.col("image_id") % 701).alias("width"), (200 + F.col("image_id") % 601).alias("height"))
    return batching.batch_sides(images, "batch", "width", "height")


def pad_mask_bands(spark, d):
    """Masks of batches of sixteen as runs: a row for each band of equal rows."""
    bands = batching.mask_bands(*(F.col(c) for c in ("width", "height", "batch_width", "batch_height")))
    return _sides(spark, d).select("image_id", "batch", F.posexplode(bands).alias("band", "b")).select("image_id", "batch", F.col("band").cast("long").alias("band"), "b.*")


def pad_mask_bits(spark, d):
    """The same masks at a thirty-second of the pictures' resolution, bit by bit."""
    cells = {c: F.ceil(F.col(c) / 32) for c in ("batch_width", "batch_height")}
    w, h = (batching.cells_kept(F.col(c), F.col(f"batch_{c}"), cells[f"batch_{c}"]) for c in ("width", "height"))
    bits = batching.mask_bits(batching.mask_bands(w, h, *cells.values()))
    return _sides(spark, d).select("image_id", "batch", cells["batch_width"].alias("cells_wide"), cells["batch_height"].alias("cells_high"), bits.alias("bits"))


def inference_batches(spark, d):
    """Pictures by call of the model, sixteen each."""
    return P.image(spark, d).groupBy(batching.batch_number(F.col("image_id"), inference.PICTURES).alias("batch")).agg(F.count("*").alias("n"), F.min("image_id").alias("first"))


def draw_specs(spark, d):
    return inference.draw_specs(P.gold_box(spark, d)).select(*KEY, "colour", "label")


def state_keys(spark, d):
    """Wrapped parameter names by part type, and without the wrapper."""
    key = F.concat_ws(".", F.when(F.col("p_partkey") % 2 == 0, F.lit("model")), F.col("p_brand"), F.lit("model.weight"))
    return P.read(spark, d, "part").select("p_partkey", inference.plain_key(key).alias("key"))


def head_limit(spark, d):
    """The first hundred pictures of each split, in file order: Spark limits each split before the exchange."""
    pos = F.row_number().over(Window.partitionBy("split").orderBy("image_id"))
    return P.image(spark, d).withColumn("pos", pos).filter("pos <= 100").select("split", (F.col("pos") - 1).cast("long").alias("pos"), "image_id")


def dataset_name(spark, d):
    return P.read(spark, d, "pages").select("page_id", annotations.dataset_name(F.col("url")).alias("name"))


def reaction_json(spark, d):
    """Reactions as JSON text and read back: how many boxes each role has."""
    text = P.gold(spark, d).select("image_id", "rxn_id", annotations.reaction_json(P.gold(spark, d)).alias("json"))
    kind = "struct<reactants:array<struct<category_id:bigint>>,conditions:array<struct<category_id:bigint>>,products:array<struct<category_id:bigint>>>"
    back = F.from_json("json", kind)
    return text.select("image_id", "rxn_id", *(F.size(back[n]).cast("long").alias(n) for n in ("reactants", "conditions", "products")))


def merge_predictions(spark, d):
    return annotations.merge_predictions(P.read(spark, d, "events"), "user_id", "value", ["ts", "event_id"])


def missing_pictures(spark, d):
    """Orders without lines, as pictures that were named but aren't there."""
    names = P.read(spark, d, "orders").select(F.concat(F.col("o_orderkey"), F.lit(".png")).alias("file_name"))
    pictures = P.read(spark, d, "lineitem").select(F.concat(F.lit("images/"), F.col("l_orderkey"), F.lit(".png")).alias("path")).distinct()
    return annotations.missing(names, pictures)


def _events(spark, d):
    """Values in whole hundredths, whose sums are exact in any order."""
    return P.read(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("name"), F.rint(F.col("value") * 100).cast("long").alias("value"))


def smoothed_window(spark, d):
    done = meters.running(_events(spark, d), "name", "value", ["ts", "event_id"])
    return done.select("event_id", "name", "median", "avg", "max", "value_now", "global_avg")


def smoothed_global(spark, d):
    n = 1 + F.col("event_id") % 3
    return meters.totals(_events(spark, d), "name", "value", n).select("name", "count", "total", "global_avg")


def reduce_metrics(spark, d):
    return meters.reduced(_events(spark, d), "name", "value")


def log_every(spark, d):
    return meters.logged(_events(spark, d), "name", ["ts", "event_id"], 50, "value").select("event_id", "name", "i", "n", "eta")


def coco_scores(spark, d):
    """Twelve COCO numbers of predicted against gold boxes in pixels, scored by how little they were moved."""
    px = lambda b: b.select("image_id", "category_id", F.col("box_idx").alias("box"), *((F.col(c) * (W if c[0] == "x" else H)).alias(c) for c in ("x1", "y1", "x2", "y2")), "shift")
    done = coco.evaluate(px(P.gold_box(spark, d)), px(P.pred_box(spark, d)).withColumn("score", 1.0 - F.col("shift")))
    return done.select(*(F.round(c, 9).alias(c) for c in done.columns))


QUERIES = {f.__name__: f for f in (hflip, rotate90, crop_boxes, center_crop_boxes, resize_boxes, jitter_eval_scale, normalize_targets, free_spans, concat_targets, pad_sequences, pad_masks, pad_mask_bands, pad_mask_bits, inference_batches, draw_specs, state_keys, head_limit, dataset_name, reaction_json, merge_predictions, missing_pictures, smoothed_window, smoothed_global, reduce_metrics, log_every, coco_scores)}

_V = P.VIEWS
_B = "SELECT image_id, box_idx, "
_R = lambda **c: ", ".join(f"round({e}, 6) AS {n}" for n, e in c.items())
_CUT = lambda e, most: f"least(greatest({e}, 0e0), {most}e0)"
_CROP = {"x1": _CUT("x - 100e0", 400), "y1": _CUT("y - 50e0", 300), "x2": _CUT("x + w - 100e0", 400), "y2": _CUT("y + h - 50e0", 300)}
_SIZED = """s AS (SELECT *, 300 + image_id % 701 AS pw, 200 + image_id % 601 AS ph FROM gold_px),
g1 AS (SELECT *, CASE WHEN greatest(pw, ph) / CAST(least(pw, ph) AS DOUBLE) * 480 > 640 THEN round_even(640 * CAST(least(pw, ph) AS DOUBLE) / greatest(pw, ph), 0) ELSE 480e0 END AS t FROM s),
g2 AS (SELECT *, (pw <= ph AND pw = t) OR (ph <= pw AND ph = t) AS same FROM g1),
g3 AS (SELECT *, CAST(trunc(CASE WHEN same THEN pw WHEN pw < ph THEN t ELSE t * pw / ph END) AS BIGINT) AS nw, CAST(trunc(CASE WHEN same THEN ph WHEN pw < ph THEN t * ph / pw ELSE t END) AS BIGINT) AS nh FROM g2)"""
_SPANS = """r AS (SELECT image_id, CAST(round_even(min(x), 0) AS BIGINT) AS low, CAST(round_even(max(x + w), 0) AS BIGINT) AS high FROM gold_px GROUP BY image_id, rxn_id),
o AS (SELECT *, max(high) OVER (PARTITION BY image_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS till FROM r),
spans AS (SELECT image_id, coalesce(till, 0) AS start, greatest(low, coalesce(till, 0)) AS stop FROM o WHERE low > coalesce(till, 0) OR (till IS NULL AND low <= 0)
  UNION ALL SELECT image_id, least(max(high), 1000), 1000 FROM r GROUP BY image_id)"""
_SIDES = "i AS (SELECT image_id, image_id // 16 AS batch, 300 + image_id % 701 AS width, 200 + image_id % 601 AS height FROM image), m AS (SELECT *, max(width) OVER (PARTITION BY batch) AS batch_width, max(height) OVER (PARTITION BY batch) AS batch_height FROM i)"
_EV = "e AS (SELECT event_id, ts, event_type AS name, CAST(round_even(value * 100, 0) AS BIGINT) AS value FROM events)"
_LAST = "PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
_SOFAR = "PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

ORACLE_SQL = {
    "hflip": f"{_V} {_B} {_R(x1='1000e0 - (x + w)', y1='y', x2='1000e0 - x', y2='y + h')} FROM gold_px",
    "rotate90": f"{_V} {_B} {_R(x1='y', y1='1000e0 - (x + w)', x2='y + h', y2='1000e0 - x')} FROM gold_px",
    "crop_boxes": f"{_V} {_B} {_R(**_CROP, area='({}  - {}) * ({} - {})'.format(_CROP['x2'], _CROP['x1'], _CROP['y2'], _CROP['y1']))} FROM gold_px",
    "center_crop_boxes": f"{_V} {_B} {_R(x1=_CUT('x - 250e0', 501), y1=_CUT('y - 250e0', 300), x2=_CUT('x + w - 250e0', 501), y2=_CUT('y + h - 250e0', 300))} FROM gold_px",
    "resize_boxes": f"{_V}, {_SIZED} {_B} nw AS new_width, nh AS new_height, {_R(x1='x * (nw / CAST(pw AS DOUBLE))', y1='y * (nh / CAST(ph AS DOUBLE))', x2='(x + w) * (nw / CAST(pw AS DOUBLE))', y2='(y + h) * (nh / CAST(ph AS DOUBLE))')} FROM g3",
    "jitter_eval_scale": f"{_V} {_B} {_R(x1='x * 1.333e0', y1='y * (1066e0 / 800e0)', x2='(x + w) * 1.333e0', y2='(y + h) * (1066e0 / 800e0)')}, 1e0 AS scale_x, round(1066e0 / 1333e0, 9) AS scale_y FROM gold_px",
    "normalize_targets": f"{_V} {_B} {', '.join(f'round(least(greatest(({e}) / {m}e0, 0e0), 1e0), 9) AS {n}' for n, e, m in (('x1', 'x', 600), ('y1', 'y', 500), ('x2', 'x + w', 600), ('y2', 'y + h', 500)))} FROM gold_px",
    "free_spans": f"{_V}, {_SPANS} SELECT * FROM spans",
    "concat_targets": f"{_V}, n AS (SELECT image_id, count(*) AS n FROM gold_px GROUP BY 1), ok AS (SELECT image_id, n FROM n WHERE image_id % 2 = 0) SELECT g.image_id, box_idx AS place, box_idx AS number, {_R(x1='x', y1='y', x2='x + w', y2='y + h')} FROM gold_px g JOIN ok USING (image_id) UNION ALL SELECT ok.image_id, box_idx + n, box_idx + n, {_R(x1='x + 25e0', y1='y + 800e0', x2='x + w + 25e0', y2='y + h + 800e0')} FROM gold_px g JOIN ok ON g.image_id = ok.image_id + 1",
    "pad_sequences": "WITH s AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, conv_id // 8 AS batch, list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: CAST(length(w) AS BIGINT)) AS q FROM conversations), m AS (SELECT *, len(q) AS length, max(len(q)) OVER (PARTITION BY batch) AS most FROM s) SELECT conv_id, turn, batch, length, array_to_string(list_concat(q, list_transform(range(most - length), lambda i: 2001)), ' ') AS sequence FROM m",
    "pad_masks": f"{_V}, i AS (SELECT image_id, image_id // 16 AS batch, 300 + image_id % 701 AS width, 200 + image_id % 601 AS height FROM image), m AS (SELECT *, max(width) OVER (PARTITION BY batch) AS batch_width, max(height) OVER (PARTITION BY batch) AS batch_height FROM i) SELECT *, batch_width * batch_height - width * height AS masked FROM m",
    "pad_mask_bands": f"{_V}, {_SIDES}, n AS (SELECT *, unnest([0, 1]) AS band FROM m) SELECT image_id, batch, CAST(band AS BIGINT) AS band, CASE band WHEN 0 THEN 0 ELSE height END AS first, CASE band WHEN 0 THEN height ELSE batch_height - height END AS rows, CASE band WHEN 0 THEN width ELSE 0 END AS kept, CASE band WHEN 0 THEN batch_width - width ELSE batch_width END AS padded FROM n WHERE band = 0 OR batch_height > height",
    "pad_mask_bits": f"{_V}, {_SIDES}, c AS (SELECT *, (batch_width + 31) // 32 AS cells_wide, (batch_height + 31) // 32 AS cells_high FROM m) SELECT image_id, batch, cells_wide, cells_high, array_to_string(list_transform(range(cells_wide * cells_high), lambda i: CASE WHEN (i // cells_wide) * batch_height // cells_high < height AND (i % cells_wide) * batch_width // cells_wide < width THEN '0' ELSE '1' END), '') AS bits FROM c",
    "inference_batches": f"{_V} SELECT image_id // 16 AS batch, count(*) AS n, min(image_id) AS first FROM image GROUP BY 1",
    "draw_specs": f"{_V} {_B} CASE role WHEN 0 THEN 'r' WHEN 1 THEN 'g' ELSE 'b' END AS colour, ['[Mol]', '[Txt]', '[Idt]', '[Sup]'][category_id] AS label FROM gold_box",
    "state_keys": "SELECT p_partkey, concat_ws('.', p_brand, 'model.weight') AS key FROM part",
    "head_limit": f"{_V}, r AS (SELECT split, row_number() OVER (PARTITION BY split ORDER BY image_id) - 1 AS pos, image_id FROM image) SELECT * FROM r WHERE pos < 100",
    "dataset_name": "SELECT page_id, string_split(string_split(url, '/')[-1], '.')[1] AS name FROM pages",
    "reaction_json": f"{_V} SELECT image_id, rxn_id, count(*) FILTER (WHERE role = 0) AS reactants, count(*) FILTER (WHERE role = 1) AS conditions, count(*) FILTER (WHERE role = 2) AS products FROM gold_box GROUP BY ALL",
    "merge_predictions": "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "missing_pictures": "SELECT o_orderkey || '.png' AS file_name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "smoothed_window": f"WITH {_EV} SELECT event_id, name, quantile_disc(value, 0.5) OVER ({_LAST}) AS median, avg(value) OVER ({_LAST}) AS avg, max(value) OVER ({_LAST}) AS max, value AS value_now, avg(value) OVER ({_SOFAR}) AS global_avg FROM e",
    "smoothed_global": f"WITH {_EV} SELECT name, CAST(sum(1 + event_id % 3) AS BIGINT) AS count, CAST(sum(value * (1 + event_id % 3)) AS BIGINT) AS total, sum(value * (1 + event_id % 3)) / sum(1 + event_id % 3) AS global_avg FROM e GROUP BY name",
    "reduce_metrics": f"WITH {_EV} SELECT name, avg(value) AS value FROM e GROUP BY name",
    "log_every": f"WITH {_EV}, p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY name) AS n, avg(value) OVER ({_SOFAR}) AS a FROM e) SELECT event_id, name, i, n, a * (n - i) AS eta FROM p WHERE i % 50 = 0 OR i = n - 1",
}

_IOUS = "[0.5e0, 0.55e0, 0.6e0, 0.65e0, 0.7e0, 0.75e0, 0.8e0, 0.85e0, 0.9e0, 0.95e0]"
_PX = "image_id, category_id, box_idx AS box, x1 * 1000e0 AS x1, y1 * 800e0 AS y1, x2 * 1000e0 AS x2, y2 * 800e0 AS y2"
_MEAN = lambda c, when, name: f"coalesce(avg(coalesce({c}, 0e0)) FILTER (WHERE {when}), -1e0) AS {name}"
_NUMBERS = [_MEAN("ap", "area = 'all'", "ap"), *(_MEAN("ap", f"area = 'all' AND iou = {t}e0", n) for n, t in (("ap50", 0.5), ("ap75", 0.75))), *(_MEAN("ap", f"area = '{a}'", f"ap{a[0]}") for a in ("small", "medium", "large"))]
_NUMBERS += [*(_MEAN(f"hits{k} / total", "area = 'all'", f"ar{k}") for k in (1, 10, 100)), *(_MEAN("hits100 / total", f"area = '{a}'", f"ar{a[0]}") for a in ("small", "medium", "large"))]
#: Greedy matching by recursion over the ranks of an image's detections of a category, for each area and threshold; curves by plain windows.
ORACLE_SQL["coco_scores"] = f"""{_V.replace('WITH ', 'WITH RECURSIVE ', 1)},
pb AS (SELECT {_PX}, 1e0 - shift AS score FROM pred_box),
gb AS (SELECT {_PX} FROM gold_box WHERE image_id IN (SELECT image_id FROM pb)),
pr AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, box) - 1 AS rank, (x2 - x1) * (y2 - y1) AS size FROM pb) WHERE rank < 100),
ar AS (SELECT * FROM (VALUES ('all', 0e0, 1e10), ('small', 0e0, 1024e0), ('medium', 1024e0, 9216e0), ('large', 9216e0, 1e10)) AS a(area, least, most)),
ga AS (SELECT gb.*, area, (x2 - x1) * (y2 - y1) AS size, (x2 - x1) * (y2 - y1) < least OR (x2 - x1) * (y2 - y1) > most AS aside FROM gb, ar),
total AS (SELECT category_id, area, count(*) AS total FROM ga WHERE NOT aside GROUP BY ALL),
cand AS MATERIALIZED (SELECT * FROM (SELECT p.image_id, p.category_id, p.rank, g.area, g.box, g.aside, greatest(least(p.x2, g.x2) - greatest(p.x1, g.x1), 0e0) * greatest(least(p.y2, g.y2) - greatest(p.y1, g.y1), 0e0) AS inter, p.size + g.size AS sizes
  FROM pr p JOIN ga g ON g.image_id = p.image_id AND g.category_id = p.category_id) WHERE inter / greatest(sizes - inter, 1e-12) >= 0.5e0),
m AS (SELECT DISTINCT image_id, category_id, area, least, most, iou, CAST(-1 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS taken, false AS hit, false AS outs, 0e0 AS score FROM pr, ar, (SELECT unnest({_IOUS}) AS iou)
  UNION ALL SELECT image_id, category_id, area, least, most, iou, rank, CASE WHEN got IS NULL THEN taken ELSE list_append(taken, got.box) END, got IS NOT NULL, CASE WHEN got IS NULL THEN NOT (size BETWEEN least AND most) ELSE got.aside END, score FROM (
    SELECT m.image_id, m.category_id, m.area, m.least, m.most, m.iou, p.rank, m.taken, p.size, p.score,
      arg_max({{'box': c.box, 'aside': c.aside}}, (CAST(NOT c.aside AS INT), c.inter / greatest(c.sizes - c.inter, 1e-12), c.box)) FILTER (WHERE c.box IS NOT NULL) AS got
    FROM m JOIN pr p ON p.image_id = m.image_id AND p.category_id = m.category_id AND p.rank = m.rank + 1
    LEFT JOIN cand c ON c.image_id = p.image_id AND c.category_id = p.category_id AND c.rank = p.rank AND c.area = m.area AND c.inter / greatest(c.sizes - c.inter, 1e-12) >= m.iou AND NOT list_contains(m.taken, c.box)
    GROUP BY ALL)),
sc AS (SELECT m.*, CAST(hit AS INT) AS h, total FROM m JOIN total USING (category_id, area) WHERE rank >= 0 AND NOT outs),
pt AS (SELECT *, sum(h) OVER w / CAST(total AS DOUBLE) AS recall, sum(h) OVER w / CAST(row_number() OVER w AS DOUBLE) AS precision FROM sc WINDOW w AS (PARTITION BY category_id, area, iou ORDER BY score DESC, image_id, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
en AS (SELECT *, max(precision) OVER (PARTITION BY category_id, area, iou ORDER BY score DESC, image_id, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM pt),
rc AS (SELECT category_id, area, iou, recall, max(best) AS best FROM en GROUP BY ALL),
bf AS (SELECT *, coalesce(lag(recall) OVER (PARTITION BY category_id, area, iou ORDER BY recall), -1e0) AS since FROM rc),
ap AS (SELECT category_id, area, iou, sum(best * len(list_filter(range(101), lambda r: r / 100e0 <= recall + 1e-12 AND r / 100e0 > since + 1e-12))) / 101 AS ap FROM bf GROUP BY ALL),
hs AS (SELECT category_id, area, iou, {', '.join(f'CAST(sum(CASE WHEN rank < {k} THEN h ELSE 0 END) AS DOUBLE) AS hits{k}' for k in (1, 10, 100))} FROM sc GROUP BY ALL),
cells AS (SELECT *, unnest({_IOUS}) AS iou FROM total)
SELECT {', '.join(f'round({x.rsplit(" AS ", 1)[0]}, 9) AS {x.rsplit(" AS ", 1)[1]}' for x in _NUMBERS)} FROM cells LEFT JOIN ap USING (category_id, area, iou) LEFT JOIN hs USING (category_id, area, iou)"""
