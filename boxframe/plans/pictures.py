"""Queries: pictures painted from boxes, stored as PNG files, decoded and transformed; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxframe.functions import pixels as X
from boxframe.operators import batching, pictures
from boxframe.operators.augment import uniform
from boxframe.plans import proxies as P

#: Pictures are a fortieth of the boxes' sheet in either direction.
SCALE, WIDTH, HEIGHT = 40, 25, 20
COLOURS = [(255, 255, 255), (200, 30, 30), (30, 160, 60), (40, 60, 200), (220, 180, 40)]


def files(spark, d):
    """A PNG file of each picture."""
    cell = lambda c, most: F.least(c, F.lit(most)).cast("int")
    corners = {"x0": cell(F.floor(F.col("x") / SCALE), WIDTH), "y0": cell(F.floor(F.col("y") / SCALE), HEIGHT), "x1": cell(F.ceil((F.col("x") + F.col("w")) / SCALE), WIDTH), "y1": cell(F.ceil((F.col("y") + F.col("h")) / SCALE), HEIGHT)}
    boxes = P.gold_box(spark, d).select("image_id", F.col("box_idx").alias("place"), F.col("category_id").cast("int").alias("colour"), *(c.alias(n) for n, c in corners.items()))
    return pictures.painted(boxes, "image_id", WIDTH, HEIGHT, COLOURS)


def _digest(made):
    return made.select("image_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.md5(F.hex("pixels")).alias("pixels"))


def picture_pixels(spark, d):
    return _digest(pictures.pictures(files(spark, d), keys=["image_id"]))


def turned_pixels(spark, d):
    """Training views' turn and flip: the same draws as the boxes have."""
    drawn = lambda seed: uniform(seed, F.col("image_id")) < 0.5
    return _digest(pictures.pictures(files(spark, d), (X.rotate90, [drawn(51)]), (X.hflip, [drawn(52)]), keys=["image_id"]))


def cropped_pixels(spark, d):
    """A region that reaches over the right border, then a margin."""
    region = [(F.col("image_id") % 15).cast("int"), F.lit(4), F.lit(12), F.lit(9)]
    return _digest(pictures.pictures(files(spark, d), (X.crop, region), (X.pad, [F.lit(3), (F.col("image_id") % 3).cast("int"), F.lit(255)]), keys=["image_id"]))


def batched_pixels(spark, d):
    """Pictures of several sizes by batches of eight, each filled with zeros up to its batch's largest sides."""
    sides = {"w": F.lit(10) + F.col("image_id") % 15, "h": F.lit(8) + F.col("image_id") % 11}
    ids = P.gold_box(spark, d).select("image_id").distinct()
    batches = batching.batch_sides(ids.select("image_id", batching.batch_number(F.col("image_id"), 8).alias("batch"), *(c.cast("int").alias(n) for n, c in sides.items())), "batch", "w", "h")
    cut = [F.lit(0), F.lit(0), F.col("w"), F.col("h")]
    fill = [F.col("batch_width") - F.col("w"), F.col("batch_height") - F.col("h"), F.lit(0)]
    return _digest(pictures.pictures(files(spark, d).join(batches, "image_id"), (X.crop, cut), (X.pad, fill), keys=["image_id"]))


def erased_pixels(spark, d):
    return _digest(pictures.pictures(files(spark, d), (X.erase, [pictures.erasing(F.lit(WIDTH), F.lit(HEIGHT), 53, F.col("image_id"))]), keys=["image_id"]))


def distorted_pixels(spark, d):
    """Brightness, contrast and saturation in this order; the hue and drawn orders are tested on small pictures."""
    factors = pictures.distorting([0.5, 0.5, 0.5], 54, F.col("image_id"))[0]
    return _digest(pictures.pictures(files(spark, d), (X.distort, [factors]), keys=["image_id"]))


QUERIES = {f.__name__: f for f in (picture_pixels, turned_pixels, cropped_pixels, batched_pixels, erased_pixels, distorted_pixels)}

_RGB = lambda k: "[" + ", ".join(str(c[k]) for c in COLOURS) + "][coalesce(h.c, 0) + 1]"
_CELLS = f"""{P.VIEWS}, k AS (SELECT image_id, box_idx, category_id, CAST(floor(x / {SCALE}) AS BIGINT) AS x0, CAST(floor(y / {SCALE}) AS BIGINT) AS y0, least(CAST(ceil((x + w) / {SCALE}) AS BIGINT), {WIDTH}) AS x1, least(CAST(ceil((y + h) / {SCALE}) AS BIGINT), {HEIGHT}) AS y1 FROM gold_px),
kx AS (SELECT *, unnest(range(x0, x1)) AS x FROM k), kxy AS (SELECT *, unnest(range(y0, y1)) AS y FROM kx),
h AS (SELECT image_id, x, y, arg_max(category_id, box_idx) AS c FROM kxy GROUP BY ALL),
i AS (SELECT image_id, unnest(range({WIDTH * HEIGHT})) AS p FROM (SELECT DISTINCT image_id FROM gold_px)),
cell AS (SELECT i.image_id, i.p % {WIDTH} AS x, i.p // {WIDTH} AS y, {_RGB(0)} AS r, {_RGB(1)} AS g, {_RGB(2)} AS b FROM i LEFT JOIN h ON h.image_id = i.image_id AND h.x = i.p % {WIDTH} AND h.y = i.p // {WIDTH})"""
_U = lambda seed, *more: "((CAST('0x' || substr(md5(concat_ws(':', " + ", ".join([f"'{seed}'", "CAST(image_id AS VARCHAR)", *(f"'{m}'" if isinstance(m, str) else m[0] for m in more)]) + ")), 1, 13) AS BIGINT)) / 4503599627370496e0)"
_PUT = "SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, md5(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x)) AS pixels FROM"


def _erase() -> str:
    n = ("CAST(n AS VARCHAR)",)
    low, high = "ln(0.3e0)", "ln(3.3e0)"
    return f"""{_CELLS}, t AS (SELECT image_id, unnest(range(10)) AS n FROM (SELECT DISTINCT image_id FROM gold_px) WHERE {_U(53)} < 0.5e0),
a AS (SELECT *, (0.02e0 + {_U(53, n, 'area')} * (0.33e0 - 0.02e0)) * {WIDTH} * {HEIGHT} AS area, exp({low} + {_U(53, n, 'ratio')} * ({high} - {low})) AS form FROM t),
s AS (SELECT *, CAST(round_even(sqrt(area * form), 0) AS BIGINT) AS eh, CAST(round_even(sqrt(area / form), 0) AS BIGINT) AS ew FROM a),
f AS (SELECT * FROM s WHERE ew < {WIDTH} AND eh < {HEIGHT} QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n) = 1),
e AS (SELECT image_id, ew, eh, CAST(floor({_U(53, n, 'x')} * ({WIDTH} - ew + 1)) AS BIGINT) AS ex, CAST(floor({_U(53, n, 'y')} * ({HEIGHT} - eh + 1)) AS BIGINT) AS ey FROM f),
o AS (SELECT c.image_id, x, y, coalesce(x >= ex AND x < ex + ew AND y >= ey AND y < ey + eh, false) AS gone, r, g, b FROM cell c LEFT JOIN e USING (image_id))
{_PUT} (SELECT image_id, x, y, CASE WHEN gone THEN 0 ELSE r END AS r, CASE WHEN gone THEN 0 ELSE g END AS g, CASE WHEN gone THEN 0 ELSE b END AS b FROM o) GROUP BY 1"""


def _distort() -> str:
    blend = lambda base, f: ", ".join(f"CAST(floor(least(greatest({base} + {f} * ({c} - {base}), 0e0), 255e0)) AS BIGINT) AS {c}" for c in "rgb")
    grey = f"((r * {X.GREY[0]} + g * {X.GREY[1]} + b * {X.GREY[2]} + 32768) >> 16)"
    factors = ", ".join(f"1e0 + (2 * {_U(54, str(i))} - 1) * 0.5e0 AS f{i}" for i in range(3))
    return f"""{_CELLS}, f AS (SELECT image_id, {_U(54)} < 0.5e0 AS wanted, {factors} FROM (SELECT DISTINCT image_id FROM gold_px)),
d0 AS (SELECT image_id, x, y, r, g, b, wanted, f0, f1, f2 FROM cell JOIN f USING (image_id)),
d1 AS (SELECT * EXCLUDE (r, g, b), {blend('0e0', 'f0')} FROM d0 WHERE wanted),
m AS (SELECT image_id, floor(avg({grey}) + 0.5e0) AS mean FROM d1 GROUP BY 1),
d2 AS (SELECT d1.* EXCLUDE (r, g, b), {blend('mean', 'f1')} FROM d1 JOIN m USING (image_id)),
d3 AS (SELECT image_id, x, y, {blend(f'CAST({grey} AS DOUBLE)', 'f2')} FROM d2)
{_PUT} (SELECT * FROM d3 UNION ALL SELECT image_id, x, y, r, g, b FROM d0 WHERE NOT wanted) GROUP BY 1"""


ORACLE_SQL = {
    "picture_pixels": f"{_CELLS} {_PUT} cell GROUP BY 1",
    "turned_pixels": f"""{_CELLS}, t AS (SELECT image_id, {_U(51)} < 0.5e0 AS turned, {_U(52)} < 0.5e0 AS flipped, x, y, r, g, b FROM cell),
u AS (SELECT image_id, flipped, CASE WHEN turned THEN {HEIGHT} ELSE {WIDTH} END AS w, CASE WHEN turned THEN y ELSE x END AS x, CASE WHEN turned THEN {WIDTH} - 1 - x ELSE y END AS y, r, g, b FROM t)
{_PUT} (SELECT image_id, CASE WHEN flipped THEN w - 1 - x ELSE x END AS x, y, r, g, b FROM u) GROUP BY 1""",
    "cropped_pixels": f"""{_CELLS}, w AS (SELECT image_id, unnest(range(15 * (9 + image_id % 3))) AS p FROM (SELECT DISTINCT image_id FROM gold_px)),
z AS (SELECT image_id, p % 15 AS x, p // 15 AS y, p % 15 < 12 AND p // 15 < 9 AS inside FROM w)
{_PUT} (SELECT z.image_id, z.x, z.y, CASE WHEN inside THEN coalesce(r, 0) ELSE 255 END AS r, CASE WHEN inside THEN coalesce(g, 0) ELSE 255 END AS g, CASE WHEN inside THEN coalesce(b, 0) ELSE 255 END AS b
  FROM z LEFT JOIN cell c ON c.image_id = z.image_id AND c.x = z.x + z.image_id % 15 AND c.y = z.y + 4) GROUP BY 1""",
    "batched_pixels": f"""{_CELLS}, sized AS (SELECT DISTINCT image_id, image_id // 8 AS batch, 10 + image_id % 15 AS w, 8 + image_id % 11 AS h FROM gold_px),
batched AS (SELECT *, max(w) OVER (PARTITION BY batch) AS bw, max(h) OVER (PARTITION BY batch) AS bh FROM sized),
spot AS (SELECT *, unnest(range(bw * bh)) AS p FROM batched), framed AS (SELECT image_id, p % bw AS x, p // bw AS y, p % bw < w AND p // bw < h AS inside FROM spot)
{_PUT} (SELECT image_id, x, y, CASE WHEN inside THEN r ELSE 0 END AS r, CASE WHEN inside THEN g ELSE 0 END AS g, CASE WHEN inside THEN b ELSE 0 END AS b FROM framed LEFT JOIN cell c USING (image_id, x, y)) GROUP BY 1""",
    "erased_pixels": _erase(),
    "distorted_pixels": _distort(),
}
