"""Domain views over the test tables: images, gold and predicted boxes, logits, meters.

The tables hold no diagrams, so lines of orders stand for boxes and orders for
images. Each view comes as a DataFrame and as SQL with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxframe.functions.geometry import from_xywh
from boxframe.operators.matching import reactions
from boxframe.schemas import ROLES

WIDTH, HEIGHT = 1000.0, 800.0
#: IoUs are rounded where results are compared between engines.
DIGITS = 9


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("diagram_type"), (F.col("o_orderkey") % 5).alias("split"))


def gold_box(spark: SparkSession, sf_dir: str, near: dict[str, Column] | None = None) -> DataFrame:
    """Boxes of all images; with ``near`` (columns made of the image's key) too, those of one value of it in one task."""
    near = near or {}
    lines = read(spark, sf_dir, "lineitem")
    if near:
        lines = lines.withColumns(near).repartition(*near)
    order = Window.partitionBy(*near, "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = lines.withColumn("box_idx", (F.row_number().over(order) - 1).cast("long"))
    place = F.col("box_idx") % 3
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    d = lambda c: c.cast("double")
    xywh = F.col("l_quantity") * 10.0, d(supplier % 50) * 10.0, d(20 + part % 300), d(20 + part % 7 * 30)
    box = from_xywh(*xywh, WIDTH, HEIGHT)
    return lines.select(
        F.col("l_orderkey").alias("image_id"),
        "box_idx",
        F.floor(F.col("box_idx") / 3).alias("rxn_id"),
        F.when(place == 0, 0).when(place == 1, 2).otherwise(1).cast("long").alias("role"),
        (1 + (part + F.col("box_idx")) % 4).alias("category_id"),
        *(c.alias(n) for c, n in zip(xywh, "xywh", strict=True)),
        *box.named(),
        F.col("l_tax").alias("shift"),
        *near,
    )


def pred_box(spark: SparkSession, sf_dir: str, near: dict[str, Column] | None = None) -> DataFrame:
    key = F.col("image_id") + F.col("rxn_id")
    swapped = F.when((key % 7 == 0) & (F.col("role") < 2), 1 - F.col("role")).otherwise(F.col("role"))
    boxes = gold_box(spark, sf_dir, near).filter(key % 11 != 0).withColumn("role", swapped)
    return boxes.withColumns({"x1": F.col("x1") + F.col("shift") * 0.5, "x2": F.col("x2") + F.col("shift") * 0.5})


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactions(gold_box(spark, sf_dir), ["image_id", "rxn_id"])


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reactions(pred_box(spark, sf_dir), ["image_id", "rxn_id"])


_IMAGE = "image AS (SELECT o_orderkey AS image_id, o_orderpriority AS diagram_type, o_orderkey % 5 AS split FROM orders)"
_GOLD = """numbered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS BIGINT) AS box_idx FROM lineitem),
gold_px AS (
  SELECT l_orderkey AS image_id, box_idx, box_idx // 3 AS rxn_id,
    CAST(CASE box_idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS role, 1 + (l_partkey + box_idx) % 4 AS category_id,
    l_quantity * 10e0 AS x, (l_suppkey % 50) * 10e0 AS y, CAST(20 + l_partkey % 300 AS DOUBLE) AS w, CAST(20 + l_partkey % 7 * 30 AS DOUBLE) AS h, l_tax AS shift FROM numbered),
gold_box AS (SELECT *, x / 1000e0 AS x1, y / 800e0 AS y1, (x + w) / 1000e0 AS x2, (y + h) / 800e0 AS y2 FROM gold_px)"""
_PRED = """pred_box AS (
  SELECT image_id, box_idx, rxn_id, CASE WHEN (image_id + rxn_id) % 7 = 0 AND role < 2 THEN 1 - role ELSE role END AS role, category_id,
    x1 + shift * 0.5e0 AS x1, y1, x2 + shift * 0.5e0 AS x2, y2, shift FROM gold_box WHERE (image_id + rxn_id) % 11 <> 0)"""


def iou_sql(a: str, b: str, digits: int = DIGITS) -> str:
    wide = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    high = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda t: f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"
    return f"round(CASE WHEN {wide} < 0 OR {high} < 0 THEN 0e0 ELSE coalesce({wide} * {high} / nullif({area(a)} + {area(b)} - {wide} * {high}, 0e0), 0e0) END, {digits})"


#: Boxes with their place in the reaction: by role, then box_idx.
def _placed(name: str, table: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY image_id, rxn_id ORDER BY role, box_idx) - 1 AS place FROM {table})"


def compare_sql(name: str, left: str, right: str, extra: str = "", mol_only: bool = False, merge: bool = False, kept: bool = False) -> str:
    """CTEs that give ``name`` (image_id, l, r): pairs of reactions that are equal, left against right.

    With ``kept`` only boxes with that flag are looked at; any may be matched.
    """

    def considered(side: str) -> str:
        if not mol_only:
            return f"SELECT image_id, rxn_id, role, place FROM {side}{' WHERE kept' if kept else ''}"
        return f"SELECT image_id, rxn_id, role, place FROM (SELECT *, max(CAST(category_id = 1 AS INT)) OVER (PARTITION BY image_id, rxn_id, role) AS any_mol FROM {side}) WHERE category_id = 1 OR (role <> {ROLES.index('conditions')} AND any_mol = 0)"

    role = "CASE WHEN role = 1 THEN 0 ELSE role END" if merge else "role"
    lists = ", ".join(f"coalesce(list_sort(list(place) FILTER (WHERE role = {r})), []) AS p{r}" for r in range(3))
    return f"""{name}_l AS (SELECT image_id, rxn_id, {role} AS role, place FROM ({considered(left)})),
{name}_r AS (SELECT image_id, rxn_id, {role} AS role, place FROM ({considered(right)})),
{name}_ln AS (SELECT image_id, rxn_id, count(*) AS n FROM {name}_l GROUP BY ALL),
{name}_rn AS (SELECT image_id, rxn_id, count(*) AS n, {lists} FROM {name}_r GROUP BY ALL),
{name}_pairs AS (SELECT l.image_id, l.rxn_id AS l, r.rxn_id AS r FROM {name}_ln l JOIN {name}_rn r ON l.image_id = r.image_id AND l.n = r.n {extra}),
{name}_scored AS (SELECT p.image_id, p.l, p.r, a.place AS lp, b.place AS rp, {iou_sql('a', 'b')} AS iou FROM {name}_pairs p
  JOIN {left} a ON a.image_id = p.image_id AND a.rxn_id = p.l JOIN {right} b ON b.image_id = p.image_id AND b.rxn_id = p.r),
{name}_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, l, r, lp ORDER BY iou DESC, rp) AS k FROM {name}_scored) WHERE k = 1),
{name}_found AS (SELECT s.image_id, s.l, s.r, {', '.join(f'coalesce(list_sort(list(CASE WHEN iou >= 0.5e0 THEN rp ELSE -1 END) FILTER (WHERE c.role = {r})), []) AS p{r}' for r in range(3))}
  FROM {name}_best s JOIN {name}_l c ON c.image_id = s.image_id AND c.rxn_id = s.l AND c.place = s.lp GROUP BY ALL),
{name} AS (SELECT f.image_id, f.l, f.r FROM {name}_found f JOIN {name}_rn n ON n.image_id = f.image_id AND n.rxn_id = f.r AND n.p0 = f.p0 AND n.p1 = f.p1 AND n.p2 = f.p2)"""


VIEWS = f"WITH {_IMAGE},\n{_GOLD},\n{_PRED},\n{_placed('g', 'gold_box')},\n{_placed('p', 'pred_box')}"
EXACT = compare_sql("exact", "g", "p")
SOFT = compare_sql("soft", "g", "p", mol_only=True, merge=True)


def counts_sql(mode: str) -> str:
    """CTE counts: hits and totals of each image."""
    return f"""counts AS (SELECT i.*, coalesce(gh.n, 0) AS gold_hits, coalesce(gt.n, 0) AS gold_total, coalesce(ph.n, 0) AS pred_hits, coalesce(pt.n, 0) AS pred_total FROM image i
  LEFT JOIN (SELECT image_id, count(DISTINCT l) AS n FROM {mode} GROUP BY 1) gh USING (image_id)
  LEFT JOIN (SELECT image_id, count(DISTINCT rxn_id) AS n FROM g GROUP BY 1) gt USING (image_id)
  LEFT JOIN (SELECT image_id, count(DISTINCT r) AS n FROM {mode} GROUP BY 1) ph USING (image_id)
  LEFT JOIN (SELECT image_id, count(DISTINCT rxn_id) AS n FROM p GROUP BY 1) pt USING (image_id))"""


SUMS = "CAST(coalesce(sum(gold_hits), 0) AS BIGINT) AS gold_hits, CAST(coalesce(sum(gold_total), 0) AS BIGINT) AS gold_total, CAST(coalesce(sum(pred_hits), 0) AS BIGINT) AS pred_hits, CAST(coalesce(sum(pred_total), 0) AS BIGINT) AS pred_total, count(*) AS images"
SCORES = "gold_hits, gold_total, pred_hits, pred_total, images, precision, recall, 2e0 * precision * recall / greatest(precision + recall, 1e-6) AS f1"
RATES = "*, CAST(pred_hits AS DOUBLE) / greatest(pred_total, 1) AS precision, CAST(gold_hits AS DOUBLE) / greatest(gold_total, 1) AS recall"


def scores_sql(mode: str, by: str = "") -> str:
    """Scores of a mode, by the columns named."""
    compared = EXACT if mode == "exact" else SOFT
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"{VIEWS},\n{compared},\n{counts_sql(mode)}\nSELECT {key}{SCORES} FROM (SELECT {RATES} FROM (SELECT {key}{SUMS} FROM counts{group}))"
