"""Removal of duplicate boxes and reactions, in order, by folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxframe.functions.geometry import Box, is_empty
from boxframe.operators.matching import equal, overlap, prepared
from boxframe.schemas import DUPLICATE_IOU, PRODUCT, REACTANT



def kept_boxes(boxes: Column, digits: int | None = None) -> Column:
    """Places of the boxes that stay in a reaction.

    Reactants are scanned first, then products, then conditions. A box goes
    if it's nearly empty or overlaps an earlier one that stays by more than
    0.6. Places refer to the whole array, which keeps its boxes.
    """
    numbered = F.transform(boxes, lambda b, i: F.struct(F.when(b["role"] == REACTANT, 0).when(b["role"] == PRODUCT, 1).otherwise(2).alias("turn"), i.cast("long").alias("i"), b.alias("b")))
    start = F.expr("cast(array() as array<struct<i:bigint,b:struct<role:bigint,idx:bigint,category_id:bigint,x1:double,y1:double,x2:double,y2:double>>>)")

    def step(stay: Column, x: Column) -> Column:
        near = F.exists(stay, lambda k: overlap(k["b"], x["b"], digits=digits) > DUPLICATE_IOU)
        return F.when(is_empty(Box.of(x["b"])) | near, stay).otherwise(F.concat(stay, F.array(F.struct(x["i"].alias("i"), x["b"].alias("b")))))

    return F.sort_array(F.transform(F.aggregate(F.sort_array(numbered), start, step), lambda k: k["i"]))


def all_earlier(boxes: Column, digits: int | None = None) -> Column:
    """Places of boxes that overlap no earlier one, whether that one stays or not, by more than 0.6."""
    own = F.transform(boxes, lambda b, i: F.when(F.exists(F.slice(boxes, F.lit(1), i), lambda a: overlap(a, b, digits=digits) > DUPLICATE_IOU), F.lit(None)).otherwise(i.cast("long")))
    return F.filter(own, lambda i: i.isNotNull())


def has_role(boxes: Column, role: int, kept: Column | None) -> Column:
    """Whether a reaction has a box in a role, of those that ``kept`` names if it's given."""
    if kept is None:
        return F.exists(boxes, lambda b: b["role"] == role)
    return F.exists(kept, lambda i: F.get(boxes, i.cast("int"))["role"] == role)


def kept_reactions(rxns: DataFrame, image: list[str], with_kept: bool = False, digits: int | None = None) -> DataFrame:
    """The rows of ``rxns`` (image, rxn_id, boxes, and kept if asked) that stay.

    In order of rxn_id a reaction goes if it has no reactant or no product, or
    if an earlier one that stays equals it (that one on the left). Pairs meet
    within their image only; the fold is over the image's array of reactions.
    """
    columns = ["rxn_id", "boxes", *(["kept"] if with_kept else [])]
    images = rxns.select(*image, F.struct(*columns).alias("r")).groupBy(*image).agg(F.sort_array(F.collect_list("r")).alias("all"))

    def ready(r: Column) -> Column:
        own = r["kept"] if with_kept else None
        whole = has_role(r["boxes"], REACTANT, own) & has_role(r["boxes"], PRODUCT, own)
        return F.struct(*(r[c].alias(c) for c in columns), whole.alias("whole"), prepared(r["boxes"], kept=own).alias("q"))

    # What a comparison needs is worked out behind the shuffle: it's larger than the boxes.
    images = images.withColumn("all", F.transform("all", ready))

    def step(stay: Column, i: Column) -> Column:
        r = F.get("all", i)
        seen = F.exists(stay, lambda j: equal(F.get("all", j)["q"], r["q"], digits))
        return F.when(~r["whole"] | seen, stay).otherwise(F.concat(stay, F.array(i)))

    places = F.sequence(F.lit(0), F.size("all") - 1)
    stay = F.aggregate(places, F.expr("cast(array() as array<int>)"), step)
    return images.select(*image, F.explode(F.transform(stay, lambda i: F.get("all", i))).alias("r")).select(*image, *(f"r.{c}" for c in columns))


def postprocess(rxns: DataFrame, image: list[str], digits: int | None = None) -> DataFrame:
    """Duplicate reactions, then duplicate boxes, then duplicate reactions again are removed; kept names the boxes in roles."""
    once = kept_reactions(rxns, image, digits=digits)
    return kept_reactions(once.withColumn("kept", kept_boxes(F.col("boxes"), digits)), image, with_kept=True, digits=digits)


def in_roles(rxns: DataFrame) -> DataFrame:
    """Reactions with only the boxes that ``kept`` names: what a written file has."""
    return rxns.withColumn("boxes", F.filter("boxes", lambda b, i: F.array_contains("kept", i.cast("long")))).drop("kept")


