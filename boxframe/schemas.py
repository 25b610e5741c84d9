"""Schemas of annotation, prediction and metrics files, and fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Categories of boxes and roles in a reaction, in their order.
CATEGORIES = {1: "Mol", 2: "Txt", 3: "Idt", 4: "Sup"}
ROLES = ("reactants", "conditions", "products")
REACTANT, CONDITION, PRODUCT = range(3)
MOL = 1

# Thresholds.
MATCH_IOU = 0.5
DUPLICATE_IOU = 0.6
EMPTY_SIDE = 0.01

GOLD_BOX = T.StructType([T.StructField("category_id", T.IntegerType()), T.StructField("bbox", T.ArrayType(T.DoubleType()))])
GOLD_REACTION = T.StructType([T.StructField(r, T.ArrayType(T.IntegerType())) for r in ROLES])
GOLD_IMAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("diagram_type", T.StringType()),
        T.StructField("bboxes", T.ArrayType(GOLD_BOX)),
        T.StructField("reactions", T.ArrayType(GOLD_REACTION)),
    ]
)
SPLIT_FILE = T.StructType([T.StructField("images", T.ArrayType(GOLD_IMAGE))])
PRED_BOX = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("smiles", T.StringType()),
        T.StructField("molfile", T.StringType()),
        T.StructField("text", T.ArrayType(T.StringType())),
    ]
)
PRED_REACTION = T.StructType([T.StructField(r, T.ArrayType(PRED_BOX)) for r in ROLES])
PREDICTION_FILE = T.StructType([T.StructField("reaction", T.ArrayType(T.ArrayType(PRED_REACTION))), T.StructField("file_name", T.ArrayType(T.StringType()))])
#: A box of a reaction as all operators take it: corners normalised to the image.
BOX = "struct<role:bigint,idx:bigint,category_id:bigint,x1:double,y1:double,x2:double,y2:double>"
