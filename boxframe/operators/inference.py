"""Hooks for models: predictions of pictures, molecules and text by functions that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxframe.schemas import CATEGORIES, CONDITION, MOL, REACTANT

#: Pictures in a call of the model, cut-outs in a call of the molecule reader.
PICTURES, MOLECULES = 16, 32


def predict_tokens(images: DataFrame, load: Callable[[], Callable[[list[bytes]], list[list[int]]]], batch: int = PICTURES) -> DataFrame:
    """(path, tokens) for each picture: ``load`` makes the model once in each task, which takes up to ``batch`` pictures a call.

    Results go by the picture's own key, so a batch can't get another one's.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({"path": part.path, "tokens": model([bytes(c) for c in part.content])})

    return images.select("path", "content").mapInPandas(run, "path string, tokens array<bigint>")


def enrich(boxes: DataFrame, read_molecules: Callable | None = None, read_text: Callable | None = None, batch: int = MOLECULES) -> DataFrame:
    """``boxes`` (crop binary, category_id, …) with smiles, molfile and text.

    ``read_molecules`` takes up to ``batch`` cut-outs of molecules and gives
    (smiles, molfile) each; an empty molfile is null. ``read_text`` takes one
    cut-out of another kind and gives a list of words.
    """

    @F.pandas_udf("struct<smiles:string,molfile:string>")
    def molecules(crops: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in crops:
            found = [(None, None)] * len(series)
            some = [i for i, c in enumerate(series) if c is not None]
            for i in range(0, len(some), batch):
                for at, pair in zip(some[i : i + batch], read_molecules([bytes(series.iloc[j]) for j in some[i : i + batch]]), strict=True):
                    found[at] = pair[0], pair[1] or None
            yield pd.DataFrame(found, columns=["smiles", "molfile"])

    @F.pandas_udf("array<string>")
    def words(crops: pd.Series) -> pd.Series:
        return crops.map(lambda c: None if c is None else read_text(bytes(c)))

    mol = F.col("category_id") == MOL
    if read_molecules:
        boxes = boxes.withColumn("__m", molecules(F.when(mol, F.col("crop")))).withColumns({"smiles": F.col("__m.smiles"), "molfile": F.col("__m.molfile")}).drop("__m")
    if read_text:
        boxes = boxes.withColumn("text", words(F.when(~mol, F.col("crop"))))
    return boxes


def draw_specs(boxes: DataFrame) -> DataFrame:
    """``boxes`` with what a drawing needs: colour by role and label by category."""
    # Colours of roles.
    colour = F.when(F.col("role") == REACTANT, "r").when(F.col("role") == CONDITION, "g").otherwise("b")
    names = F.create_map(*(F.lit(x) for k, v in CATEGORIES.items() for x in (k, f"[{v}]")))
    return boxes.withColumns({"colour": colour, "label": names[F.col("category_id").cast("int")]})


def plain_key(key: str = "key"):
    """A parameter's name without the wrapper's prefix."""
    return F.regexp_replace(key, r"^model\.", "")
