"""Picture columns: files decoded and transformed in Arrow batches, by steps whose parameters are columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxframe.functions import pixels as X
from boxframe.operators.augment import uniform, whole

#: Bytes of pixels that go back to Spark at once; a larger picture goes alone.
BATCH_BYTES = 8 << 20
#: A function of pixels (and parameters), and columns with its parameters.
Step = tuple[Callable[..., np.ndarray], Sequence[Column]]


def _in_batches(rows: Iterator[tuple[list, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _of_bytes(batch: pa.RecordBatch, files: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose pictures, by their headers, have about ``BATCH_BYTES`` of pixels; a larger picture goes alone."""
    first = size = 0
    for i, f in enumerate(files):
        head = f.as_buffer()[16:24].to_pybytes() if f.is_valid and len(f.as_buffer()) >= 24 else bytes(8)
        own = 3 * int.from_bytes(head[:4], "big") * int.from_bytes(head[4:], "big")
        if i > first and size + own > BATCH_BYTES:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += own
    if batch.num_rows > first:
        yield batch.slice(first)


def pictures(df: DataFrame, *steps: Step, keys: Sequence[str], content: str = "content", with_tensor: bool = False) -> DataFrame:
    """(keys, width, height, pixels) of PNG files after ``steps``; ``tensor`` too, if asked for.

    Pixels are red, green and blue bytes by rows. All steps of a picture run
    one after the other in one Python task, so pixels cross from Python to
    Spark once, and a task holds ``BATCH_BYTES`` of pictures, which are read
    together, or one, and what waits to go back.
    Parameters are computed by Spark. What can't be decoded has nulls.
    """
    columns = [F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)] + [F.col(content).alias("content")]
    columns += [F.struct(*(c.alias(f"p_{j}") for j, c in enumerate(own))).alias(f"s_{i}") if own else F.lit(None).cast("int").alias(f"s_{i}") for i, (_, own) in enumerate(steps)]
    chosen = df.select(*columns)
    functions = [f for f, _ in steps]
    fields = [T.StructField(n, T.IntegerType()) for n in ("width", "height")] + [T.StructField("pixels", T.BinaryType())]
    fields += [T.StructField("tensor", T.ArrayType(T.FloatType()))] * with_tensor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple[list, int]]:
            own, files, *values = (c.to_pylist() for c in (pa.StructArray.from_arrays(batch.columns[: len(keys)], names=batch.schema.names[: len(keys)]), *batch.columns[len(keys) :]))
            for i, a in enumerate(X.read_pngs(files)):
                for f, v in zip(functions, values, strict=True):
                    if a is not None:
                        a = f(a, *(v[i] or {}).values())
                made = [None] * 3 if a is None else [a.shape[1], a.shape[0], np.ascontiguousarray(a).tobytes()]
                made += [None if a is None else X.tensor(a).ravel()] * with_tensor
                yield [*own[i].values(), *made], 0 if a is None else a.size * (1 + 4 * with_tensor)

        for batch in batches:
            kinds = [batch.schema.field(j) for j in range(len(keys))] + [pa.field("width", pa.int32()), pa.field("height", pa.int32()), pa.field("pixels", pa.binary())]
            schema = pa.schema(kinds + [pa.field("tensor", pa.list_(pa.float32()))] * with_tensor)
            for part in _of_bytes(batch, batch.column(len(keys))):
                yield from _in_batches(rows(part), schema)

    out = chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[: len(keys)], *fields]))
    return out.select(*(F.col(f"k_{i}").alias(k) for i, k in enumerate(keys)), *(f.name for f in fields))


def painted(boxes: DataFrame, key: str, width: int, height: int, colours: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(key, content): a PNG for each key with its boxes (x0, y0, x1, y1 in pixels, colour, and place, by which later ones cover others) on white."""
    listed = boxes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "x0", "y0", "x1", "y1", "colour"))).alias("boxes"))

    # Place 0 is the white ground.
    palette, most = np.array([(255, 255, 255), *colours], np.uint8), max(BATCH_BYTES // (height * width * 3), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, most) for b in batches for i in range(0, b.num_rows, most)):
            a = np.zeros((batch.num_rows, height, width), np.int16)
            own, b = batch.column(1), batch.column(1).flatten()
            at = np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy()).tolist()
            for i, x0, y0, x1, y1, colour in zip(at, *(b.field(n).to_pylist() for n in ("x0", "y0", "x1", "y1", "colour")), strict=True):
                a[i, y0:y1, x0:x1] = colour + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(X.write_pngs(palette[a]), pa.binary())], schema=pa.schema([batch.schema.field(0), pa.field("content", pa.binary())]))

    return listed.mapInArrow(run, T.StructType([listed.schema[0], T.StructField("content", T.BinaryType())]))


def erasing(width: Column, height: Column, seed: int, *keys: Column, p: float = 0.5, share: tuple[float, float] = (0.02, 0.33), ratio: tuple[float, float] = (0.3, 3.3), tries: int = 10) -> Column:
    """Left, top, width and height of a region to erase, as a struct, drawn for the key; null with probability 1 - p, or if no try fits.

    A region has a share of the picture's area and a ratio of height to
    width, both drawn, the ratio by its logarithm.
    """

    def one(n: Column) -> Column:
        area = (F.lit(share[0]) + uniform(seed, *keys, n, F.lit("area")) * (share[1] - share[0])) * width * height
        form = F.exp(F.log(F.lit(ratio[0])) + uniform(seed, *keys, n, F.lit("ratio")) * (F.log(F.lit(ratio[1])) - F.log(F.lit(ratio[0]))))
        h, w = F.rint(F.sqrt(area * form)).cast("long"), F.rint(F.sqrt(area / form)).cast("long")
        at = [whole(seed, F.lit(0), side - own, *keys, n, F.lit(name)) for side, own, name in ((width, w, "x"), (height, h, "y"))]
        return F.when((w < width) & (h < height), F.struct(at[0].alias("left"), at[1].alias("top"), w.alias("width"), h.alias("height")))

    return F.when(uniform(seed, *keys) < p, F.get(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), one)), 0))


def distorting(strengths: Sequence[float], seed: int, *keys: Column, p: float = 0.5) -> list[Column]:
    """Factors of brightness, contrast and saturation (about 1), and a turn of the hue (about 0), drawn for the key, and the order in which they're applied; null with probability 1 - p."""
    drawn = [F.lit(0.0 if i == 3 else 1.0) + (2 * uniform(seed, *keys, F.lit(str(i))) - 1) * s for i, s in enumerate(strengths)]
    order = F.transform(F.sort_array(F.array(*(F.struct(uniform(seed, *keys, F.lit(f"order{i}")).alias("at"), F.lit(i).alias("i")) for i in range(len(strengths))))), lambda x: x["i"])
    wanted = uniform(seed, *keys) < p
    return [F.when(wanted, F.array(*drawn)), F.when(wanted, order)]
