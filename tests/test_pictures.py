import colorsys
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxframe.functions import geometry as G
from boxframe.functions import pixels as X
from boxframe.operators import pictures


def noise(seed, height, width):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


def file(colour, rows, width, height, palette=b"", depth=8):
    """A PNG of unfiltered rows."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data = b"".join(b"\0" + r for r in rows)
    return X.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(data[:3])[:0] + zlib.compress(data)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(1, 1), (5, 1), (1, 7), (11, 9), (40, 33)])
def test_png_round_trip_with_all_filters(shape):
    a = noise(1, *shape)
    assert np.array_equal(X.read_png(X.write_png(a)), a)


def test_other_colour_types():
    assert X.read_png(file(0, [b"\x05\x06", b"\x07\x08"], 2, 2))[1, 0].tolist() == [7, 7, 7]
    assert X.read_png(file(3, [b"\x01\x00"], 2, 1, palette=b"\x01\x02\x03\x04\x05\x06"))[0].tolist() == [[4, 5, 6], [1, 2, 3]]
    assert X.read_png(file(4, [b"\x09\x80"], 1, 1))[0, 0].tolist() == [9, 9, 9]
    assert X.read_png(file(6, [b"\x01\x02\x03\xff"], 1, 1))[0, 0].tolist() == [1, 2, 3]


def test_what_is_no_picture():
    good = X.write_png(noise(2, 6, 5))
    for data in (None, b"", b"GIF89a", good[:40], good[:60], X.SIGNATURE, file(0, [b"\0"], 1, 1, depth=16), file(5, [b"\0"], 1, 1)):
        assert X.read_png(data) is None


def where(mask):
    """The box around marked pixels."""
    y, x = np.nonzero(mask)
    return (x.min(), y.min(), x.max() + 1, y.max() + 1) if len(x) else None


def test_boxes_and_pixels_agree(spark):
    """A marked region moves as its box does."""
    rng = random.Random(3)
    rows, made = [], []
    for i in range(40):
        w, h = rng.randrange(8, 30), rng.randrange(8, 30)
        x1, y1 = rng.randrange(w - 3), rng.randrange(h - 3)
        x2, y2 = rng.randrange(x1 + 1, w), rng.randrange(y1 + 1, h)
        a = np.full((h, w, 3), 255, np.uint8)
        a[y1:y2, x1:x2] = (9, 8, 7)
        rows.append((i, w, h, float(x1), float(y1), float(x2), float(y2), rng.randrange(w // 2), rng.randrange(h // 2), 7, 6))
        made.append(a)
    df = spark.createDataFrame(rows, "i int, w int, h int, x1 double, y1 double, x2 double, y2 double, left int, top int, cw int, ch int")
    box, d = G.Box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), lambda c: F.col(c).cast("double")
    forms = {"flip": G.hflip(box, d("w")), "turn": G.rotate90(box, d("w")), "crop": G.crop(box, d("left"), d("top"), d("cw"), d("ch"))}
    for r in df.select("*", *(F.struct(*b.named()).alias(n) for n, b in forms.items())).collect():
        a = made[r.i]
        moved = {"flip": X.hflip(a), "turn": X.rotate90(a), "crop": X.crop(a, r.left, r.top, r.cw, r.ch)}
        for n, pixels in moved.items():
            b = r[n]
            found = where((pixels == (9, 8, 7)).all(axis=2))
            assert found == (tuple(b[c] for c in ("x1", "y1", "x2", "y2")) if b.x2 > b.x1 and b.y2 > b.y1 else None), n
        assert X.pad(a, 2, 3).shape == (r.h + 3, r.w + 2, 3) and where((X.pad(a, 2, 3) == (9, 8, 7)).all(axis=2)) == (r.x1, r.y1, r.x2, r.y2)


def test_resize_below_and_tensor():
    a = noise(4, 6, 4)
    assert np.array_equal(X.resize(a, 4, 6), a)
    assert X.resize(np.full((5, 7, 3), 99, np.uint8), 3, 11).tolist() == np.full((11, 3, 3), 99).tolist()
    two = X.below(a, a[:2, :3], gap=2)
    assert two.shape == (10, 4, 3) and (two[6:8] == 255).all() and (two[8:, 3] == 255).all() and np.array_equal(two[8:, :3], a[:2, :3])
    t = X.tensor(np.array([[[255, 0, 51]]], np.uint8), mean=(0.5, 0.5, 0.2), std=(0.5, 0.25, 1.0))
    assert np.allclose(t.ravel(), [1, -2, 0])


def test_colours_by_hand():
    a = np.array([[[200, 100, 50], [0, 255, 10]]], np.uint8)
    assert X.brightness(a, 1.5).tolist() == [[[255, 150, 75], [0, 255, 15]]]
    assert X.brightness(a, 0.0).max() == 0 and np.array_equal(X.saturation(a, 1.0), a)
    assert (X.contrast(a, 0.0) == int(X.grey(a).mean() + 0.5)).all()
    flat = X.saturation(a, 0.0)
    assert (flat == flat[:, :, :1]).all()


def test_hue_against_the_standard_library():
    a = noise(5, 12, 12)
    for turn in (-0.5, -0.2, 0.0, 0.13, 0.5):
        got = X.hue(a, turn).astype(int)
        for p, q in zip(a.reshape(-1, 3).tolist(), got.reshape(-1, 3).tolist(), strict=True):
            h, s, v = colorsys.rgb_to_hsv(*(x / 255 for x in p))
            want = [x * 255 for x in colorsys.hsv_to_rgb((h + turn) % 1, s, v)]
            assert max(abs(x - y) for x, y in zip(q, want, strict=True)) <= 0.5 + 1e-6


def test_drawn_regions_and_factors(spark):
    key = F.col("id")
    rows = spark.range(3000).select(pictures.erasing(F.lit(40), F.lit(30), 7, key).alias("e"), F.struct(*pictures.distorting([0.5, 0.4, 0.3, 0.2], 8, key)).alias("d")).collect()
    regions = [r.e for r in rows if r.e]
    assert 1350 < len(regions) < 1650
    assert all(0 <= e.left and e.left + e.width <= 40 and 0 <= e.top and e.top + e.height <= 30 and e.width * e.height <= 0.4 * 1200 for e in regions)
    factors = [r.d for r in rows if r.d.col1]
    assert 1350 < len(factors) < 1650 and all(0.5 <= f.col1[0] <= 1.5 and -0.2 <= f.col1[3] <= 0.2 for f in factors)
    orders = {tuple(f.col2) for f in factors}
    assert len(orders) == 24 and all(sorted(o) == [0, 1, 2, 3] for o in orders)


def test_picture_columns(spark):
    a = noise(6, 9, 8)
    df = spark.createDataFrame([("x", bytearray(X.write_png(a)), 3), ("y", bytearray(b"junk"), 3), ("z", None, 3)], "pixels string, content binary, n int")
    steps = [(X.hflip, []), (X.crop, [F.lit(1), F.lit(2), F.col("n"), F.lit(4)]), (X.distort, [F.array(F.lit(1.2), F.lit(0.9)), F.array(F.lit(1), F.lit(0))])]
    rows = {r.name: r for r in pictures.pictures(df.withColumnRenamed("pixels", "name"), *steps, keys=["name"], with_tensor=True).collect()}
    want = X.brightness(X.contrast(X.hflip(a)[2:6, 1:4], 0.9), 1.2)
    assert (rows["x"].width, rows["x"].height, bytes(rows["x"].pixels)) == (3, 4, want.tobytes()) and len(rows["x"].tensor) == 36
    assert rows["y"].pixels is rows["y"].width is rows["z"].pixels is rows["z"].tensor is None
    assert pictures.pictures(df.limit(0), keys=["n"]).count() == 0


def test_batches_of_files_read_as_one_by_one():
    rng = np.random.default_rng(9)
    made = [noise(i, 5 + i % 2, 7) for i in range(60)] + [noise(70, 40, 33)]
    files = X.write_pngs(np.stack(made[:60:2])) + [X.write_png(a) for a in made]
    assert all(np.array_equal(X.read_png(f), a) for f, a in zip(files, made[:60:2], strict=False))
    files += [file(0, [b"\x05\x06", b"\x07\x08"], 2, 2)] * 20 + [file(3, [b"\x01\x00"], 2, 1, palette=b"\x01\x02\x03\x04\x05\x06"), file(4, [b"\x09\x80"], 1, 1)] + [file(6, [b"\x01\x02\x03\xff"], 1, 1)] * 20
    files += [None, b"", b"GIF89a", files[0][:40], files[0][:60], X.SIGNATURE, file(0, [b"\0"], 1, 1, depth=16), file(5, [b"\0"], 1, 1)]
    # Rows of an unknown filter spoil their own picture only.
    body = zlib.compress(b"\x09\x01\x02\x03" * 2)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    files += [X.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body)] * 20
    files = [files[i] for i in rng.permutation(len(files))]
    for one, other in zip(X.read_pngs(files), map(X.read_png, files), strict=True):
        assert (one is None and other is None) or np.array_equal(one, other)
