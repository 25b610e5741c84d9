import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from boxframe.llm import media_jpeg as J


def plain_decode(media):
    """Coefficients in scan order, one bit at a time; one component."""
    picture = J.parse(media)
    scan = picture.scans[0]
    raw, out = bytes(scan.data), []
    segments, part = [], b""
    i = 0
    while i < len(raw):
        if raw[i] == 0xFF and raw[i + 1] == 0:
            part, i = part + b"\xff", i + 2
        elif raw[i] == 0xFF:
            segments.append(part)
            part, i = b"", i + 2
        else:
            part, i = part + raw[i : i + 1], i + 1
    segments.append(part)
    codes = []
    for table in scan.parts[0][1:]:
        code, at, found = 0, 16, {}
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                found[n, code] = table[at]
                code, at = code + 1, at + 1
            code <<= 1
        codes.append(found)
    blocks = (picture.width + 7) // 8 * ((picture.height + 7) // 8)
    for s in segments:
        bits = iter("".join(f"{b:08b}" for b in s))
        take = lambda n: int("".join(next(bits) for _ in range(n)) or "0", 2)

        def symbol(found):
            n = code = 0
            while (n, code) not in found:
                code, n = code << 1 | take(1), n + 1
            return found[n, code]

        def value(size):
            v = take(size)
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        before = 0
        for _ in range(min(scan.interval or blocks, blocks - len(out))):
            block, k = [0] * 64, 1
            before += value(symbol(codes[0]))
            block[0] = before
            while k < 64:
                x = symbol(codes[1])
                if x == 0:
                    break
                k += x >> 4
                if x & 15:
                    block[k] = value(x & 15)
                k += 1
            out.append(block)
    return out


def grey(blocks, across, down, interval=0):
    """A JPEG of given blocks (64 numbers each), with plain long codes."""
    symbols = sorted({*range(12)} | {r << 4 | s for r in range(16) for s in range(1, 11)} | {0xF0})
    table = bytes([0] * 8 + [len(symbols)] + [0] * 7) + bytes(symbols)  # all codes of nine bits
    code = {s: f"{i:09b}" for i, s in enumerate(symbols)}

    def bits_of(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    out, before, text = b"", 0, ""

    def flush(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")

    for i, b in enumerate(blocks):
        if interval and i and i % interval == 0:
            out += flush(text) + bytes([0xFF, 0xD0 + (i // interval - 1) % 8])
            text, before = "", 0
        n, extra = bits_of(b[0] - before)
        before = b[0]
        text += code[n] + extra
        run = 0
        for v in b[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                text, run = text + code[0xF0], run - 16
            n, extra = bits_of(v)
            text, run = text + code[run << 4 | n] + extra, 0
        if run:
            text += code[0]
    out += flush(text)
    head = b"\xff\xd8" + J._segment(0xFE, b"a comment") + J._segment(0xDB, b"\0" + bytes([3] * 64)) + J._segment(0xC0, struct.pack(">BHHB", 8, down * 8 - 3, across * 8 - 1, 1) + b"\1\x11\0")
    head += J._segment(0xC4, b"\x00" + table) + J._segment(0xC4, b"\x10" + table) + (J._segment(0xDD, struct.pack(">H", interval)) if interval else b"")
    return head + J._segment(0xDA, b"\1\1\0\0\x3f\0") + out + b"\xff\xd9"


@pytest.mark.parametrize("size", [0, 1, 64, 65, 1000, 70_000])
def test_round_trip(size):
    data = J.pad(bytes(random.Random(size).choice([0, 255, 128, 127, 65]) if size < 900 else random.Random(i).randrange(256) for i in range(size)))
    media = J.store(data)
    picture = J.parse(media)
    J.decode([picture])
    assert J.payload(picture) == data and len(data) % 64 == 0
    if size <= 1000:
        assert plain_decode(media) == picture.coefficients[1].reshape(-1, 64).tolist()


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_general_pictures(interval):
    rng = random.Random(interval)
    blocks = [[rng.randrange(-900, 900)] + [rng.choice([0] * rng.choice([1, 9, 60]) + [1, -1, 511, -300]) for _ in range(63)] for _ in range(12)]
    media = grey(blocks, 4, 3, interval)
    other = J.store(J.pad(b"other"))
    pictures = [J.parse(m) for m in (other, media, media)]
    J.decode(pictures)
    for p in pictures[1:]:
        assert p.coefficients[1].reshape(-1, 64).tolist() == blocks == plain_decode(media)
        assert J.thumbnail(p).tolist() == np.clip(np.rint(np.array(blocks)[:, 0].reshape(3, 4) * 3 / 8 + 128), 0, 255).tolist()
        assert (p.width, p.height) == (31, 21)


def test_broken_pictures():
    media = J.store(J.pad(b"some text"))
    for bad in (b"", b"\xff\xd8", media[:40], media[:-2], media.replace(b"\xff\xc0", b"\xff\xc2"), media[:120] + media[-2:]):
        with pytest.raises(J.BadJpeg):
            p = J.parse(bad)
            J.decode([p])


def test_query_and_hard_rows(spark, sf_dir):
    from boxframe.llm.queries import op9_jpeg_media

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_jpeg_media(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = J.pad(docs[r.doc_id])
        media = J.store(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(docs[r.doc_id]), len(data), hashlib.sha256(data).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest())
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "é" * 1_500_000, 7), (4, "x", 8), (4, "x", 8)], "doc_id int, text string, width long")
    got = J.media_columns(df).collect()
    assert [r.n_bytes for r in got] == [0, 0, 3_000_000, 1, 1] and got[3] == got[4] and got[0].media == got[1].media == J.store(bytes(64))
    assert got[2].payload_sha256 == hashlib.sha256(J.pad(("é" * 1_500_000).encode())).hexdigest()
    assert J.media_columns(df.limit(0)).count() == 0 and got[0].asDict()["width"] == 8


def test_hashes_see_every_pixel():
    """Pixels at the corners of all cells are equal; only the others differ."""
    a, b = np.full((32, 72), 100, np.uint8), np.full((32, 72), 100, np.uint8)
    a[1::2, :36] = 200
    b[1::2, 36:] = 200
    assert J.hashes(a)[0] == "f0" * 8 and J.hashes(b)[0] == "0f" * 8
    rng = np.random.default_rng(5)
    for shape in ((1, 1), (3, 5), (1, 700), (17, 1024), (50, 9)):
        grid = rng.integers(0, 256, shape).astype(np.uint8)
        for n in (8, 9):
            edge = lambda i, k, size: slice(i * size // k, max(i * size // k + 1, (i + 1) * size // k))
            plain = [[grid[edge(i, 8, shape[0]), edge(j, n, shape[1])].mean() for j in range(n)] for i in range(8)]
            assert np.allclose(J._cells(grid, 8, n), plain)
    docs = [b"a" * 64 * 16384, b"a" * 64 * 16384]
    docs[1] = b"".join((b"z" if i % 128 >= 64 and i // 1024 % 2 else b"a") * 64 for i in range(16384))
    pictures = [J.parse(J.store(d)) for d in docs]
    J.decode(pictures)
    assert len({J.hashes(J.thumbnail(p)) for p in pictures}) == 2


def test_long_texts_are_several_pictures(spark, monkeypatch):
    """Read back whole, with the features of one picture of all; what is held doesn't grow as decoding does."""
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300_000))
    whole = J.pad(text.encode())
    one = next(iter(J._read([text.encode()], [J.store(whole)])))
    monkeypatch.setattr(J, "FRAME", 1 << 16)
    media, found = J._read_long(text.encode(), True)
    assert found[:4] == one[:4] and found[6:] == one[6:] and found[4] == len(media) and found[5] == hashlib.sha256(media).hexdigest()
    parts = [J.parse(m) for m in J.frames(whole)]
    assert len(parts) == 5 and b"".join(J.frames(whole)) == media
    J.decode(parts)
    assert b"".join(map(J.payload, parts)) == whole
    tracemalloc.start()
    J._read_long(text.encode() * 40, False)
    assert tracemalloc.get_traced_memory()[1] < 4 * 40 * len(text)
    tracemalloc.stop()


def test_short_and_long_rows_together(spark):
    rows = [(1, "a"), (2, "b" * (3 << 20)), (3, None), (4, "b" * (3 << 20)), (5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in J.media_columns(df, keep=["doc_id"]).collect()}
    for i, text in rows:
        data = J.pad((text or "").encode())
        assert got[i].payload_sha256 == hashlib.sha256(data).hexdigest() and got[i].media_sha256 == hashlib.sha256(got[i].media).hexdigest() and got[i].media_bytes == len(got[i].media)
    assert got[2][1:] == got[4][1:]
