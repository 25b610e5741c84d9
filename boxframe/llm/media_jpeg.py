"""Baseline JPEG media columns: lossless payloads, vectorised Huffman decoding, DC thumbnails."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = 64
#: Payload bytes decoded together.
TOGETHER = 1 << 20
#: Payload bytes of one picture (whole rows of blocks); a longer payload is a sequence of pictures.
FRAME = 1 << 20
#: Blocks in a row of the stored picture.
ACROSS = 1024
_MARK = b"PAYLOAD\0"


class BadJpeg(ValueError):
    """The bytes aren't a baseline JPEG, or are cut short."""


def pad(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def store(payload: bytes, across: int | None = None) -> bytes:
    """A baseline JPEG whose quantised coefficients are the payload.

    Every 64 bytes are the 64 coefficients of one block of a grey picture, in
    zigzag order, with all quantisers 1. A byte b stands for coefficient b
    (128 to 255) or b - 255 (0 to 127): the 256 values of JPEG's size class
    8, whose extra bits are b itself. One code of one bit serves all of them,
    so a block is 64 times nine bits. Each block is a restart interval, so
    blocks are read independently. The payload's length stands in an APP9
    segment; blocks that fill up the last row are zero bytes. More than
    ``FRAME`` bytes are stored by ``frames``.
    """
    if len(payload) % UNIT or not payload:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    n = len(payload) // UNIT
    across = across or min(n, ACROSS)
    down = -(-n // across)
    blocks = np.zeros(across * down * UNIT, np.uint8)
    blocks[: len(payload)] = np.frombuffer(payload, np.uint8)
    eights = blocks.reshape(-1, 8)
    nines = np.zeros((len(eights), 9), np.uint8)
    at = np.arange(8, dtype=np.uint8)
    nines[:, :8] = eights >> (at + 1)
    nines[:, 1:] |= (eights & ((2 << at) - 1).astype(np.uint8)) << (7 - at)
    scan = np.empty((across * down, 74), np.uint8)
    scan[:, :72] = nines.reshape(-1, 72)
    scan[:, 72] = 0xFF
    scan[:, 73] = 0xD0 + np.arange(across * down) % 8
    flat = scan.reshape(-1)[:-2]
    stuffed = np.flatnonzero(flat == 0xFF)
    flat = np.insert(flat, stuffed[stuffed % 74 != 72] + 1, 0)
    one_code = bytes([1, *[0] * 15, 8])
    head = (
        b"\xff\xd8"
        + _segment(0xE9, _MARK + struct.pack(">Q", len(payload)))
        + _segment(0xDB, b"\0" + b"\1" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\1\x11\0")
        + _segment(0xC4, b"\x00" + one_code + b"\x10" + one_code)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )
    return head + flat.tobytes() + b"\xff\xd9"


def frames(payload: bytes) -> Iterator[bytes]:
    """Pictures of ``FRAME`` bytes of the payload each, one after the other, as in motion JPEG."""
    for start in range(0, len(payload), FRAME):
        yield store(payload[start : start + FRAME], ACROSS)


@dataclass
class Scan:
    data: np.ndarray
    #: For each component of the scan: id, and tables for DC and AC as (counts, symbols).
    parts: list[tuple[int, bytes, bytes]]
    interval: int


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    #: id -> horizontal and vertical sampling, quantisers.
    parts: dict[int, tuple[int, int, bytes]] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    payload: int | None = None
    #: id -> coefficients, (rows of blocks, columns of blocks, 64) in zigzag order.
    coefficients: dict[int, np.ndarray] = field(default_factory=dict)


def parse(media: bytes) -> Picture:
    """The markers of a baseline JPEG; scans are found but not decoded."""
    whole = np.frombuffer(media, np.uint8)
    if media[:2] != b"\xff\xd8":
        raise BadJpeg("no start of image")
    picture, at, quantisers, tables, interval, sampled = Picture(), 2, {}, {}, 0, {}
    while True:
        while media[at : at + 2] == b"\xff\xff":
            at += 1
        if len(media) < at + 2 or media[at] != 0xFF:
            raise BadJpeg("no marker")
        marker = media[at + 1]
        if marker == 0xD9:
            break
        if len(media) < at + 4:
            raise BadJpeg("cut short")
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise BadJpeg("cut short")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                body = body[129 if wide else 65 :]
        elif marker == 0xC0:
            _, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
            if not picture.height or not picture.width:
                raise BadJpeg("empty picture")
            sampled = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise BadJpeg("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xE9 and body.startswith(_MARK):
            picture.payload = struct.unpack(">Q", body[len(_MARK) :])[0]
        elif marker == 0xDA:
            if not sampled:
                raise BadJpeg("scan before frame")
            rest = whole[at:]
            ff = np.flatnonzero(rest[:-1] == 0xFF)
            after = rest[ff + 1]
            ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
            if not len(ends):
                raise BadJpeg("scan without end")
            try:
                parts = [(body[1 + 2 * i], tables[body[2 + 2 * i] >> 4], tables[16 | body[2 + 2 * i] & 15]) for i in range(body[0])]
                picture.parts |= {c: (*sampled[c][:2], quantisers[sampled[c][2]]) for c, _, _ in parts}
            except KeyError as e:
                raise BadJpeg("missing table") from e
            picture.scans.append(Scan(rest[: ends[0]], parts, interval))
            at += int(ends[0])
    if not picture.scans:
        raise BadJpeg("no scan")
    picture.parts = {c: picture.parts.get(c) or (h, v, quantisers.get(q, (1,) * 64)) for c, (h, v, q) in sampled.items()}
    return picture


def _lookup(table: bytes) -> np.ndarray:
    """For all 16 bits that may come next: length of the code << 8 | symbol; 0 where there's no code."""
    found, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << (16 - length)
            found[first : first + (1 << (16 - length))] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return found


def _shape(picture: Picture, scan: Scan) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Units across and down in a scan, and the blocks of each: component, row, column."""
    across, down = (max(p[i] for p in picture.parts.values()) for i in (0, 1))
    if len(scan.parts) == 1:
        h, v, _ = picture.parts[scan.parts[0][0]]
        size = lambda n, s, most: -(--(-n * s // most) // 8)
        return size(picture.width, h, across), size(picture.height, v, down), [(0, 0, 0)]
    inside = [(i, y, x) for i, (c, _, _) in enumerate(scan.parts) for y in range(picture.parts[c][1]) for x in range(picture.parts[c][0])]
    return -(-picture.width // (8 * across)), -(-picture.height // (8 * down)), inside


def decode(pictures: list[Picture]) -> None:
    """Huffman-decode all scans of all pictures at once, into their coefficients.

    Every restart interval (a whole scan, where there are none) is a lane; one
    numpy step decodes the next code of all lanes. Lanes know where they are
    in their block, so pictures of any layout go together.
    """
    jobs = [(p, s, *_shape(p, s)) for p in pictures for s in p.scans]
    tables: dict[bytes, int] = {}
    starts, counts, kinds, patterns, parts, base = [], [], [], [], [], 0
    layouts = []
    for picture, scan, across, down, inside in jobs:
        d = scan.data
        ff = np.flatnonzero(d == 0xFF)
        after = d[np.minimum(ff + 1, len(d) - 1)]
        stuffed = ff[after == 0] + 1
        restarts = ff[(after >= 0xD0) & (after <= 0xD7)] + 2
        units = across * down
        each = scan.interval or units
        lanes = -(-units // each)
        if len(restarts) != lanes - 1:
            raise BadJpeg("restart markers missing")
        first = np.concatenate([[0], restarts])
        starts.append(base + first - np.searchsorted(stuffed, first))
        clean = np.delete(d, stuffed)
        parts.append(clean)
        base += len(clean)
        n = np.full(lanes, each, np.int64)
        n[-1] = units - each * (lanes - 1)
        counts.append(n * len(inside))
        kinds.append(np.full(lanes, len(patterns)))
        patterns.append([(tables.setdefault(scan.parts[i][1], len(tables)), tables.setdefault(scan.parts[i][2], len(tables)), i) for i, _, _ in inside])
        layouts.append(units * len(inside))
    look = np.stack([_lookup(t) for t in tables])
    longest = max(map(len, patterns))
    pattern = np.zeros((len(patterns), longest, 3), np.int64)
    for i, p in enumerate(patterns):
        pattern[i, : len(p)] = p
    period = np.array([len(p) for p in patterns])
    data = np.concatenate([*parts, np.zeros(16, np.uint8)])
    window = np.zeros(len(data) - 8, np.uint64)
    for i in range(8):
        window |= data[i : i + len(window)].astype(np.uint64) << np.uint64(56 - 8 * i)
    position, left, kind = np.concatenate(starts) * 8, np.concatenate(counts), np.concatenate(kinds)
    row = np.concatenate([[0], np.cumsum(left)[:-1]])
    out = np.zeros((int(left.sum()), 64), np.int32)
    flat, final = out.reshape(-1), len(window) - 1
    k, inside_at = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    before = np.zeros((len(row), int(pattern[:, :, 2].max()) + 1), np.int64)
    simple = len(patterns) == 1 or (longest == 1 and (pattern == pattern[:1]).all())
    while len(row):
        dc = k == 0
        if simple and longest == 1:
            table, part = np.where(dc, pattern[0, 0, 0], pattern[0, 0, 1]), 0
        else:
            now = pattern[kind, inside_at]
            table, part = np.where(dc, now[:, 0], now[:, 1]), now[:, 2]
        w = window[np.minimum(position >> 3, final)] << (position & 7).astype(np.uint64)
        entry = look[table, w >> np.uint64(48)]
        length = (entry >> 8).astype(np.int64)
        if not length.all():
            raise BadJpeg("no such code")
        symbol = (entry & 0xFF).astype(np.int64)
        size = symbol & 15
        extra = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        position += length + size
        if dc.any():
            lanes = np.flatnonzero(dc)
            own = part if isinstance(part, int) else part[lanes]
            before[lanes, own] += value[lanes]
            value[lanes] = before[lanes, own]
            k = np.where(dc, 0, k + (symbol >> 4))
        else:
            k += symbol >> 4
        written = dc | (size > 0)
        ended = ~dc & (symbol == 0)
        if (k[written] > 63).any():
            raise BadJpeg("too many coefficients")
        if written.all():
            flat[row * 64 + k] = value
        else:
            flat[(row * 64 + k)[written]] = value[written]
        k += 1
        over = ended | (k > 63)
        if over.any():
            k[over] = 0
            row += over
            left = left - over
            if longest > 1:
                inside_at = np.where(over, (inside_at + 1) % period[kind], inside_at)
            if not left.all():
                on = left > 0
                position, left, kind, row, k, inside_at, before = (a[on] for a in (position, left, kind, row, k, inside_at, before))
    end = 0
    for (picture, scan, across, down, inside), n in zip(jobs, layouts, strict=True):
        blocks = out[end : end + n].reshape(down, across, len(inside), 64)
        end += n
        for i, (c, _, _) in enumerate(scan.parts):
            own = [j for j, x in enumerate(inside) if x[0] == i]
            h, v = (1, 1) if len(scan.parts) == 1 else picture.parts[c][:2]
            grid = blocks[:, :, own].reshape(down, across, v, h, 64).transpose(0, 2, 1, 3, 4)
            picture.coefficients[c] = grid.reshape(down * v, across * h, 64)


def thumbnail(picture: Picture) -> np.ndarray:
    """Luminance at an eighth of the size, from the DC coefficients alone."""
    c = min(picture.coefficients)
    dc = picture.coefficients[c][:, :, 0] * picture.parts[c][2][0] / 8 + 128
    return np.clip(np.rint(dc), 0, 255).astype(np.uint8)


def _cells(grid: np.ndarray, down: int, across: int) -> np.ndarray:
    """Means of all pixels of each cell; where there are fewer pixels than cells, cells share them."""
    rows, columns = (np.arange(n) * size // n for n, size in ((down, grid.shape[0]), (across, grid.shape[1])))
    sums = np.add.reduceat(np.add.reduceat(grid, rows, axis=0, dtype=np.int64), columns, axis=1)
    high, wide = (np.maximum(np.diff(starts, append=size), 1) for starts, size in zip((rows, columns), grid.shape, strict=True))
    return sums / (high[:, None] * wide)


def hashes(thumb: np.ndarray) -> tuple[str, str]:
    """Average hash (which of 8 by 8 cells are over their mean) and difference hash (which are over the cell to the left)."""
    mean, step = _cells(thumb, 8, 8), _cells(thumb, 8, 9)
    return np.packbits(mean > mean.mean()).tobytes().hex(), np.packbits(step[:, 1:] > step[:, :-1]).tobytes().hex()


def payload(picture: Picture) -> bytes:
    """The bytes that ``store`` put into a picture."""
    values = picture.coefficients[min(picture.coefficients)].reshape(-1)
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()[: picture.payload]


FEATURES = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("average_hash", T.StringType()),
        T.StructField("difference_hash", T.StringType()),
    ]
)


def _read(texts: list[bytes], media: list[bytes]) -> Iterator[tuple]:
    """Features of texts of one picture each, decoded together."""
    pictures = [parse(m) for m in media]
    decode(pictures)
    for text, stored, picture in zip(texts, media, pictures, strict=True):
        read = payload(picture)
        yield (len(text), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), picture.width, picture.height, *hashes(thumbnail(picture)))


def _read_long(text: bytes, with_media: bool) -> tuple[bytes, tuple]:
    """The stored form (if asked for) and features of a text of several pictures, stored and decoded one by one.

    What is held at once is the text, the stored form if it's asked for, and a
    thumbnail of a 64th of the text, whatever decoding one picture takes.
    """
    whole, kept, thumbs, height = pad(text), [], [], 0
    read, stored = hashlib.sha256(), hashlib.sha256()
    sizes, tail = [0, 0], b""
    for media in frames(whole):
        picture = parse(media)
        decode([picture])
        part = payload(picture)
        read.update(part)
        stored.update(media)
        sizes, tail = [sizes[0] + len(part), sizes[1] + len(media)], part[-64:]
        thumbs.append(thumbnail(picture))
        height += picture.height
        if with_media:
            kept.append(media)
    return b"".join(kept), (len(text), sizes[0], read.hexdigest(), zlib.crc32(tail), sizes[1], stored.hexdigest(), ACROSS * 8, height, *hashes(np.concatenate(thumbs)))


def media_columns(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, with_media: bool = True) -> DataFrame:
    """The ``keep`` columns of ``df`` (all, if None) with the stored JPEG ``media`` and what is read back from it.

    Each whole text's UTF-8 bytes, padded with bytes 0 to a positive multiple
    of 64, are stored by ``store``. The stored bytes are then parsed and
    decoded again (a payload over ``FRAME`` bytes picture by picture); n_bytes (unpadded), payload_bytes, payload_sha256,
    tail_crc32 (the last 64 bytes), width, height and the hashes of the DC-only
    thumbnail come from what was read. media_bytes and media_sha256 are of the
    stored form. ``with_media`` leaves out the bytes themselves.

    Defined cases: null text is empty (one block of zero bytes); rows are
    treated by themselves, short ones in runs of about a megabyte, long ones a
    megabyte at a time, and equal texts give equal values; an empty table gives an empty result; columns of ``df`` with
    the names added are replaced.
    """
    added = ([T.StructField("media", T.BinaryType())] if with_media else []) + FEATURES.fields
    names = {f.name for f in added}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start, size, part = 0, 0, []
            for i in range(batch.num_rows):
                text = (texts[i].as_py() or "").encode()
                if len(text) > FRAME:
                    if part:
                        yield put(batch, start, part)
                    yield put(batch, i, [text])
                    start, size, part = i + 1, 0, []
                    continue
                part.append(text)
                size += len(text)
                if size >= TOGETHER:
                    yield put(batch, start, part)
                    start, size, part = i + 1, 0, []
            if part:
                yield put(batch, start, part)

    def put(batch: pa.RecordBatch, start: int, part: list[bytes]) -> pa.RecordBatch:
        """The rows of ``part``, whose first is row ``start``, with what's added."""
        if len(part[0]) > FRAME:
            stored, found = _read_long(part[0], with_media)
            media, rows = [stored], [found]
        else:
            media = [store(pad(t)) for t in part]
            rows = _read(part, media)
        columns = [batch.column(j).slice(start, len(part)) for j in range(batch.num_columns - 1)]
        columns += [pa.array(media, pa.binary())] if with_media else []
        columns += [pa.array(x) for x in zip(*rows, strict=True)]
        types = [c.type for c in columns[: len(columns) - 4]] + [pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], [*(f"c_{j}" for j in range(len(kept))), *(f.name for f in added)])

    chosen = df.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)), F.col(text_col).alias("__text"))
    out = chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], *added]))
    return out.select(*(F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)), *(f.name for f in added))
