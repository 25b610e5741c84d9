"""Pixels of one picture as a numpy array (height, width, 3) of bytes: PNG files, and what transforms do to them.

Each function is the pixel half of a box transform in ``geometry`` and
``augment``, with the same parameters.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG colour type, and the weights of grey (65536ths of red, green, blue).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
GREY = (19595, 38470, 7471)


def chunks(data: bytes):
    """(kind, body) of a PNG's chunks; ends where the file does, even if it's cut short."""
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from what was stored: differences from the left, the row above, their mean or the nearest of three."""
    if kind == 0:
        return row
    if kind == 1:
        return np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ValueError(f"unknown filter {kind}")
    out, up = row.tolist(), above.tolist()
    for i in range(len(out)):
        a, b = out[i - step] if i >= step else 0, up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = up[i - step] if i >= step else 0
            near_a, near_b, near_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if near_a <= near_b and near_a <= near_c else b if near_b <= near_c else c
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def _unpacked(data: bytes | None) -> tuple[int, int, int, np.ndarray | None, np.ndarray] | None:
    """(height, width, samples, palette, stored rows) of a PNG that ``read_png`` reads; None for anything else or broken."""
    if not data or data[:8] != SIGNATURE:
        return None
    try:
        parts, palette, head = [], None, None
        for kind, body in chunks(data):
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                parts.append(body)
        width, height, depth, colour, _, _, interlaced = head
        if depth != 8 or interlaced or not width or not height:
            return None
        n = CHANNELS[colour]
        flat = zlib.decompress(b"".join(parts))
        rows = np.frombuffer(flat, np.uint8)[: height * (1 + width * n)].reshape(height, 1 + width * n)
        if colour == 3 and palette is None:
            return None
        return height, width, n, palette if colour == 3 else None, rows
    except (zlib.error, struct.error, ValueError, KeyError, TypeError):
        return None


def _colours(out: np.ndarray, palette: np.ndarray | None) -> np.ndarray | None:
    """Red, green and blue of samples (…, n); None if the palette lacks one."""
    if palette is not None:
        return palette[out[..., 0]] if out.max() < len(palette) else None
    return np.repeat(out[..., :1], 3, axis=-1) if out.shape[-1] < 3 else out[..., :3]


def read_png(data: bytes | None) -> np.ndarray | None:
    """Red, green and blue of a PNG of 8 bits a sample without interlacing; alpha is left out. None for anything else or broken."""
    found = _unpacked(data)
    if found is None:
        return None
    height, width, n, palette, rows = found
    if rows[:, 0].max() > 4:
        return None
    out, above = np.empty((height, width * n), np.uint8), np.zeros(width * n, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, n)
    return _colours(out.reshape(height, width, n), palette)


#: Pictures of one size from which reading them side by side, pixel by pixel, is faster than one after the other.
TOGETHER = 16


def _unfiltered_together(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """``_unfiltered`` for the same row of several pictures: (pictures, width, samples)."""
    if kind == 0:
        return row
    if kind == 1:
        return np.add.accumulate(row, axis=1, dtype=np.uint8)
    if kind == 2:
        return row + above
    out, stored, up = np.empty(row.shape, np.uint8).swapaxes(0, 1), *(np.ascontiguousarray(x.swapaxes(0, 1)).astype(np.int16) for x in (row, above))
    a = c = np.zeros(up.shape[1:], np.int16)
    for i in range(len(up)):
        b = up[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            near_a, near_b, near_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
            guess = np.where((near_a <= near_b) & (near_a <= near_c), a, np.where(near_b <= near_c, b, c))
        a, c = (stored[i] + guess) & 255, b
        out[i] = a
    return out.swapaxes(0, 1)


def read_pngs(files: list[bytes | None]) -> list[np.ndarray | None]:
    """``read_png`` of each file; pictures of one size are read together."""
    found, alike, out = [_unpacked(f) for f in files], {}, [None] * len(files)
    for i, x in enumerate(found):
        if x is not None and x[4][:, 0].max() <= 4:
            alike.setdefault(x[:3] if x[3] is None else (i,), []).append(i)
    for key, places in alike.items():
        if len(places) < TOGETHER:
            for i in places:
                out[i] = read_png(files[i])
            continue
        height, width, n = key
        rows = np.stack([found[i][4] for i in places])
        whole, above = np.empty((len(places), height, width, n), np.uint8), np.zeros((len(places), width, n), np.uint8)
        for y in range(height):
            kinds, row = rows[:, y, 0], rows[:, y, 1:].reshape(-1, width, n)
            present = np.unique(kinds).tolist()
            for kind in present:
                these = slice(None) if len(present) == 1 else kinds == kind
                whole[these, y] = _unfiltered_together(kind, row[these], above[these])
            above = whole[:, y]
        for i, a in zip(places, _colours(whole, None), strict=True):
            out[i] = a
    return out


def write_png(pixels: np.ndarray) -> bytes:
    """A PNG file; rows take the five filters in turn."""
    return write_pngs(pixels[None])[0]


def write_pngs(pixels: np.ndarray) -> list[bytes]:
    """A PNG file of each of several pictures of one size: (pictures, height, width, 3)."""
    count, height, width, _ = pixels.shape
    own = np.ascontiguousarray(pixels).reshape(count, height, -1)
    rows = np.empty((count, height, 1 + width * 3), np.uint8)
    for kind in range(5):
        mine = own[:, kind::5]
        rows[:, kind::5, 0] = kind
        if not mine.shape[1]:
            continue
        left, up, corner = (np.zeros(mine.shape, np.int16) for _ in range(3))
        left[:, :, 3:] = mine[:, :, :-3]
        above = own[:, kind - 1 :: 5][:, : mine.shape[1]] if kind else own[:, 4::5][:, : mine.shape[1] - 1]
        up[:, 0 if kind else 1 :] = above
        corner[:, :, 3:] = up[:, :, :-3]
        if kind == 4:
            near = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        else:
            guess = (0, left, up, (left + up) // 2)[kind]
        rows[:, kind::5, 1:] = (mine - guess) & 255
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head, end = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), chunk(b"IEND", b"")
    return [head + chunk(b"IDAT", zlib.compress(r.tobytes(), 6)) + end for r in rows]


def crop(a: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
    """A region; what lies outside the picture is black."""
    inner = a[max(top, 0) : max(top + height, 0), max(left, 0) : max(left + width, 0)]
    out = np.zeros((height, width, 3), np.uint8)
    y, x = max(-top, 0), max(-left, 0)
    out[y : y + inner.shape[0], x : x + inner.shape[1]] = inner
    return out


def hflip(a: np.ndarray, wanted: bool = True) -> np.ndarray:
    return a[:, ::-1] if wanted else a


def rotate90(a: np.ndarray, wanted: bool = True) -> np.ndarray:
    """A quarter turn against the clock."""
    return np.rot90(a) if wanted else a


def pad(a: np.ndarray, right: int, below: int, fill: int = 0) -> np.ndarray:
    out = np.full((a.shape[0] + below, a.shape[1] + right, 3), fill, np.uint8)
    out[: a.shape[0], : a.shape[1]] = a
    return out


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres in place: each new pixel is the mean of the four nearest by distance."""
    places = []
    for new, old in ((height, a.shape[0]), (width, a.shape[1])):
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        places.append((low, np.minimum(low + 1, old - 1), at - low))
    (y0, y1, fy), (x0, x1, fx) = places
    fy, fx = fy[:, None, None], fx[None, :, None]
    mixed = (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy
    return np.rint(mixed).astype(np.uint8)


def below(a: np.ndarray, b: np.ndarray, gap: int = 0) -> np.ndarray:
    """Two pictures one above the other, each padded with white to the wider one."""
    width = max(a.shape[1], b.shape[1])
    rows = [pad(x, width - x.shape[1], 0, 255) for x in (a, b)]
    return np.concatenate([rows[0], np.full((gap, width, 3), 255, np.uint8), rows[1]])


def erase(a: np.ndarray, region: dict | None) -> np.ndarray:
    """A region (left, top, width, height) in black; no region, no change."""
    if region is None:
        return a
    out = a.copy()
    out[region["top"] : region["top"] + region["height"], region["left"] : region["left"] + region["width"]] = 0
    return out


def _blend(base, a: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(base + factor * (a - base), 0, 255).astype(np.uint8)


def grey(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) @ np.array(GREY) + 32768) >> 16


def brightness(a: np.ndarray, factor: float) -> np.ndarray:
    return _blend(0.0, a.astype(float), factor)


def contrast(a: np.ndarray, factor: float) -> np.ndarray:
    """Away from (or to) the mean grey, rounded."""
    return _blend(np.floor(grey(a).mean() + 0.5), a.astype(float), factor)


def saturation(a: np.ndarray, factor: float) -> np.ndarray:
    return _blend(grey(a)[:, :, None].astype(float), a.astype(float), factor)


def hue(a: np.ndarray, turn: float) -> np.ndarray:
    """Colours turned on their circle by a share of it; greys stay."""
    v = a.astype(float)
    high, low = v.max(axis=2), v.min(axis=2)
    spread = np.where(high > low, high - low, 1.0)
    r, g, b = np.moveaxis(v, 2, 0)
    at = np.select([high == r, high == g], [(g - b) / spread, (b - r) / spread + 2], (r - g) / spread + 4) / 6 + turn
    # A channel falls from its colour's place on the circle: flat for a sixth either side, then down over a sixth.
    away = np.abs(((at[:, :, None] - np.array([0, 1 / 3, 2 / 3]) + 0.5) % 1) - 0.5) * 6
    share = np.clip(2 - away, 0, 1)
    return np.rint(low[:, :, None] + share * (high - low)[:, :, None]).astype(np.uint8)


#: Fixed order of names, by which a drawn order of the four is given.
DISTORTIONS = (brightness, contrast, saturation, hue)


def distort(a: np.ndarray, factors: list[float] | None, order: list[int] | None = None) -> np.ndarray:
    """Brightness, contrast, saturation and hue changed by ``factors``, in the ``order`` given; None changes nothing."""
    for i in (range(len(factors)) if order is None else order) if factors is not None else ():
        a = DISTORTIONS[i](a, factors[i])
    return a


def tensor(a: np.ndarray, mean: tuple[float, ...] = (0.485, 0.456, 0.406), std: tuple[float, ...] = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Channels first, from 0 to 1, less their mean and by their deviation."""
    return np.moveaxis((a / np.float32(255) - np.float32(mean)) / np.float32(std), 2, 0).astype(np.float32)
