"""The draws of ``augment.uniform``, made for many keys at once (numpy)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

# The constants of MD5 (RFC 1321).
_TURNS = [[(np.uint32(n), np.uint32(32 - n)) for n in row] for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
_SINES = [np.uint32(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Bytes that a message of one block may have with the byte that ends it, and messages that are hashed side by side.
_ROOM, _TOGETHER = 56, 8192


def _digests(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 of messages of one block, given as 16 rows of 32-bit words."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    mixed, turned = np.empty_like(a), np.empty_like(a)
    said = [w if w.any() else None for w in words]
    for i in range(64):
        if i < 32:
            x, y, z, at = (b, c, d, i) if i < 16 else (d, b, c, (5 * i + 1) % 16)
            np.bitwise_xor(y, z, out=mixed)
            np.bitwise_and(mixed, x, out=mixed)
            np.bitwise_xor(mixed, z, out=mixed)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
        else:
            at = 7 * i % 16
            np.invert(d, out=mixed)
            np.bitwise_or(mixed, b, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
        np.add(a, mixed, out=a)
        np.add(a, _SINES[i], out=a)
        if said[at] is not None:
            np.add(a, said[at], out=a)
        left, right = _TURNS[i // 16][i % 4]
        np.right_shift(a, right, out=turned)
        np.left_shift(a, left, out=a)
        np.bitwise_or(a, turned, out=a)
        np.add(a, b, out=a)
        a, d, c, b = d, c, b, a
    return a + _START[0], b + _START[1]


class Draws:
    """Numbers in [0, 1) for keys of which one of ``heads`` is the beginning and one of ``tails`` the rest, both as ``augment.uniform`` writes them."""

    def __init__(self, heads: Sequence[str], tails: Sequence[str]):
        self.heads, self.head_sizes = _table([h.encode() for h in heads])
        self.tails, sizes = _table([t.encode() + b"\x80" for t in tails])
        self.tail_sizes = sizes - 1

    def __call__(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """A draw for each pair of numbers of a head and a tail."""
        sizes, out = self.head_sizes[head], np.empty(len(head))
        for size in np.unique(sizes):
            same = np.flatnonzero(sizes == size)
            for first in range(0, len(same), _TOGETHER):
                at = same[first : first + _TOGETHER]
                out[at] = self._of(head[at], tail[at], int(size))
        return out

    def _of(self, head: np.ndarray, tail: np.ndarray, size: int) -> np.ndarray:
        most = size + int(self.tail_sizes[tail].max()) + 1
        if most > _ROOM:
            raise ValueError("the key of a draw is longer than a block")
        block = np.zeros((len(head), 64), np.uint8)
        block[:, :size] = self.heads[head, :size]
        block[:, size:most] = self.tails[tail, : most - size]
        words = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32, copy=False)
        words[14] = (size + self.tail_sizes[tail]) * 8
        a, b = (x.byteswap().astype(np.uint64) for x in _digests(words))
        return (a << np.uint64(20) | b >> np.uint64(12)) / float(1 << 52)


def _table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of bytes of one width, filled up with 0, and their sizes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    wide = max(1, int(sizes.max(initial=0)))
    return np.frombuffer(b"".join(t.ljust(wide, b"\0") for t in texts), np.uint8).reshape(len(texts), wide), sizes


def whole(draw: np.ndarray, low: np.ndarray | int, high: np.ndarray | int) -> np.ndarray:
    """Whole numbers from low to high, both included, as ``augment.whole``."""
    return low + np.floor(draw * (high - low + 1)).astype(np.int64)
