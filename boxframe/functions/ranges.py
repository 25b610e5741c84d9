"""Ranges of places, many at once (numpy)."""

from __future__ import annotations

import numpy as np


def covered(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of ranges of ``n`` places from ``first``: the range's number, the place, and how far in it is."""
    which = np.repeat(np.arange(len(n)), n)
    far = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, first[which] + far, far


def pairs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later) of all pairs within groups of ``n`` members, which are numbered on from group to group."""
    _, at, far = covered(np.cumsum(n) - n, n)
    which, later, _ = covered(at + 1, np.repeat(n, n) - far - 1)
    return at[which], later
