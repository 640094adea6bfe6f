"""Where in a text windows of reference shingles can lie: a filter that loses nothing, before windows are fingerprinted.

A window in which the share of reference shingles is f or more, by number or by weights that are largest for shingles
outside the reference, splits into blocks of 4 to 7 shingles (or is shorter than 4), and some block has the share f
itself. So each such window is near a place where at least ceil(f * 4) of 7 shingles in a row are reference shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

BITS = 22


class Members:
    """A set of 64-bit hashes with a table of their low bits before the search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.table = np.zeros(1 << BITS, bool)
        self.table[(self.values & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of members, and their index among the values."""
        at = np.flatnonzero(self.table[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)])
        k = np.searchsorted(self.values, h[at])
        k[k == len(self.values)] = 0
        good = self.values[k] == h[at] if len(self.values) else np.zeros(0, bool)
        return at[good], k[good]


def regions(hits: np.ndarray, off: np.ndarray, share: float, least: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(text, from, to): ranges of shingles that hold every window of at most ``reach`` shingles with ``share`` of hits in it. least: shingles in the smallest window."""
    need = max(1, math.ceil(share * min(4, least) - 1e-9))
    if len(hits) < need:
        return
    near = hits[need - 1 :] - hits[: len(hits) - need + 1] < 7
    at = hits[: len(hits) - need + 1][near]
    if not len(at):
        return
    doc = np.searchsorted(off, at, "right") - 1
    lo, hi = np.maximum(at - reach, off[doc]), np.minimum(at + 7 + reach, off[doc + 1])
    first = np.ones(len(at), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1])
    s = np.flatnonzero(first)
    e = np.append(s[1:], len(at)) - 1
    for d, x, y in zip(doc[s].tolist(), lo[s].tolist(), hi[e].tolist(), strict=True):
        yield d, x, y
