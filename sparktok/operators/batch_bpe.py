"""Merging many pretokens at once, as arrays: in each round, every pretoken does its next merge."""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 62
_U = np.uint64


class PairTable:
    """(left, right) to rank << 32 | merged, by open addressing over arrays."""

    def __init__(self, merges: tuple[tuple[int, int, int], ...]):
        bits = max(4, (len(merges) * 3).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), _U(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        m = np.array(merges, np.int64).reshape(-1, 3)
        keys, values = (m[:, 0] << 32) | m[:, 1], (np.arange(len(m)) << 32) | m[:, 2]
        todo, slot = np.arange(len(m)), self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == -1)
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.values[slot[put]] = keys[todo[put]], values[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, NONE for one that doesn't merge."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], NONE)
        todo = np.flatnonzero((have != keys) & (have != -1))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            have = self.keys[slot]
            hit = have == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            rest = ~hit & (have != -1)
            todo, slot = todo[rest], slot[rest]
        return out


def merge_block(ids: np.ndarray, size: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The merged rows of a matrix of ids, each of some size, and their new sizes."""
    n, width = ids.shape
    ids, size = ids.copy(), size.copy()
    column = np.arange(width)
    inside = column[None, : width - 1] < size[:, None] - 1
    value = np.full((n, width), NONE, np.int64)
    r, c = np.nonzero(inside)
    value[r, c] = table.find(ids[r, c], ids[r, c + 1])
    live = np.arange(n)
    m, v, s = ids, value, size
    while len(live):
        at = v.argmin(1)
        best = v[np.arange(len(live)), at]
        go = np.flatnonzero(best < NONE)
        if len(go) < len(live):
            ids[live], size[live] = m, s
            live, m, v, s, at, best = live[go], m[go], v[go], s[go], at[go], best[go]
            if not len(live):
                break
        rows = np.arange(len(live))
        take = np.minimum(column[None] + (column[None] > at[:, None]), width - 1)
        m, v = np.take_along_axis(m, take, 1), np.take_along_axis(v, take, 1)
        s = s - 1
        m[rows, at] = best & 0xFFFFFFFF
        v[rows, s - 1] = NONE
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < s - 1)
        v[left, at[left] - 1] = table.find(m[left, at[left] - 1], m[left, at[left]])
        v[right, at[right]] = table.find(m[right, at[right]], m[right, at[right] + 1])
    return ids, size


def merge_many(data: np.ndarray, off: np.ndarray, byte_ids: np.ndarray, table: PairTable, rest) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of pretokens data[off[i]:off[i+1]]. rest: what merges one of more than 64 bytes."""
    size = np.diff(off)
    out_size = np.zeros(len(size), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for width in (4, 8, 12, 16, 24, 32, 64):
        own = np.flatnonzero((size > low) & (size <= width))
        low = width
        for i in range(0, len(own), 20_000):
            k = own[i : i + 20_000]
            at = np.minimum(off[k][:, None] + np.arange(width), len(data) - 1)
            ids, n = merge_block(byte_ids[data[at]], size[k], table)
            out_size[k] = n
            parts.append((k, ids, n))
    long = {int(k): rest(data[off[k] : off[k + 1]].tobytes()) for k in np.flatnonzero(size > low)}
    for k, ids in long.items():
        out_size[k] = len(ids)
    end = np.concatenate([[0], np.cumsum(out_size)])
    out = np.zeros(int(end[-1]), np.int32)
    for k, ids, n in parts:
        r, c = np.nonzero(np.arange(ids.shape[1])[None] < n[:, None])
        out[end[k][r] + c] = ids[r, c]
    for k, ids in long.items():
        out[end[k] : end[k + 1]] = ids
    return out, end
