"""Byte-pair merges of one pretoken: repeatedly the adjacent pair of the lowest rank, of equals the leftmost."""

from __future__ import annotations

import heapq

Pairs = dict[tuple[int, int], tuple[int, int]]
#: Bytes up to which all pairs are looked at again for each merge; beyond it a heap keeps long runs from taking quadratic time.
SHORT = 64


def merge_short(ids: list[int], pairs: Pairs) -> list[int]:
    ids = list(ids)
    get = pairs.get
    while len(ids) > 1:
        best, at = None, -1
        for k in range(len(ids) - 1):
            found = get((ids[k], ids[k + 1]))
            if found is not None and (best is None or found[0] < best[0]):
                best, at = found, k
        if best is None:
            break
        ids[at : at + 2] = [best[1]]
    return ids


def merge_long(ids: list[int], pairs: Pairs) -> list[int]:
    n = len(ids)
    token = list(ids)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    heap = []
    for k in range(n - 1):
        found = pairs.get((token[k], token[k + 1]))
        if found is not None:
            heap.append((found[0], k, token[k], token[k + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, k, x, y, merged = heapq.heappop(heap)
        j = after[k]
        # an entry is stale when either side has been merged since
        if token[k] != x or j < 0 or token[j] != y:
            continue
        token[k], token[j] = merged, -1
        after[k] = after[j]
        if after[k] >= 0:
            before[after[k]] = k
            found = pairs.get((merged, token[after[k]]))
            if found is not None:
                heapq.heappush(heap, (found[0], k, merged, token[after[k]], found[1]))
        p = before[k]
        if p >= 0:
            found = pairs.get((token[p], merged))
            if found is not None:
                heapq.heappush(heap, (found[0], p, token[p], merged, found[1]))
    out, k = [], 0
    while k >= 0:
        out.append(token[k])
        k = after[k]
    return out


def encode_bytes(data: bytes, byte_id: list[int], pairs: Pairs) -> list[int]:
    """The ids of one pretoken's bytes."""
    ids = [byte_id[b] for b in data]
    if len(ids) < 2:
        return ids
    if len(ids) == 2:
        found = pairs.get((ids[0], ids[1]))
        return ids if found is None else [found[1]]
    return merge_short(ids, pairs) if len(ids) <= SHORT else merge_long(ids, pairs)
