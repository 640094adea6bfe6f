"""Array kernels shared by the corpus operators: words and shingles of a block of texts as numpy arrays.

A word is a maximal run of letters, digits and underscores (ASCII) or of characters from U+00C0 on, outside the
general punctuation (U+2000-207F) and CJK punctuation (U+3000-303F) blocks; each character of U+3040-9FFF is a word
of its own, since those scripts don't write spaces. ``WORD_RE`` is the same rule as a regular expression, for tests
and SQL. Texts are lowered by Spark before they come here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD_RE = r"[぀-鿿]|[a-z0-9_À-῿₀-⿿ꀀ-\U0010ffff]+"
#: The same for RE2, as DuckDB has it.
WORD_RE2 = (
    r"[\x{3040}-\x{9fff}]|[a-z0-9_\x{00c0}-\x{1fff}\x{2080}-\x{2fff}\x{a000}-\x{10ffff}]+"
)
#: Bytes of text that are worked on at once; a longer text is split at a byte that is in no word.
BLOCK = 1 << 18

_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)
_MI = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = np.zeros(256, bool)
for _r in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), (0x5F,), range(0x80, 0x100)):
    _WORD[list(_r)] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M)
_POW: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW
    if len(_POW[0]) < n:
        k = 1 << (n - 1).bit_length()
        out = []
        for m in (_M, _MI):
            p = np.full(k, m, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POW = (out[0], out[1])
    return _POW


@dataclass
class Words:
    """Words of some texts. hash: of each word; start, end: its bytes in ``data``; off: the words of text i are off[i]:off[i+1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    data: np.ndarray


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    big = col.type in (pa.large_string(), pa.large_binary())
    _, o, d = col.buffers()
    kind = np.int64 if big else np.int32
    if o is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(o, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    data = data[off[0] : off[-1]]
    return data, off - off[0]


def rows(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, of one text at least."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _piece(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words in data; none goes across a cut."""
    n = len(data)
    w = _WORD[data]
    force = np.zeros(n + 1, bool)
    force[cuts] = True
    if n and data.max() >= 0xC2:
        i = np.flatnonzero(data == 0xC2)
        w[i] = False
        w[np.minimum(i + 1, n - 1)] = False
        i = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] & 0xFE) == 0x80)) if n > 2 else []
        j = np.flatnonzero((data[:-2] == 0xE3) & (data[1:-1] == 0x80)) if n > 2 else []
        for k in (i, j):
            if len(k):
                w[k] = w[k + 1] = w[k + 2] = False
        i = np.flatnonzero((data >= 0xE3) & (data <= 0xE9) & w)
        if len(i):
            force[i] = True
            force[np.minimum(i + 3, n)] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = w[:-1]
    start = np.flatnonzero(w & (~before | force[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = w[1:] & ~force[1:-1]
    end = np.flatnonzero(w & ~after) + 1
    pow_, inv = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * pow_[:n], out=total[1:])
    h = (total[end] - total[start]) * inv[start]
    return start, end, mix(h)


def words(data: np.ndarray, off: np.ndarray) -> Words:
    """The words of the texts data[off[i]:off[i+1]]."""
    n = len(data)
    if n <= 2 * BLOCK:
        s, e, h = _piece(data, off[off < n]) if n else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    else:
        parts, i = [], 0
        while i < n:
            j, step = min(n, i + BLOCK), BLOCK
            while j < n:
                gap = np.flatnonzero(~_WORD[data[j - step : j]])
                if len(gap):
                    j = j - step + int(gap[-1]) + 1
                    break
                j, step = min(n, j + BLOCK), BLOCK
            cuts = off[(off >= i) & (off < j)] - i
            s, e, h = _piece(data[i:j], cuts)
            parts.append((s + i, e + i, h))
            i = j
        s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(h, s, e, np.searchsorted(s, off), data)


_COEF = mix(np.arange(101, 133, dtype=np.uint64) * _M) | _U(1)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, in order, and their offsets. A text of fewer than n words has one, of all its words; one without words none."""
    count = np.diff(w.off)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(have)])
    h = np.concatenate([w.hash, np.zeros(n, np.uint64)])
    full = h[: len(w.hash)] * _COEF[0]
    for k in range(1, n):
        full += h[k : k + len(w.hash)] * _COEF[k]
    doc = np.repeat(np.arange(len(count)), have)
    at = np.arange(off[-1]) - off[doc] + w.off[doc]
    out = full[at]
    for i in np.flatnonzero((count > 0) & (count < n)):
        v = w.hash[w.off[i] : w.off[i + 1]]
        out[off[i]] = (v * _COEF[: len(v)]).sum(dtype=np.uint64) + _U(len(v))
    return mix(out), off


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each range of values, 0 for an empty one; along the first axis."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def word_list(text: str | None) -> list[str]:
    """The words of one text, by the regular expression."""
    return re.findall(WORD_RE, (text or "").lower())


def hash_texts(texts: list[str | None], n: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words and shingles of some texts in the driver's hand, lowered here."""
    col = pa.array([(t or "").lower() for t in texts], pa.large_string())
    data, off = buffers(col)
    w = words(data, off)
    return w, *shingles(w, n)
