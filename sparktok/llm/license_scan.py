"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of m shingles is looked for in windows of ``stretch * m`` shingles that start every ``(stretch - 1) * m / 2``
or less, so some window has all of any copy. A window that holds the share ``containment`` of a template has a Jaccard
similarity with it of at least containment / (stretch + 1 - containment); the number of bands of ``rows`` MinHash values is
the smallest that lets such a window be missed with a probability of ``miss`` at most. Where no window can hold that share
(windows.py: a filter that loses nothing) nothing is fingerprinted. A retrieved template counts if the share of its
distinct shingles that the window has reaches ``containment``, and no other license has more of its own at a place that
overlaps: the shortest stretch of the best window that has all of its matched shingles, as the window is longer than the wording.

Nulls and odd cases: a null or empty text, or one without words, holds no license; a row without an id is reported
without one; rows that repeat an id are scanned each; a text shorter than a window is one window. An empty table gives no
rows. Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .common import texts, tidy
from .licenses import TEMPLATES
from .ngram_join import minhash
from .windows import Members, regions


@dataclass(frozen=True)
class LicenseScan:
    n: int = 2
    containment: float = 0.8
    stretch: float = 1.25
    rows: int = 2
    miss: float = 1e-4

    @property
    def least(self) -> float:
        """Jaccard similarity that a window with the share has at least."""
        return self.containment / (self.stretch + 1 - self.containment)

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - self.least**self.rows))


def stretch_of(hit: np.ndarray) -> tuple[int, int]:
    """The shortest range that has every distinct value of ``hit`` other than 0, the first of these."""
    at = np.flatnonzero(hit)
    last: dict[int, int] = {}
    best, whole = (0, len(hit)), len(np.unique(hit[at]))
    for i in at.tolist():
        last.pop(int(hit[i]), None)
        last[int(hit[i])] = i
        first = next(iter(last.values()))
        if len(last) == whole and i + 1 - first < best[1] - best[0]:
            best = (first, i + 1)
    return best


class Templates:
    """Shingles, window sizes and band values of the templates. One of fewer words than n has one shingle."""

    def __init__(self, templates: list[tuple[str, str]], p: LicenseScan):
        self.p = p
        _, sh, off = T.hash_texts([t for _, t in templates], p.n)
        keep = np.flatnonzero(np.diff(off))
        self.names = [templates[k][0] for k in keep]
        self.sets = [np.unique(sh[off[k] : off[k + 1]]) for k in keep]
        self.length = np.array([off[k + 1] - off[k] for k in keep], np.int64)
        self.window = np.array([max(int(m), math.ceil(m * p.stretch)) for m in self.length], np.int64)
        self.stride = np.array([max(1, int((w - m) // 2)) for m, w in zip(self.length, self.window, strict=True)], np.int64)
        self.members = Members(np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64))
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        code = np.searchsorted(self.members.values, flat)
        order = np.argsort(code, kind="stable")
        self.owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])[order]
        self.owner_off = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.members.values)))])
        self.needed = np.array([math.ceil(len(s) * p.containment - 1e-9) for s in self.sets])
        self.bands = self._bands(np.concatenate(self.sets), np.concatenate([[0], np.cumsum([len(s) for s in self.sets])])) if self.sets else None

    def _bands(self, sh: np.ndarray, off: np.ndarray) -> np.ndarray:
        sig = minhash(sh, off, self.p.bands * self.p.rows).astype(np.uint64).reshape(-1, self.p.bands, self.p.rows)
        h = np.zeros(sig.shape[:2], np.uint64)
        for r in range(self.p.rows):
            h = T.mix(h ^ sig[:, :, r])
        return h

    def possible(self, codes: np.ndarray) -> np.ndarray:
        """The templates of which these members are a large enough share."""
        owners = np.concatenate([self.owner[self.owner_off[k] : self.owner_off[k + 1]] for k in np.unique(codes)])
        return np.flatnonzero(np.bincount(owners, minlength=len(self.sets)) >= self.needed)

    def scan(self, col: pa.Array) -> Iterator[tuple[int, str, float, int, int]]:
        """(row, license, containment, first word, words) of the best window of each text for each license."""
        if not self.sets:
            return
        p = self.p
        data, boff = T.buffers(col)
        share = p.containment / p.stretch * 0.75  # a window is a shingle or so longer than stretch * m where m is small
        least = int(np.ceil(self.length.min() * p.containment))
        for r0, r1 in T.rows(boff):
            sh, off = T.shingles(T.words(data[boff[r0] : boff[r1]], boff[r0 : r1 + 1] - boff[r0]), p.n)
            hits, which = self.members.find(sh)
            best: dict[tuple[int, str], tuple[float, int, int]] = {}
            place: dict[tuple[int, str], tuple[int, int]] = {}
            for d, lo, hi in regions(hits, off, share, least, int(self.window.max())):
                x, y = np.searchsorted(hits, [lo, hi])
                can = self.possible(which[x:y])
                for w, stride in sorted({*zip(self.window[can].tolist(), self.stride[can].tolist(), strict=True)}):
                    own = can[(self.window[can] == w) & (self.stride[can] == stride)]
                    begin, length = int(off[d]), int(off[d + 1] - off[d])
                    size = min(w, length)
                    # windows start at multiples of the stride, and one ends with the text
                    grid = begin + np.append(np.arange(0, length - size + 1, stride), length - size)
                    start = np.unique(grid[(grid >= lo) & (grid + size <= hi)])
                    if not len(start):
                        continue
                    at = (start[:, None] + np.arange(size)).ravel()
                    bands = self._bands(sh[at], np.arange(len(start) + 1) * size)
                    for i, k in zip(*np.nonzero((bands[:, None, :] == self.bands[own][None]).any(2)), strict=True):
                        t = own[k]
                        c = float(np.isin(self.sets[t], sh[start[i] : start[i] + size]).mean())
                        key, value = (r0 + d, self.names[t]), (c, int(start[i] - off[d]), size + p.n - 1)
                        if c >= p.containment and (key not in best or (-c, *value[1:]) < (-best[key][0], *best[key][1:])):
                            best[key] = value
                            part = sh[start[i] : start[i] + size]
                            x, y = stretch_of(np.where(np.isin(part, self.sets[t]), np.searchsorted(self.sets[t], part) + 1, 0))
                            place[key] = (value[1] + x, value[1] + y)
            for (r, name), (c, at, size) in sorted(best.items()):
                x, y = place[r, name]
                near = (v for k, v in best.items() if k[0] == r and place[k][0] < y and x < place[k][1])
                if c >= max(v[0] for v in near):
                    yield r, name, c, at, size


def license_scan(df: DataFrame, templates: list[tuple[str, str]] | None = None, p: LicenseScan = LicenseScan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, start_word, n_words: the best window of each text for each license that it holds."""
    index = Templates(TEMPLATES if templates is None else templates, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(index.scan(b.column("text")))
            if got:
                r, *rest = zip(*got, strict=True)
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(r)), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], ["doc_id", "license", "containment", "start_word", "n_words"])

    return texts(df, id_col, text_col).mapInArrow(tidy(run), "doc_id long, license string, containment double, start_word long, n_words long")
