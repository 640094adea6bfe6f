"""Benchmark decontamination: item-sized windows are fingerprinted by SimHash, found by multi-index Hamming search and verified exactly.

For each benchmark item of m words, every window of m words of a text is looked at where it can match at all (windows.py:
a filter that loses nothing). A window's and an item's 64-bit SimHash is the sign of the sum of its shingles' hash bits,
weighted by ln(1 + items / items with the shingle). The fingerprints are cut into ``blocks``; two within ``radius`` bits
agree up to radius // blocks bits in one block at least, so looking up every value that close in every block finds all.
What is found is verified by the weighted Jaccard similarity of both bags of shingles.

The benchmark goes to the tasks in chunks of at most ``chunk`` characters, each a pass over the texts: benchmarks are
small, and one that isn't costs passes, not memory. Weights are those of the whole benchmark in every chunk: each gets the
number of items and the shingles that are in more than one item, about 16 bytes each; all others weigh the same.

Nulls and odd cases: a null or empty text, or one without words, matches nothing, nor does such an item; a row without an
id is scanned, and reported without an id; items without an id are left out; rows that repeat an id are scanned
each, items that repeat an id are items of their own, each reported. Empty tables give no rows. A text shorter than an
item is one window. Only the columns named are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bound_batches, give_back, texts, tidy
from .windows import Members, regions


@dataclass(frozen=True)
class Decontam:
    """n: words in a shingle. threshold: of the weighted Jaccard similarity, inclusive. radius: bits of 64 in which fingerprints may differ: at the default threshold the cosine is 0.75, of which 14.7 bits differ on average with a standard deviation of 3.4."""

    n: int = 3
    threshold: float = 0.6
    radius: int = 24
    blocks: int = 8
    chunk: int = 8_000_000


_SHIFTS = np.arange(64, dtype=np.uint64)


def _signed(h: np.ndarray) -> np.ndarray:
    return (((h[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.float32) * 2 - 1) if len(h) else np.zeros((0, 64), np.float32)


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """Fingerprints, block tables and weighted bags of some items. whole: the items of the benchmark that have shingles, and the shingles of more than one with their numbers of items, where these items are a part of it."""

    def __init__(self, items: list[tuple[int, str | None]], p: Decontam, whole: tuple[int, np.ndarray, np.ndarray] | None = None):
        self.p = p
        w, sh, off = T.hash_texts([t for _, t in items], p.n)
        keep = np.flatnonzero(np.diff(off))
        self.ids = np.array([items[k][0] for k in keep], np.int64)
        bags = [sh[off[k] : off[k + 1]] for k in keep]
        self.words = np.diff(w.off)[keep]
        self.size = np.array([len(b) for b in bags], np.int64)
        n = len(keep)
        distinct = [np.unique(b) for b in bags]
        flat = np.concatenate(distinct) if n else np.zeros(0, np.uint64)
        # shingles of other items that weigh less are members too, as regions() needs those outside to weigh most
        self.members = Members(flat if whole is None else np.concatenate([flat, whole[1]]))
        df = np.bincount(np.searchsorted(self.members.values, flat), minlength=len(self.members.values)) if n else np.zeros(0)
        every, among = n, df
        if whole is not None and n:
            every, among = whole[0], np.ones(len(df))
            among[np.searchsorted(self.members.values, whole[1])] = whole[2]
        self.weight = np.log1p(every / np.maximum(among, 1)) if n else np.zeros(0)
        self.other = float(np.log1p(every))
        owner = np.repeat(np.arange(n), [len(d) for d in distinct])
        order = np.argsort(np.searchsorted(self.members.values, flat), kind="stable")
        self.owner = owner[order]
        self.owner_off = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        times = np.concatenate([np.unique(b, return_counts=True)[1] for b in bags]) if n else np.zeros(0)
        self.owner_weight = (times * self.weight[np.searchsorted(self.members.values, flat)])[order] if n else np.zeros(0)
        self.total = np.bincount(self.owner, self.owner_weight, n) if n else np.zeros(0)
        self.bags = [Counter(b.tolist()) for b in bags]
        self.prints = np.concatenate([_pack((_signed(b) * self.weights(b)[:, None].astype(np.float32)).sum(0)[None]) for b in bags]) if n else np.zeros(0, np.uint64)
        self.near = self._near()

    def weights(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.other)
        at, k = self.members.find(h)
        out[at] = self.weight[k]
        return out

    def _near(self) -> np.ndarray:
        """near[block, value, item]: the item's bits of the block are within radius // blocks of the value."""
        width = 64 // self.p.blocks
        values = np.arange(1 << width, dtype=np.uint64)
        out = np.zeros((self.p.blocks, 1 << width, len(self.ids)), bool)
        for b in range(self.p.blocks):
            own = (self.prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)
            out[b] = np.bitwise_count(values[:, None] ^ own[None]) <= self.p.radius // self.p.blocks
        return out

    def within(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all that are within the radius."""
        width = 64 // self.p.blocks
        found = np.zeros((len(prints), len(items)), bool)
        for b in range(self.p.blocks):
            value = ((prints >> np.uint64(b * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            found |= self.near[b][value[:, None], items[None]]
        i, k = np.nonzero(found)
        good = np.bitwise_count(prints[i] ^ self.prints[items[k]]) <= self.p.radius
        return i[good], items[k[good]]

    def possible(self, codes: np.ndarray) -> np.ndarray:
        """The items of whose weight these members are a large enough share."""
        at = np.concatenate([np.arange(self.owner_off[k], self.owner_off[k + 1]) for k in np.unique(codes)])
        return np.flatnonzero(np.bincount(self.owner[at], self.owner_weight[at], len(self.ids)) >= self.p.threshold * self.total - 1e-9)

    def similarity(self, h: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's bag and an item's."""
        own = Counter(h.tolist())
        bag = self.bags[item]
        keys = np.array([*own.keys() | bag.keys()], np.uint64)
        keys.sort()
        a, b = (np.array([c[x] for x in keys.tolist()], float) for c in (own, bag))
        w = self.weights(keys)
        return float((np.minimum(a, b) * w).sum() / (np.maximum(a, b) * w).sum())

    def scan(self, col: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window of each text for each item."""
        if not len(self.ids):
            return
        p = self.p
        data, boff = T.buffers(col)
        reach, least = int(self.size.max()), int(self.size.min())
        for r0, r1 in T.rows(boff):
            sh, off = T.shingles(T.words(data[boff[r0] : boff[r1]], boff[r0 : r1 + 1] - boff[r0]), p.n)
            hits, which = self.members.find(sh)
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            for d, lo, hi in regions(hits, off, p.threshold, least, reach):
                x, y = np.searchsorted(hits, [lo, hi])
                near = self.possible(which[x:y])
                if not len(near):
                    continue
                part = sh[lo:hi]
                total = np.zeros((len(part) + 1, 64))
                np.cumsum(_signed(part) * self.weights(part)[:, None], axis=0, out=total[1:])
                whole = int(off[d + 1] - off[d])
                for size in np.unique(np.minimum(self.size[near], whole)).tolist():
                    items = near[np.minimum(self.size[near], whole) == size]
                    if size > len(part):
                        continue
                    for i, k in zip(*self.within(_pack(total[size:] - total[:-size]), items), strict=True):
                        s = self.similarity(part[i : i + size], k)
                        key = (r0 + d, int(k))
                        if s >= p.threshold and (key not in best or (-s, lo + i) < (-best[key][0], best[key][1])):
                            best[key] = (s, lo + int(i), d)
            for (r, k), (s, at, d) in sorted(best.items()):
                yield r, k, s, int(at - off[d]), int(self.words[k])


def _whole(items: DataFrame, p: Decontam) -> tuple[int, np.ndarray, np.ndarray]:
    """How many items have shingles, and the shingles of more than one item with how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, sh, off = T.hash_texts(b.column("text").to_pylist(), p.n)
            own = [np.unique(sh[i:j]) for i, j in zip(off[:-1], off[1:], strict=True) if j > i]
            if own:
                flat = np.concatenate(own).view(np.int64)
                first = np.concatenate([np.arange(len(x)) == 0 for x in own])
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(first.astype(np.int64))], ["sh", "first"])

    rows = items.select("text").mapInArrow(tidy(run), "sh long, first long")
    n = int(rows.agg(F.sum("first")).first()[0] or 0)
    got = rows.groupBy("sh").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    values, count = got["sh"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(values)
    return n, values[order], count[order]


def _indexes(benchmark: DataFrame, p: Decontam, id_col: str, text_col: str) -> Iterator[Index]:
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    n = int((items.select(F.sum(F.length("text"))).first()[0] or 0) // p.chunk) + 1
    whole = _whole(items, p) if n > 1 else None
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield Index(sorted(((r.id, r.text) for r in part.collect()), key=lambda x: (x[0], x[1] or "")), p, whole)


def contamination(df: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window for each text and each item that it holds."""
    docs, out = texts(df, id_col, text_col), None
    for part in _indexes(benchmark, p, item_col, item_text):
        index = df.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(index.value.scan(b.column("text")))
                if got:
                    r, k, s, at, n = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("id").take(pa.array(r)), pa.array(index.value.ids[list(k)]), pa.array(s), pa.array(at, pa.int64()), pa.array(n, pa.int64())],
                        ["doc_id", "item_id", "similarity", "start_word", "n_words"],
                    )

        part = docs.mapInArrow(tidy(run), "doc_id long, item_id long, similarity double, start_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, p: Decontam = Decontam(), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df whose text holds no benchmark item; decided row by row, so nothing is shuffled."""
    out = df
    bound_batches(df.sparkSession)
    for part in _indexes(benchmark, p, item_col, item_text):
        holds = _holds(df.sparkSession.sparkContext.broadcast(part))
        out = out.where(~holds(F.coalesce(F.lower(F.col(text_col)), F.lit(""))))
    return out


def _holds(index: Broadcast[Index]):
    @F.arrow_udf("boolean")
    def holds(col: pa.Array) -> pa.Array:
        flags = np.zeros(len(col), bool)
        for r, *_ in index.value.scan(col):
            flags[r] = True
        give_back()
        return pa.array(flags)

    return holds
