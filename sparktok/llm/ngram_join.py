"""Word n-gram Jaccard self-join with Bayesian pruning of candidates.

1. Texts with the same sequence of words are one *class*, whose smallest id stands for it: n copies cost n rows, not n² pairs.
2. Each class gets ``bands * rows`` MinHash values; classes that agree in all rows of a band share a *bucket*. The bands are
   chosen such that a pair at the threshold is found with a probability of ``recall`` at least. Buckets are only counted and
   fingerprinted, never listed: of those with the same members one is kept, and its members are brought together. One of more than ``tile`` shingles is cut by hash into blocks that meet in pairs, so that a
   task's memory stays bounded, with no pair left out.
3. Within a bucket, a pair is looked at only if no earlier band has it, so nothing is done twice and no pairs are
   shuffled. It is compared a few MinHash values at a time. With m of n equal, the posterior of the Jaccard similarity
   under a uniform prior is Beta(m + 1, n - m + 1); the pair is dropped as soon as its probability of reaching the
   threshold falls below ``tolerance``. Values come first, and texts only of members that have a pair left.
4. Whatever is left is verified by its exact sets of shingles. A block gives each class's number of linked documents, and
   edges that connect what is linked, fewer than it has members. Edges are joined to components; each document gets its
   component and the links of its text. So the result has a row a document, however large its group.

A link is a pair of documents whose similarity reaches the threshold. jaccard_join() gives each document's number of links and
the smallest id among all that links connect; near_duplicates() those that aren't the smallest of theirs.

Nulls and odd cases: a row without an id has no links and no row; a null text, or one without words, is similar to nothing; a
text of fewer than n words has one shingle, of all its words. Rows that repeat an id with the same words are one document;
with different words each text's links count, those to the id's other texts too, and all are connected. An empty table gives
no rows. Only the two columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, marked_small, texts, tidy


@dataclass(frozen=True)
class JaccardJoin:
    """n: words in a shingle. threshold: of the Jaccard similarity, inclusive. rows: MinHash values in a band. recall: of pairs at the threshold, by the bands. tolerance: posterior probability under which a candidate goes. step: MinHash values compared at once. tile: shingles in a block of a large bucket."""

    n: int = 3
    threshold: float = 0.5
    rows: int = 3
    recall: float = 0.985
    tolerance: float = 0.005
    step: int = 16
    tile: int = 1_000_000

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows))

    @property
    def size(self) -> int:
        return self.bands * self.rows


def least_equal(p: JaccardJoin) -> list[tuple[int, int]]:
    """(n, m): of the first n MinHash values m at least must be equal, else P(J >= threshold | m of n) < tolerance."""
    out = []
    for n in range(p.step, p.size + 1, p.step):
        # P(Beta(m+1, n-m+1) >= t) is P(Binomial(n+1, t) <= m)
        below, m = 0.0, -1
        while below < p.tolerance and m < n:
            m += 1
            below += math.comb(n + 1, m) * p.threshold**m * (1 - p.threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    h = T.mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (h[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (h[k:] >> np.uint64(32)).astype(np.uint32)


def minhash(sh: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """k MinHash values of each non-empty range of shingles, as rows."""
    a, c = _coefficients(k)
    full = np.flatnonzero(np.diff(off))
    out = np.full((k, len(off) - 1), 0xFFFFFFFF, np.uint32)
    if len(full):
        low = (sh >> np.uint64(32)).astype(np.uint32) ^ sh.astype(np.uint32)
        for i in range(k):
            v = low * a[i]
            v ^= v >> np.uint32(15)
            v += c[i]
            v *= np.uint32(0x2C1B3C6D)
            out[i, full] = np.minimum.reduceat(v, off[:-1][full])
    return np.ascontiguousarray(out.T)


def _sequence(sh: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each sequence of shingles: the sum of each one with its place mixed in."""
    place = T.mix((np.arange(len(sh)) - np.repeat(off[:-1], np.diff(off))).astype(np.uint64))
    return T.sums(T.mix(sh ^ place), off).view(np.int64)


def _signatures(p: JaccardJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.buffers(b.column("text"))
            ids = b.column("id")
            for i, j in T.rows(off):
                w = T.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                sh, so = T.shingles(w, p.n)
                n = np.diff(so)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                sig = minhash(sh, so, p.size)[full]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(full)), pa.array(_sequence(sh, so)[full]), pa.array(n[full]), _rows(sig)], ["id", "cid", "n", "sig"])

    return run


def _rows(sig: np.ndarray) -> pa.Array:
    n, width = len(sig), sig.shape[1] * sig.itemsize
    off = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(sig.tobytes())])


def _matrix(col: pa.Array, k: int) -> np.ndarray:
    return T.buffers(col)[0].view(np.uint32).reshape(-1, k) if len(col) else np.zeros((0, k), np.uint32)


def _bands(p: JaccardJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _matrix(b.column("sig"), p.size).astype(np.uint64)
            for k in range(p.bands):
                h = np.full(len(sig), np.uint64(k + 1))
                for r in range(p.rows):
                    h = T.mix(h ^ sig[:, k * p.rows + r])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), k, np.int32)), pa.array(h.view(np.int64)), b.column("cid"), b.column("n")], ["k", "band", "cid", "n"])

    return run


def _tiles(p: JaccardJoin):
    """A member of a bucket, once for each pair of blocks that its block is in. side: 0 and 1 for the two blocks, 2 where both are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid = b.column("cid").to_numpy()
            blocks = -(-b.column("shingles").to_numpy() // p.tile)
            own = (T.mix(cid.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            # one row for each block that it meets
            row = np.repeat(np.arange(len(cid)), blocks)
            other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            mine = own[row]
            tile = np.minimum(mine, other) * blocks[row] + np.maximum(mine, other)
            side = np.where(mine == other, 2, (mine > other).astype(np.int64))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("k").take(at), b.column("band").take(at), pa.array(tile), pa.array(side), b.column("cid").take(at)], ["k", "band", "tile", "side", "cid"])

    return run


def _alike(p: JaccardJoin, k: int, sig: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) of the pairs in a bucket that no earlier band has and that their values don't rule out."""
    gates = least_equal(p)
    at = [n // p.step - 1 for n, _ in gates]
    least = np.array([m for _, m in gates])
    for i in range(len(sig) - 1):
        j = np.arange(i + 1, len(sig))
        if side[i] != 2:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        same = sig[j] == sig[i]
        band = same.reshape(len(j), p.bands, p.rows).all(2)
        go = band[:, k] & ~band[:, :k].any(1)
        j, same = j[go], same[go]
        if not len(j):
            continue
        equal = np.add.reduceat(same, np.arange(0, p.size, p.step), axis=1, dtype=np.int32).cumsum(1)
        j = j[(equal[:, at] >= least).all(1)]
        if len(j):
            yield i, j


def _meet(p: JaccardJoin, k: int, sig: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, similarity) of the pairs that are left, verified."""
    size = np.array([len(x) for x in sets])
    off = np.concatenate([[0], np.cumsum(size)])
    vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(vocabulary), bool)
    for i, j in _alike(p, k, sig, side):
        flag[code[off[i] : off[i + 1]]] = True
        both = T.sums(flag[code].astype(np.int32), off)[j] if len(j) > 8 else np.array([flag[code[off[x] : off[x + 1]]].sum() for x in j])
        flag[code[off[i] : off[i + 1]]] = False
        s = both / (size[i] + size[j] - both)
        good = s >= p.threshold
        if good.any():
            yield i, j[good], s[good]


def _candidates(p: JaccardJoin):
    """The members of blocks that have a pair to verify there, by their values alone: only their texts need to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ("band", "k", "tile")):
            keep = np.zeros(len(g), bool)
            for i, j in _alike(p, int(g["k"][0].as_py()), _matrix(g["sig"].combine_chunks(), p.size), g["side"].to_numpy()):
                keep[i] = keep[j] = True
            if keep.any():
                yield from g.drop_columns(["sig"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, whole."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        cols = [b.column(c).to_numpy() for c in keys]
        cut = np.zeros(len(b), bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(cut), len(b)]
        for s, e in zip(at[:-1], at[1:], strict=True):
            key = tuple(c[s] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(t.slice(s, e - s))
            last = key
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _linked(p: JaccardJoin):
    """The documents that a block links with each of its classes, by cid; and edges that connect the classes, as their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0
        for g in _groups(batches, ("band", "k", "tile")):
            ids, copies, cid = (g[c].to_numpy() for c in ("id", "copies", "cid"))
            side, sig = g["side"].to_numpy(), _matrix(g["sig"].combine_chunks(), p.size)
            root, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            for i, j, _ in _meet(p, int(g["k"][0].as_py()), sig, side, _sets(g["text"].combine_chunks(), p.n)):
                links[i] += copies[j].sum()
                links[j] += copies[i]
                for x in np.unique(root[j]):
                    if x != root[i]:
                        root[root == x] = root[i]
            at = np.flatnonzero(links)
            if not len(at):
                continue
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, root[at], ids[at])
            kept.append(np.stack([cid[at], links[at], ids[at], low[root[at]]]))
            size += len(at)
            if size > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(kept, 1)], ["cid", "links", "a", "b"])
                kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(kept, 1)], ["cid", "links", "a", "b"])

    return run


def _sets(col: pa.Array, n: int) -> list[np.ndarray]:
    data, off = T.buffers(col)
    out: list[np.ndarray] = []
    for i, j in T.rows(off):
        sh, so = T.shingles(T.words(data[off[i] : off[j]], off[i : j + 1] - off[i]), n)
        out += [np.unique(sh[so[k] : so[k + 1]]) for k in range(j - i)]
    return out


def _keyed(p: JaccardJoin):
    """The class of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.buffers(b.column("text"))
            for i, j in T.rows(off):
                sh, so = T.shingles(T.words(data[off[i] : off[j]], off[i : j + 1] - off[i]), p.n)
                yield pa.RecordBatch.from_arrays([pa.array(_sequence(sh, so)), b.column("text").slice(i, j - i)], ["cid", "text"])

    return run


def _classes(docs: DataFrame, p: JaccardJoin, at: Scratch) -> tuple[DataFrame, DataFrame]:
    """(cid, n, sig, copies, id) of each class, and (id, cid) of each document's text."""
    signed = at.save(docs.mapInArrow(tidy(_signatures(p)), "id long, cid long, n long, sig binary"), "signed")
    members = at.save(signed.select("id", "cid").distinct(), "members")
    copies = members.groupBy("cid").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    one = signed.groupBy("cid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = at.save(one.join(copies, "cid"), "classes")
    at.drop("signed")
    return classes, members


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("band", "k", "tile").sortWithinPartitions("band", "k", "tile", "cid")


def _met(docs: DataFrame, classes: DataFrame, p: JaccardJoin, at: Scratch) -> DataFrame:
    """cid, links, a, b: links that a block adds to a class, and an edge from its id; several rows a class."""
    bands = classes.select("cid", "n", "sig").mapInArrow(tidy(_bands(p)), "k int, band long, cid long, n long")
    mark = [F.bit_xor(F.xxhash64("cid", F.lit(x))).alias(f"x{x}") for x in (1, 2)]
    buckets = bands.groupBy("k", "band").agg(F.count("*").alias("many"), F.sum("n").alias("shingles"), *mark).where("many > 1")
    # of buckets with the same members only the first is needed: it has all their pairs
    merged = at.save(buckets.groupBy("many", "shingles", "x1", "x2").agg(F.min(F.struct("k", "band")).alias("of")).select("of.k", "of.band", "shingles"), "buckets")
    tiles = bands.drop("n").join(merged, ["k", "band"]).mapInArrow(tidy(_tiles(p)), "k int, band long, tile long, side long, cid long")
    blocks = at.save(tiles, "blocks").join(classes.select("cid", "sig"), "cid").select("k", "band", "tile", "side", "cid", "sig")
    tiles = at.save(_in_blocks(blocks).mapInArrow(tidy(_candidates(p)), "k int, band long, tile long, side long, cid long"), "tiles")
    member = classes.join(tiles.select("cid").distinct(), "cid", "left_semi").select("cid", "id", "copies", "sig")
    needed = at.save(member.select("id").distinct(), "needed")
    whole = docs.join(marked_small(needed), "id", "left_semi").mapInArrow(tidy(_keyed(p)), "cid long, text string").dropDuplicates(["cid"])
    full = tiles.join(member.join(whole, "cid"), "cid")
    met = at.save(_in_blocks(full).mapInArrow(tidy(_linked(p)), "cid long, links long, a long, b long"), "met")
    at.drop("buckets", "blocks", "tiles", "needed")
    return met


def _grouped(df: DataFrame, p: JaccardJoin, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """(id, cid) of each document's text; cid, id, copies, root of each class; what _met() gives."""
    at = Scratch(df.sparkSession, "jaccard")
    docs = texts(df, id_col, text_col).where("id is not null")
    classes, members = _classes(docs, p, at)
    met = _met(docs, classes, p, at)
    edges = met.select("a", "b")
    # texts of one id are connected by their classes' ids
    several = at.save(members.groupBy("id").agg(F.count("*").alias("many"), F.min("cid").alias("first")).where("many > 1").select("id", "first"), "several")
    if not several.isEmpty():
        of = classes.select("cid", "id")
        same = members.join(several, "id").select("cid", "first").distinct()
        edges = edges.unionByName(same.join(of.withColumnRenamed("id", "a"), "cid").join(of.select(F.col("cid").alias("first"), F.col("id").alias("b")), "first").select("a", "b"))
    found = components(edges, at)
    classes = classes.select("cid", "id", "copies").join(found.withColumnRenamed("node", "id"), "id", "left")
    return members, classes.select("cid", "id", "copies", F.coalesce("root", "id").alias("root")), met, at


def jaccard_join(df: DataFrame, p: JaccardJoin = JaccardJoin(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id of the documents that links connect with it), n_links of every document."""
    members, classes, met, at = _grouped(df, p, id_col, text_col)
    links = met.groupBy("cid").agg(F.sum("links").alias("links"))
    of = at.save(classes.join(links, "cid", "left").select("cid", "root", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), "links")
    linked = members.join(of, "cid").select("id", "root", "links")
    silent = df.select(F.col(id_col).cast("long").alias("id")).where("id is not null").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("links"))
    every = linked.unionByName(silent).groupBy("id").agg(F.min("root").alias("class_id"), F.sum("links").alias("n_links"))
    return every.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def components(edges: DataFrame, at: Scratch) -> DataFrame:
    """(node, root): the smallest node that each node of some undirected edges (a, b) is connected to, but for roots themselves. Large-star and small-star steps in turn; each round is written out."""
    now = at.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star0")
    k, before = 0, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        k += 1
        now = at.save(small.where("u <> v").distinct(), f"star{k}")
        at.drop(f"star{k - 1}")
        mark = now.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark


def near_duplicates(df: DataFrame, p: JaccardJoin = JaccardJoin(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root): the documents that links connect with one of a smaller id, and the smallest of those connected."""
    members, classes, _, _ = _grouped(df, p, id_col, text_col)
    several = classes.where("copies > 1 or root <> id").select("cid", "root")
    return members.join(several, "cid").where("id <> root").groupBy(F.col("id").alias("node")).agg(F.min("root").alias("root"))


def drop_near_duplicates(df: DataFrame, p: JaccardJoin = JaccardJoin(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df but for those of documents that are connected with one of a smaller id. Rows without an id stay; rows that repeat a kept id stay."""
    gone = marked_small(near_duplicates(df, p, id_col, text_col).select(F.col("node").alias("__gone")))
    return df.join(gone, df[id_col].cast("long") == gone["__gone"], "left_anti")
