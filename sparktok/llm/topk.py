"""Exact top-k search: the nearest of all vectors for a set of queries, by KD-trees per shard.

1. Median splits of a bounded sample cut space into shards of about ``shard_rows`` vectors, 4 at least; any split gives right
   results, the sample only balances them. A shard that gets too many vectors for that, as where many are equal, is cut
   further by a hash of the ids. Vectors go to their shards, one shuffle; each shard builds a KD-tree: median splits of the
   widest side, tight bounding boxes. Trees are written to a table bucketed by shard, so they don't move again.
2. Each query searches its own shard first. Then, in rounds, it visits the next shards in the order of the bound between box
   and query, twice as many each time, but none that is farther than the kth distance found so far; a round's results are
   merged before the next. Only queries move. Within a shard, queries that lie together go through the tree best first.
3. The search ends when no query has a shard left that is near enough.

Distances are Euclidean, summed in double precision from the differences themselves; matrix products only sort out what
is too far by more than their own error. Of equal distances the smaller id comes first. Boxes of up to 65,536 shards go to
all tasks, 1 kB each at 64 dimensions: where there are more vectors, shards are larger.

In many dimensions without structure all boxes are near, and a query visits all shards: exact search is then queries times
vectors, whatever the method, and the boxes only order the visits.

Nulls and odd cases: a row without an id or a vector, or with an empty vector or one that has a null, a NaN or an infinity
in it, is neither query nor neighbour. Only vectors of the same length are compared. Rows that repeat an id are one
vector, the smallest in the order of arrays. A query with fewer than k others has fewer rows; an empty table, or a single
vector, gives none. Only the columns named are read.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy


@dataclass(frozen=True)
class TopK:
    """every: rows whose id it divides are the queries. k: neighbours. leaf: vectors in a leaf. batch: queries searched together. block: queries that go to a shard in one row. most: shards visited in a round at most. sample: vectors that splits are made from, 16 a shard at least."""

    every: int = 1
    k: int = 10
    leaf: int = 256
    batch: int = 256
    block: int = 2048
    most: int = 1024
    shard_rows: int = 8192
    shards: int = 32_768
    sample: int = 20_000


class KdTree:
    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int):
        self.x, self.ids = x, ids
        self.order = np.arange(len(x))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.range: list[tuple[int, int]] = []
        self.child: list[tuple[int, int] | None] = []
        todo = [(0, len(x), None)]
        while todo:
            s, e, above = todo.pop()
            own = x[self.order[s:e]]
            node = len(self.range)
            self.low.append(own.min(0))
            self.high.append(own.max(0))
            self.range.append((s, e))
            self.child.append(None)
            if above is not None:
                a, side = above
                got = self.child[a] or (-1, -1)
                self.child[a] = (node, got[1]) if side == 0 else (got[0], node)
            wide = self.high[-1] - self.low[-1]
            if e - s > leaf and wide.max() > 0:
                m = (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(own[:, wide.argmax()], m)]
                todo += [(s, s + m, (node, 0)), (s + m, e, (node, 1))]
        self.x, self.ids = x[self.order], ids[self.order]
        self.norm = (self.x * self.x).sum(1)

    def bound(self, q: np.ndarray, node: int) -> np.ndarray:
        """Squared distance of each query to the node's box, by no more than rounding above what its points have."""
        d = np.maximum(self.low[node] - q, 0) + np.maximum(q - self.high[node], 0)
        return (d * d).sum(1) * (1 - 1e-12)

    def search(self, q: np.ndarray, qid: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, squared distance, id), the k best of each of some queries that lie together and none beyond its limit, in order."""
        norm = (q * q).sum(1)
        kth = limit.copy()
        row, dist, near = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        first = self.bound(q, 0)
        heap = [(float(first.min()), 0, first)]
        while heap:
            low, node, bound = heapq.heappop(heap)
            if low > kth.max():
                break
            live = np.flatnonzero(bound <= kth)
            if not len(live):
                continue
            children = self.child[node]
            if children:
                for c in children:
                    b = np.full(len(q), np.inf)
                    b[live] = self.bound(q[live], c)
                    heapq.heappush(heap, (float(b.min()), c, b))
                continue
            s, e = self.range[node]
            x = self.x[s:e]
            rough = norm[live, None] + self.norm[None, s:e] - 2 * (q[live] @ x.T)
            slack = 1e-12 * (norm[live] + self.norm[s:e].max())
            self_too = k + 1
            top = np.partition(rough, self_too - 1, axis=1)[:, self_too - 1] if e - s > self_too else np.full(len(live), np.inf)
            i, j = np.nonzero(rough <= (np.minimum(kth[live], top + slack) + slack)[:, None])
            good = self.ids[s + j] != qid[live[i]]
            i, j = live[i[good]], j[good]
            d = q[i] - x[j]
            d = (d * d).sum(1)
            row, dist, near = np.concatenate([row, i]), np.concatenate([dist, d]), np.concatenate([near, self.ids[s + j]])
            by = np.lexsort((near, dist, row))
            row, dist, near = row[by], dist[by], near[by]
            start = np.searchsorted(row, np.arange(len(q)))
            rank = np.arange(len(row)) - start[row]
            keep = (rank < k) & (dist <= limit[row])
            row, dist, near, rank = row[keep], dist[keep], near[keep], rank[keep]
            last = rank == k - 1
            kth[row[last]] = np.minimum(kth[row[last]], dist[last])
        return row, dist, near


class Splits:
    """The upper median splits, by which vectors find their shards. axis[node], at[node]; node i has the children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = {0: sample}
        for node in range(len(self.axis)):
            x = parts.pop(node)
            if len(x):
                a = int((x.max(0) - x.min(0)).argmax())
                self.axis[node], self.at[node] = a, np.median(x[:, a])
                left = x[:, a] < self.at[node]
                parts[2 * node + 1], parts[2 * node + 2] = x[left], x[~left]
            else:
                parts[2 * node + 1] = parts[2 * node + 2] = x

    def shard(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] >= self.at[node])
        return node - len(self.axis)


def _matrix(col: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _batches(x: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Indexes of queries that lie together, by median splits."""
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            if len(own):
                yield own
            continue
        wide = x[own].max(0) - x[own].min(0)
        order = own[np.argpartition(x[own, wide.argmax()], len(own) // 2)]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]


def _packed(tree: KdTree) -> bytes:
    out = io.BytesIO()
    child = np.array([c or (-1, -1) for c in tree.child], np.int64)
    np.savez(out, x=tree.x, ids=tree.ids, low=np.array(tree.low), high=np.array(tree.high), range=np.array(tree.range, np.int64), child=child)
    return out.getvalue()


def _unpacked(raw: bytes) -> KdTree:
    got = np.load(io.BytesIO(raw))
    tree = KdTree.__new__(KdTree)
    tree.x, tree.ids, tree.low, tree.high = (got[c] for c in ("x", "ids", "low", "high"))
    tree.range = [*map(tuple, got["range"].tolist())]
    tree.child = [tuple(c) if c[0] >= 0 else None for c in got["child"].tolist()]
    tree.norm = (tree.x * tree.x).sum(1)
    return tree


_NEAR = "array<struct<d:double,id:long>>"


def _lists(row: np.ndarray, dist: np.ndarray, near: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(row, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(dist), pa.array(near)], ["d", "id"]))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _order(q: np.ndarray, low: np.ndarray, high: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places of the boxes from near to far, its own first, and their bounds in that order."""
    bound = np.zeros((len(q), len(low)))
    for a in range(q.shape[1]):
        gap = np.maximum(low[:, a] - q[:, a, None], 0) + np.maximum(q[:, a, None] - high[:, a], 0)
        bound += gap * gap
    bound *= 1 - 1e-12
    bound[np.arange(len(q)), home] = -1
    order = np.argsort(bound, axis=1, kind="stable")
    return order, np.take_along_axis(bound, order, 1)


def _same_length(v: DataFrame, d: int, n: int, p: TopK, at: Scratch) -> DataFrame:
    """query, near."""
    spark = v.sparkSession
    rows = max(p.shard_rows, math.ceil(n / p.shards))
    depth = max(2, math.ceil(math.log2(n / rows)))
    share = min(1.0, max(p.sample, 16 << depth) / n)
    drawn = v.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * float(1 << 30)).select("v").toArrow()
    splits = spark.sparkContext.broadcast(Splits(_matrix(drawn["v"], d) if len(drawn) else np.zeros((0, d)), depth))

    @F.arrow_udf("long")
    def place(col: pa.Array) -> pa.Array:
        return pa.array(splits.value.shard(_matrix(col, d)) if len(col) else np.zeros(0, np.int64))

    placed = v.select(place("v").alias("place"), "id", "v")
    many = {r["place"]: math.ceil(r["count"] / (2 * rows)) for r in placed.groupBy("place").count().collect()}
    cuts = np.ones(1 << depth, np.int64)
    for k, c in many.items():
        cuts[k] = c
    first = np.concatenate([[0], np.cumsum(cuts)])
    shared = spark.sparkContext.broadcast(first)

    @F.arrow_udf("long")
    def shard(where: pa.Array, part: pa.Array) -> pa.Array:
        w = where.to_numpy()
        size = shared.value[w + 1] - shared.value[w]
        return pa.array(shared.value[w] + part.to_numpy() % size)

    points = placed.select(shard("place", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).alias("shard"), "id", "v")

    def build(key: tuple, t: pa.Table) -> pa.Table:
        tree = KdTree(_matrix(t["v"], d), t["id"].to_numpy(), p.leaf)
        return pa.table([pa.array([key[0].as_py()]), pa.array([tree.low[0].tolist()]), pa.array([tree.high[0].tolist()]), pa.array([_packed(tree)], pa.binary()), pa.array([0], pa.int32())], ["shard", "low", "high", "tree", "part"])

    number = int(first[-1])
    trees = at.bucketed(points.groupBy("shard").applyInArrow(build, "shard long, low array<double>, high array<double>, tree binary, part int"), f"trees{d}", "shard", min(number, 100_000), "part")
    boxes = trees.select("shard", "low", "high").orderBy("shard").toArrow()
    names, low, high = boxes["shard"].to_numpy(), _matrix(boxes["low"], d), _matrix(boxes["high"], d)
    known: Broadcast = spark.sparkContext.broadcast((names, low, high))
    asked = points.where(F.pmod("id", F.lit(p.every)) == 0)
    state = asked.select(F.col("id").alias("query"), "shard", "v", F.lit(float("inf")).alias("kth"), F.lit(0).cast("long").alias("seen"), F.array().cast(_NEAR).alias("near"))
    state = at.save(state, f"state{d}_0")
    blocks = max(1, math.ceil(state.count() / p.block))
    turn, width = 0, 1

    def visits(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, low, high = known.value
            for b in batches:
                for i in range(0, len(b), 256):
                    part = b.slice(i, 256)
                    q, kth, seen = _matrix(part.column("v"), d), part.column("kth").to_numpy(), part.column("seen").to_numpy()
                    order, bound = _order(q, low, high, np.searchsorted(names, part.column("shard").to_numpy()))
                    rank = np.arange(len(names))
                    go = (rank >= seen[:, None]) & (rank < seen[:, None] + width) & (bound <= kth[:, None])
                    r, c = np.nonzero(go)
                    if len(r):
                        at_ = pa.array(r)
                        yield pa.RecordBatch.from_arrays([pa.array(names[order[r, c]]), *(part.column(x).take(at_) for x in ("query", "v", "kth"))], ["shard", "query", "v", "kth"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for b in batches:
            for r in range(len(b)):
                name = b.column("shard")[r].as_py()
                if name != last:
                    last, tree = name, _unpacked(b.column("tree")[r].as_py())
                asks = b.column("asks").slice(r, 1).flatten()
                q, ids, kth = _matrix(asks.field("v"), d), asks.field("query").to_numpy(), asks.field("kth").to_numpy()
                for own in _batches(q, p.batch):
                    got = tree.search(q[own], ids[own], kth[own], p.k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), _lists(*got, len(own))], ["query", "near"])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether a query has a shard left to visit."""
        names, low, high = known.value
        for b in batches:
            open_ = np.zeros(len(b), bool)
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                seen = part.column("seen").to_numpy()
                _, bound = _order(_matrix(part.column("v"), d), low, high, np.searchsorted(names, part.column("shard").to_numpy()))
                more = seen < len(names)
                open_[i : i + len(part)] = more & (bound[np.arange(len(part)), np.minimum(seen, len(names) - 1)] <= part.column("kth").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(open_)], [*b.schema.names, "open"])

    fields = f"query long, shard long, v array<double>, kth double, seen long, near {_NEAR}"
    while True:
        live = state.where("open") if turn else state
        asks = live.select("query", "shard", "v", "kth", "seen").mapInArrow(tidy(visits(width)), "shard long, query long, v array<double>, kth double")
        # a shard's queries come to it in rows of a bounded number
        asks = asks.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(blocks))).repartition(min(number, 100_000), "shard")
        asks = asks.groupBy("shard", "part").agg(F.collect_list(F.struct("query", "v", "kth")).alias("asks")).select("shard", "asks")
        found = trees.select("shard", "tree").join(asks.hint("shuffle_hash"), "shard").mapInArrow(tidy(search), f"query long, near {_NEAR}")
        merged = live.select("query", "near").unionByName(found).groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, p.k).alias("near"))
        kth = F.when(F.size("near") == p.k, F.element_at("near", -1)["d"]).otherwise(float("inf"))
        moved = live.drop("near", "kth", "open").join(merged, "query").select("query", "shard", "v", kth.alias("kth"), (F.col("seen") + width).alias("seen"), "near")
        now = moved.mapInArrow(tidy(left), fields + ", open boolean")
        state = at.save(now.unionByName(state.where("not open")) if turn else now, f"state{d}_{turn + 1}")
        at.drop(f"state{d}_{turn}")
        if state.where("open").isEmpty():
            at.drop(f"trees{d}")
            return state.select("query", "near")
        turn, width = turn + 1, min(2 * width, p.most) if turn else 1


def top_k(df: DataFrame, p: TopK = TopK(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance of the k nearest vectors of every query."""
    at = Scratch(df.sparkSession, "topk")
    if p.every < 1:
        raise ValueError("every must be positive")
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("id").isNotNull() & (F.size("v") > 0)).where(~bad)
    if not v.groupBy("id").count().where("count > 1").isEmpty():
        v = at.save(v.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    out = None
    for r in v.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        part = _same_length(v.where(F.size("v") == r["d"]), r["d"], r["count"], p, at)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank long, neighbor_id long, distance double")
    ranked = out.select("query", F.posexplode("near").alias("i", "x"))
    return ranked.select(F.col("query").alias("query_id"), (F.col("i") + 1).cast("long").alias("rank"), F.col("x.id").alias("neighbor_id"), F.round(F.sqrt("x.d"), 6).alias("distance"))
