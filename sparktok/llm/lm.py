"""LM scoring by deleted interpolation of word n-grams, whose number grows with the table.

A text is cut into tokens with nothing left out: a word with the signs before it, and what follows the last word; an end
token is predicted too. The maximum-likelihood estimates of the orders 1 to n are mixed with the uniform distribution over
all tokens of the table, by weights for each power of two of the longest context's count. A document is scored by the
counts of all others: its own are deleted, so copies of it tell, and no document is in a training set of its own. The
weights are learned by expectation-maximisation on the documents whose id hashes into one of ``folds`` parts.

1. Texts are laid out in *chunks* of about ``chunk`` bytes, in a table bucketed by chunk. A chunk's distinct n-grams are
   sorted by hash and cut into as many *parts* as the table has ``part`` bytes, each a blob of hash differences and counts:
   3 to 4 bytes an n-gram instead of some 50 as rows. Blobs go to their parts, one shuffle; an n-gram is once in a
   chunk's blob however frequent it is, so no key is hot.
2. A part adds up its n-grams and answers each blob with totals in the blob's own order: a byte or less each, no keys.
   Answers go back to their chunks by one shuffle; the bucketed texts don't move.
3. A chunk has then every count that its n-grams need. Held-out documents give the events to learn from, numbers of
   (bucket, estimates), estimates rounded to an eighth of a power of two; each round is one aggregation of that table.
4. All documents are scored by exact estimates.

Hashes have ``spare`` bits more than the number of n-grams needs, so one in 2^spare n-grams is confused with another.
An empty blob isn't sent, so there are never more blobs than n-grams. They shrink as the table grows, chunks times parts being
many: raise both sizes with the workers' memory where tables are far larger.

Nulls and odd cases: a null or empty text has no tokens, the log probability 0 and no bits per byte (null); it counts for
nothing. A row without an id counts, and is reported without one; rows that repeat an id are documents of their own, each.
Where nothing is held out the weights stay equal. An empty table gives no rows. Only the columns named are read. Texts are
lowered; n_bytes is the lowered text's.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, texts, tidy


@dataclass(frozen=True)
class DeletedInterpolation:
    """order: tokens in an n-gram, 6 at most. folds: one part in so many is learned from. iterations: of expectation-maximisation. buckets: of context counts, the last without end; 32 at most. tasks: that parts are answered in, at most; a task takes its parts one after the other."""

    order: int = 3
    folds: int = 10
    iterations: int = 8
    buckets: int = 24
    chunk: int = 6 << 20
    part: int = 16 << 20
    spare: int = 20
    tasks: int = 20_000


END = T.mix(np.array([0xE0D], np.uint64))[0]


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token of texts data[off[i]:off[i+1]], and the texts' tokens as offsets."""
    ends = np.zeros(len(data) + 1, bool)
    ends[T.words(data, off).end] = True
    ends[off[1:][np.diff(off) > 0]] = True
    end = np.flatnonzero(ends)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)[: len(end)]
    out = np.empty(len(end), np.uint64)
    i = 0
    while i < len(end):
        j = max(i + 1, int(np.searchsorted(end, start[i] + T.BLOCK, "right")))
        part = data[start[i] : end[j - 1]]
        pow_, inv = T._powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(T._BYTE[part] * pow_[: len(part)], out=total[1:])
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        out[i:j] = T.mix((total[e] - total[s]) * inv[s])
        i = j
    return out, np.searchsorted(start, off)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """np.unique of unsigned keys with its inverse and counts. A key's high bits and its place are sorted as one number, which is several times as fast as sorting places."""
    n = len(key)
    if not n:
        return key, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = (n - 1).bit_length()
    low = np.uint64(max(0, int(key.max()).bit_length() + place - 64))
    both = key >> low
    both <<= np.uint64(place)
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    at = (both & np.uint64((1 << place) - 1)).view(np.int64)
    s = key[at]
    if low and (s[1:] < s[:-1]).any():
        # keys that differ in the low bits only: few, so this sort finds long runs
        again = np.argsort(s, kind="stable")
        at, s = at[again], s[again]
    first = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=first[1:])
    which = np.empty(n, np.int64)
    which[at] = np.cumsum(first) - 1
    start = np.flatnonzero(first)
    return s[start], which, np.diff(start, append=n)


class Grams:
    """The n-grams of some texts. Each text that has tokens gives a row of positions: one before it, its tokens, its end."""

    def __init__(self, col: pa.Array, p: DeletedInterpolation, bits: int):
        self.p = p
        data, off = T.buffers(col)
        h, o = tokens(data, off)
        self.bytes, self.tokens = np.diff(off), np.diff(o)
        some = self.tokens > 0
        size = np.where(some, self.tokens + p.order + 1, 0)
        base = np.concatenate([[0], np.cumsum(size)])
        padded = np.zeros(int(base[-1]), np.uint64)
        padded[np.arange(len(h)) + np.repeat(base[:-1] + p.order - o[:-1], self.tokens)] = h
        padded[(base[1:] - 1)[some]] = END
        text = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(np.arange(len(padded)) - base[:-1][text] >= p.order - 1)
        self.text = text[at]
        #: positions by text; the first of each is before it
        self.off = np.concatenate([[0], np.cumsum(np.where(some, self.tokens + 2, 0))])
        self.key: list[np.ndarray] = []
        self.which: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        total = np.zeros(len(at), np.uint64)
        for j in range(p.order):
            total = total + padded[at - j] * T._COEF[j]
            key, which, count = distinct(T.mix(total + np.uint64(j)) >> np.uint64(64 - bits))
            self.key.append(key)
            self.which.append(which)
            self.count.append(count)

    def own(self, j: int) -> np.ndarray:
        """How often each position's n-gram is in its own text."""
        out = np.ones(len(self.text), np.int64)
        more = np.flatnonzero(self.count[j][self.which[j]] > 1)
        if len(more):
            pair = self.which[j][more].astype(np.int64) * (len(self.off) - 1) + self.text[more]
            _, back, n = distinct(pair.view(np.uint64))
            out[more] = n[back]
        return out


def pack(v: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed."""
    v = np.ascontiguousarray(v, np.uint64)
    width = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    body = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
    return struct.pack("<QBQ", len(v), width, len(body)) + body


def unpack(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers packed at a place, and the place behind."""
    n, width, size = struct.unpack_from("<QBQ", raw, at)
    at += 17
    out = np.zeros((n, 8), np.uint8)
    if n * width:
        out[:, :width] = np.frombuffer(pa.decompress(raw[at : at + size], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel(), at + size


def _bounds(parts: int, bits: int) -> np.ndarray:
    return np.array([(q << bits) // parts for q in range(parts)], np.uint64)


def _chunks(p: DeletedInterpolation):
    """Rows of one chunk each: its number, whether it is held out, its ids and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        kept: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(flag: bool) -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(kept[flag]).combine_chunks()
            one = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t[c].combine_chunks()) for c in ("id", "text")]
            made += 1
            kept[flag], size[flag] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([first + made - 1]), *one, pa.array([flag])], ["chunk", "ids", "texts", "held"])

        for b in batches:
            held = b.column("held").to_numpy(zero_copy_only=False)
            length = np.diff(T.buffers(b.column("text"))[1])
            own = b.select(["id", "text"])
            for flag in (False, True):
                rows = np.flatnonzero(held == flag)
                if not len(rows):
                    continue
                # cut where a chunk is full
                block = (np.cumsum(length[rows]) + size[flag]) // p.chunk
                for k in np.split(rows, np.flatnonzero(np.diff(block)) + 1):
                    kept[flag].append(own.take(pa.array(k)))
                    size[flag] += int(length[k].sum())
                    if size[flag] >= p.chunk:
                        yield flush(flag)
        for flag in (False, True):
            if kept[flag]:
                yield flush(flag)

    return run


def _count(p: DeletedInterpolation, bits: int, parts: int):
    """A blob for each part of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(parts, bits)
        for b in batches:
            for k in range(len(b)):
                g = Grams(b.column("texts").slice(k, 1).flatten(), p, bits)
                cut = [np.append(np.searchsorted(x, bounds), len(x)) for x in g.key]
                # the first part's goes always: it has the number of texts, and a chunk without n-grams needs an answer too
                some = np.union1d(np.flatnonzero(sum(np.diff(x) for x in cut)), [0]).astype(np.int64)
                blobs = []
                for q in some.tolist():
                    blob = []
                    for j in range(p.order):
                        s, e = cut[j][q], cut[j][q + 1]
                        blob += [pack(np.diff(g.key[j][s:e], prepend=bounds[q])), pack(g.count[j][s:e])]
                    blobs.append(b"".join(blob))
                docs = np.zeros(len(some), np.int64)
                docs[0] = (g.tokens > 0).sum()
                chunk = b.column("chunk")[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), chunk)), pa.array(docs), pa.array(blobs, pa.binary())], ["part", "chunk", "docs", "blob"])

    return run


def _answer(p: DeletedInterpolation):
    """The totals of the n-grams of each part, from sorted rows, for each chunk in its blob's order; and how many tokens there are, in all and different, padding counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not len(b):
                continue
            part = b.column("part").to_numpy()
            at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for s, e in zip(at[:-1], at[1:], strict=True):
                if held and part[s] != last:
                    yield from one(held)
                    held = []
                held.append(b.slice(s, e - s))
                last = part[s]
        if held:
            yield from one(held)

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        raws = t["blob"].to_pylist()
        answers: list[list[bytes]] = [[] for _ in raws]
        at = [0] * len(raws)
        kinds = number = 0
        for j in range(p.order):
            keys, counts = [], []
            for r, raw in enumerate(raws):
                d, at[r] = unpack(raw, at[r])
                n, at[r] = unpack(raw, at[r])
                keys.append(np.cumsum(d, dtype=np.uint64))
                counts.append(n)
            off = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            key, which, _ = distinct(np.concatenate(keys))
            total = np.bincount(which, np.concatenate(counts), len(key)).astype(np.uint64)
            if j == 0:
                kinds, number = len(key), int(total.sum())
            each = total[which]
            for r in range(len(raws)):
                answers[r].append(pack(each[off[r] : off[r + 1]]))
        once = np.zeros((2, len(raws)), np.int64)
        once[:, 0] = kinds, number
        out = pa.table([t["chunk"], t["part"], t["docs"], pa.array(once[0]), pa.array(once[1]), pa.array([b"".join(x) for x in answers], pa.binary())], ["chunk", "part", "docs", "kinds", "number", "answer"])
        yield from out.to_batches()

    return run


def _estimates(g: Grams, answers: list[dict], number: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Count of the longest context, and the estimates of all orders, of each predicted token; the text's own counts deleted."""
    p = g.p
    raws = [x["answer"] for x in sorted(answers, key=lambda x: x["part"])]
    at = [0] * len(raws)
    before = None
    first = np.zeros(len(g.text), bool)
    first[g.off[:-1][np.diff(g.off) > 0]] = True
    to = np.flatnonzero(~first)
    out: list[np.ndarray] = []
    context = number - (g.tokens + 1)[g.text[to]]
    for j in range(p.order):
        own = []
        for r, raw in enumerate(raws):
            n, at[r] = unpack(raw, at[r])
            own.append(n)
        left = np.concatenate(own).astype(np.int64)[g.which[j]] - g.own(j)
        if before is not None:
            context = before[to - 1]
        out.append(np.where(context > 0, np.minimum(left[to] / np.maximum(context, 1), 1.0), 0.0))
        before = left
    return context, out


def _buckets(context: np.ndarray, p: DeletedInterpolation) -> np.ndarray:
    return np.where(context > 0, np.minimum(p.buckets - 1, 1 + np.floor(np.log2(np.maximum(context, 1) + 0.5))), 0).astype(np.int64)


#: Steps to a power of two that estimates are rounded to for learning, and bits for their number of steps.
STEPS, WIDTH = 8, 9


def _events(p: DeletedInterpolation, bits: int, number: int):
    """(cell, n): how often each bucket with each row of rounded estimates was seen in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                g = Grams(b.column("texts").slice(k, 1).flatten(), p, bits)
                context, f = _estimates(g, b.column("answers")[k].as_py(), number)
                cell = _buckets(context, p)
                for x in f:
                    step = np.where(x > 0, 1 + np.clip(np.round(-STEPS * np.log2(np.maximum(x, 1e-300))), 0, (1 << WIDTH) - 2), 0)
                    cell = cell << WIDTH | step.astype(np.int64)
                cell, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    return run


def _scores(p: DeletedInterpolation, bits: int, number: int, kinds: int, weights: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for b in batches:
            for k in range(len(b)):
                g = Grams(b.column("texts").slice(k, 1).flatten(), p, bits)
                context, f = _estimates(g, b.column("answers")[k].as_py(), number)
                bucket = _buckets(context, p)
                chance = w[bucket, 0] / max(kinds, 1)
                for j, x in enumerate(f):
                    chance += w[bucket, j + 1] * x
                n = np.where(g.tokens > 0, g.tokens + 1, 0)
                total = T.sums(np.log(chance), np.concatenate([[0], np.cumsum(n)]))
                bits_ = pa.array(-total / np.maximum(g.bytes, 1) / math.log(2), mask=g.bytes == 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids").slice(k, 1).flatten(), pa.array(g.bytes), pa.array(n), pa.array(total / np.maximum(n, 1)), bits_],
                    ["doc_id", "n_bytes", "n_tokens", "logprob", "bits_per_byte"],
                )

    return run


def _mixed(p: DeletedInterpolation, weights: list[list[float]], size: float) -> list[Column]:
    """The weighted estimate of each order, the uniform one over ``size`` symbols first."""
    b = F.col("bucket")
    table = [F.element_at(F.array(*(F.lit(w[k]) for w in weights)), b + 1) for k in range(p.order + 1)]
    return [table[0] / size, *(table[k] * F.col(f"f{k}") for k in range(1, p.order + 1))]


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def learn(rows: DataFrame, p: DeletedInterpolation, size: float) -> list[list[float]]:
    """The mixture weights of each bucket, from held-out counts. rows: bucket, held, f1 to fn."""
    weights = [[1 / (p.order + 1)] * (p.order + 1) for _ in range(p.buckets)]
    for _ in range(p.iterations):
        parts = _mixed(p, weights, size)
        shared = [x * F.col("held") / F.col("total") for x in parts]
        got = rows.withColumn("total", _total(parts)).groupBy("bucket").agg(*(F.sum(x).alias(f"r{k}") for k, x in enumerate(shared))).collect()
        for r in got:
            mass = sum(r[f"r{k}"] for k in range(p.order + 1))
            if mass > 0:
                # the uniform part never goes, so nothing has the probability 0
                own = [max(r[f"r{k}"] / mass, 1e-6 if k == 0 else 0.0) for k in range(p.order + 1)]
                weights[r["bucket"]] = [x / sum(own) for x in own]
    return weights


def lm_scores(df: DataFrame, p: DeletedInterpolation = DeletedInterpolation(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, logprob (natural, the mean of a token), bits_per_byte of every text, under the model of all others."""
    if not (1 <= p.order <= 6 and p.buckets <= 32):
        raise ValueError("order must be 1 to 6, and buckets 32 at most")
    at = Scratch(df.sparkSession, "lm")
    docs = texts(df, id_col, text_col).select("id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.pmod(F.xxhash64("id"), F.lit(p.folds)) == 0, F.lit(False)).alias("held"))
    size = int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    parts = max(1, math.ceil(size / p.part))
    bits = min(64, max(1, (size * p.order).bit_length()) + p.spare)
    # 32 MB of text to a task, and tasks enough for all cores where texts aren't tiny
    tasks = max(math.ceil(size / (32 << 20)), min(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / (1 << 20))), 1)
    tasks = min(tasks, 100_000)
    chunks = at.bucketed(docs.mapInArrow(tidy(_chunks(p)), "chunk long, ids array<long>, texts array<string>, held boolean"), "chunks", "chunk", tasks, "held")
    blobs = chunks.select("chunk", "texts").mapInArrow(tidy(_count(p, bits, parts)), "part long, chunk long, docs long, blob binary")
    # by hash, some tasks would have several parts and others none
    among = min(parts, p.tasks)
    sent = blobs.repartitionById(among, F.pmod("part", F.lit(among)).cast("int")).sortWithinPartitions("part")
    answers = at.save(sent.mapInArrow(tidy(_answer(p)), "chunk long, part long, docs long, kinds long, number long, answer binary"), "answers")
    seen = answers.agg(F.sum("kinds"), F.sum("number"), F.sum("docs")).first()
    # the padding before texts is a kind of token of its own, once a text
    kinds, number = (seen[0] or 1) - 1, (seen[1] or 0) - (seen[2] or 0)
    # laid out as the bucketed chunks are, so one shuffle serves both the grouping and the joins
    whole = answers.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("part", "answer")).alias("answers"))

    def answered(these: DataFrame) -> DataFrame:
        # answers are the smaller side; a hash join spares sorting the texts
        return these.join(whole.hint("shuffle_hash"), "chunk").select("ids", "texts", "answers")

    cells = answered(chunks.where("held")).mapInArrow(tidy(_events(p, bits, number)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("held"))
    cells = at.save(cells, "cells")
    step = lambda k: F.shiftright("cell", WIDTH * (p.order - k)).bitwiseAND(F.lit((1 << WIDTH) - 1))
    estimates = [F.when(step(k) > 0, F.pow(F.lit(2.0), (1 - step(k)) / STEPS)).otherwise(0.0).alias(f"f{k}") for k in range(1, p.order + 1)]
    weights = learn(cells.select(F.shiftright("cell", WIDTH * p.order).cast("int").alias("bucket"), "held", *estimates), p, float(max(kinds, 1)))
    scored = answered(chunks).mapInArrow(tidy(_scores(p, bits, number, kinds, weights)), "doc_id long, n_bytes long, n_tokens long, logprob double, bits_per_byte double")
    scored = at.save(scored, "scores")
    at.drop("chunks", "answers", "cells")
    return scored
