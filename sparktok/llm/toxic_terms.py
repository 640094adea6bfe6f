"""Terms of the toxicity lexicon learned from labelled documents: whole words, and stems that words begin with.

At most ``sample`` labelled documents are read, those with the smallest hashes of their ids; a text that several of them
have counts once. Words are in the search form of toxicity.py. A term is a word, or its first ``shortest`` to ``longest``
letters. Terms are chosen one by one: the one whose presence tells toxic documents that no chosen term explains from clean
ones best, by the log-likelihood ratio G², of those that reach ``gain`` among all, until none still reaches it; so what merely stands beside a toxic term, as in
copies, isn't chosen. A term's weight is the threshold over the rate at which a Poisson model is undecided between toxic and
clean documents that have the term, so terms that clean documents have as well count for less; ``most`` at most.

Nulls and odd cases: labels without an id or a value, and documents that are null or without words, are left out; an id
with several labels is toxic if one of them is, an id with several texts has the smallest. Without documents of both
kinds nothing is learned. Only the columns named are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, texts, tidy
from .toxicity import GAP, OTHER, fold


@dataclass(frozen=True)
class Learning:
    """sample: labelled documents at most. shortest, longest: letters of a term. least: toxic documents that have it. gain: G² that a term adds. most: a term's weight at most."""

    sample: int = 4000
    shortest: int = 4
    longest: int = 24
    least: int = 3
    gain: float = 20.0
    most: float = 10.0


#: After a term that is a whole word; a term without it is a stem.
WHOLE = "$"


def terms_of(words: Counter[bytes], p: Learning) -> Counter[bytes]:
    """How often each term occurs among some words."""
    out: Counter[bytes] = Counter()
    for w, n in words.items():
        if OTHER in w:
            continue
        if p.shortest <= len(w) <= p.longest:
            out[w + WHOLE.encode()] += n
        for k in range(p.shortest, min(len(w), p.longest) + 1):
            out[w[:k]] += n
    return out


def _read(p: Learning, only: frozenset[bytes] | None):
    """term, toxic, clean: documents that have it, of a batch; or, of the terms wanted, doc, toxic, term, n, with the number of words under the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column("toxic").to_pylist()
            docs = b.column("doc").to_pylist()
            data, boff = T.buffers(b.column("text"))
            total: Counter[tuple[bytes, int]] = Counter()
            rows: list[tuple[int, int, bytes, int]] = []
            for r0, r1 in T.rows(boff):
                code, _, off, words = fold(data[boff[r0] : boff[r1]], boff[r0 : r1 + 1] - boff[r0])
                raw = code.tobytes()
                for r in range(r0, r1):
                    have = terms_of(Counter(raw[off[r - r0] : off[r - r0 + 1]].split(bytes([GAP]))[1:-1]), p)
                    if only is None:
                        total.update((t, toxic[r]) for t in have)
                    else:
                        rows += [(docs[r], toxic[r], b"", int(words[r - r0])), *((docs[r], toxic[r], t, have[t]) for t in have.keys() & only)]
            if only is None:
                keys = [*dict.fromkeys(t for t, _ in total)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([total[t, x] for t in keys], pa.int64()) for x in (1, 0))], ["term", "toxic", "clean"])
            elif rows:
                d, x, t, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(x, pa.int64()), pa.array(t, pa.binary()), pa.array(n, pa.int64())], ["doc", "toxic", "term", "n"])

    return run


def gain(a: np.ndarray, b: np.ndarray, toxic: int | np.ndarray, clean: int) -> np.ndarray:
    """G² of the presence of terms that ``a`` of the toxic and ``b`` of the clean documents have; 0 where toxic ones don't have it more often."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, k = toxic + clean, a + b

    def part(x: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)

    g = 2 * (part(a, k * toxic / n) + part(b, k * clean / n) + part(toxic - a, (n - k) * toxic / n) + part(clean - b, (n - k) * clean / n))
    return np.where(a * clean > b * toxic, g, 0.0)


def choose(rows: list[tuple[int, int, bytes, int]], threshold: float, p: Learning) -> dict[str, float]:
    """Weights of the chosen terms. rows: doc, toxic, term, times it occurs; with each document's words under the empty term."""
    docs = sorted({(d, x) for d, x, t, _ in rows if not t})
    number = {d: i for i, (d, _) in enumerate(docs)}
    toxic = np.array([x for _, x in docs], bool)
    words = np.zeros(len(docs))
    # of terms that are equal in all, the longest, then the first by name, is chosen
    terms = sorted({t for _, _, t, _ in rows if t}, key=lambda t: (-len(t), t))
    code = {t: i for i, t in enumerate(terms)}
    for d, _, t, n in rows:
        if not t:
            words[number[d]] = n
    own = np.array([(number[d], code[t], n) for d, _, t, n in rows if t], np.int64).reshape(-1, 3)
    doc, term, times = own.T
    clean, live, out = int((~toxic).sum()), toxic.copy(), {}
    if not len(terms) or not clean:
        return {}
    b = np.bincount(term[~toxic[doc]], minlength=len(terms))
    while True:
        a = np.bincount(term[live[doc]], minlength=len(terms))
        g = np.where(a >= p.least, np.round(gain(a, b, int(live.sum()), clean), 6), 0.0)
        best = int(g.argmax())
        if g[best] < p.gain:
            return out
        here = term == best
        live[doc[here]] = False
        w = _weight(times[here], words[doc[here]], toxic[doc[here]], float(words[~toxic].sum()), threshold)
        if w > 0:
            out[terms[best].decode()] = round(min(w, p.most), 3)


def _weight(times: np.ndarray, words: np.ndarray, toxic: np.ndarray, clean_words: float, threshold: float) -> float:
    high = 1000 * times[toxic].sum() / words[toxic].sum()
    low = 1000 * times[~toxic].sum() / words[~toxic].sum() if (~toxic).any() else 1000 * 0.5 / clean_words
    return float(threshold * math.log(high / low) / (high - low)) if high > low else 0.0


def learn(df: DataFrame, labels: DataFrame, threshold: float, p: Learning = Learning(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """The weights of terms by their search forms; those of whole words end with WHOLE."""
    at = Scratch(df.sparkSession, "toxic_terms")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(p.sample)
    drawn = at.save(known, "labels")
    docs = texts(df, id_col, text_col).where("text is not null")
    # a broadcast of at most ``sample`` rows: the texts themselves are not shuffled
    held = docs.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    held = at.save(held.groupBy("text").agg(F.max("toxic").alias("toxic")).select(F.xxhash64("text").alias("doc"), "toxic", "text").repartition(16), "sample")
    size = held.groupBy("toxic").count().collect()
    many = {r["toxic"]: r["count"] for r in size}
    if len(many) < 2:
        return {}
    counts = held.mapInArrow(tidy(_read(p, None)), "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    likely = counts.where(F.col("a") >= p.least).toArrow()
    a, b = (likely[c].to_numpy() for c in "ab")
    hopeful = gain(a, b, many[1], many[0]) >= p.gain
    only = frozenset(t for t, ok in zip(likely["term"].to_pylist(), hopeful.tolist(), strict=True) if ok)
    rows = held.mapInArrow(tidy(_read(p, only)), "doc long, toxic long, term binary, n long").toArrow()
    found = choose([*zip(*(rows[c].to_pylist() for c in ("doc", "toxic", "term", "n")), strict=True)], threshold, p)
    at.drop("labels", "sample")
    return found
