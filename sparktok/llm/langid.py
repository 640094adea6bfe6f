"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary of byte pieces.

Each language has a probability for each piece. A word's probability is the sum over all ways to cut it into pieces of the
product of their probabilities, found by a forward pass; it stands with a blank before it, as in the vocabulary. The
probabilities are trained by expectation-maximisation (forward and backward passes) on all words of a bounded sample of
labelled rows; the vocabulary itself is never trained. All words of a block are worked on at once, column by column, and
a word that a batch holds many times is scored once. Words of more than ``LONG`` bytes are summed in logarithms, a block of
places at a time with the sums at its end carried on, so words of any length are summed whole.

A text goes to the language that gives its words the highest probability, of equals to the first by name. It is rejected
if it has no words, if the log probability per word is less than ``margin`` above the next language's, or if it is less
than ``floor`` per byte, so that no language explains it.

Nulls and odd cases: a null or empty text, or one without words, has no language and is rejected; a row without an id is
reported without one; rows that repeat an id are judged each; rows without a label aren't trained on. Without any labelled
row there are no languages and every text is rejected; with one language only ``floor`` rejects. Texts that several rows of
the sample share are trained on once. An empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import bound_batches, give_back, texts, tidy
from .windows import Members

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LONG = 31
#: Places of a long word that are summed at once.
STRETCH = 1 << 15


@dataclass(frozen=True)
class LangId:
    """sample: labelled texts per language that are trained on, at most. least: a piece's probability."""

    vocabulary: str = VOCABULARY
    sample: int = 1000
    iterations: int = 6
    least: float = 1e-8
    margin: float = 0.02
    floor: float = -6.0


def _hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pow_, inv = T._powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T._BYTE[data] * pow_[: len(data)], out=total[1:])
    return total, inv


class Pieces:
    """The vocabulary's pieces by hash, and the hashes of all their beginnings."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        self.longest = max(map(len, pieces))
        begin, whole = set(), []
        for p in pieces:
            h = 0
            for k, b in enumerate(p):
                h = (h + int(T._BYTE[b]) * pow(int(T._M), k, 1 << 64)) % (1 << 64)
                begin.add(h)
            whole.append(h)
        self.members = Members(np.array(whole, np.uint64))
        self.begin = Members(np.fromiter(begin, np.uint64, len(begin))).table
        self.size = len(self.members.values)

    def edges(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece, column) of every piece in words data[off[i]:off[i+1]], by column, its place in the word. From and to are boundaries; word i has off[i+1]-off[i]+1 of them from off[i]+i on."""
        total, inv = _hash(data)
        size = np.diff(off)
        word = np.repeat(np.arange(len(size)), size)
        start = np.arange(len(data))
        left = off[word + 1] - start
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            alive = left[start] >= n
            start = start[alive]
            if not len(start):
                break
            h = (total[start + n] - total[start]) * inv[start]
            alive = self.begin[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
            start, h = start[alive], h[alive]
            at, piece = self.members.find(h)
            out.append((start[at], start[at] + n, piece))
        s, e, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        column = (s - off[word[s]]).astype(np.int16)
        order = np.argsort(column, kind="stable")
        s, e, piece, column = s[order], e[order], piece[order], column[order]
        return s + word[s], e + word[s], piece, column


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _columns(column: np.ndarray) -> list[tuple[int, int]]:
    cut = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
    return list(zip(cut[:-1], cut[1:], strict=True)) if len(column) else []


def forward(edges: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], off: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over segmentations up to each boundary, and each word's whole. p[piece, language]."""
    s, e, piece, column = edges
    base = off + np.arange(len(off))
    alpha = np.zeros((int(base[-1]), p.shape[1]))
    alpha[base[:-1]] = 1
    for i, j in _columns(column):
        alpha[e[i:j]] += alpha[s[i:j]] * p[piece[i:j]]
    return alpha, alpha[base[1:] - 1]


def expected(edges: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], off: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """How often each piece is used, over all segmentations by their posterior; for one language."""
    s, e, piece, column = edges
    alpha, whole = forward(edges, off, p[:, None])
    base = off + np.arange(len(off))
    beta = np.zeros(len(alpha))
    beta[base[1:] - 1] = weight / whole[:, 0]
    for i, j in reversed(_columns(column)):
        np.add.at(beta, s[i:j], beta[e[i:j]] * p[piece[i:j]])
    return np.bincount(piece, alpha[s, 0] * p[piece] * beta[e], minlength=len(p))


def forward_logs(edges: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], base: np.ndarray, logp: np.ndarray, places: int) -> np.ndarray:
    """The logarithm of the sum over segmentations up to each boundary, where ``base`` are the words' first ones."""
    s, e, piece, column = edges
    alpha = np.full((places, logp.shape[1]), -np.inf)
    alpha[base] = 0
    for i, j in _columns(column):
        alpha[e[i:j]] = np.logaddexp(alpha[e[i:j]], alpha[s[i:j]] + logp[piece[i:j]])
    return alpha


def whole_log(v: Pieces, word: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The logarithm of one word's probability by language, a stretch of places at a time."""
    carried = np.full((v.longest + 1, logp.shape[1]), -np.inf)
    carried[0] = 0
    for i in range(0, len(word), STRETCH):
        part = word[i : i + STRETCH + v.longest]
        s, e, piece, column = v.edges(part, np.array([0, len(part)]))
        own = s < STRETCH
        alpha = np.full((len(part) + v.longest + 1, logp.shape[1]), -np.inf)
        alpha[: v.longest + 1] = carried
        s, e, piece = s[own], e[own], piece[own]
        for x, y in _columns(column[own]):
            alpha[e[x:y]] = np.logaddexp(alpha[e[x:y]], alpha[s[x:y]] + logp[piece[x:y]])
        last = min(STRETCH, len(part))
        carried = alpha[last : last + v.longest + 1]
    return carried[0]


def expected_log(v: Pieces, word: np.ndarray, logp: np.ndarray, weight: float) -> np.ndarray:
    """expected() of one long word, in logarithms."""
    edges = v.edges(word, np.array([0, len(word)]))
    s, e, piece, column = edges
    alpha = forward_logs(edges, np.array([0]), logp[:, None], len(word) + 1)[:, 0]
    beta = np.full(len(alpha), -np.inf)
    beta[-1] = 0
    for i, j in reversed(_columns(column)):
        np.logaddexp.at(beta, s[i:j], beta[e[i:j]] + logp[piece[i:j]])
    return weight * np.bincount(piece, np.exp(alpha[s] + logp[piece] + beta[e] - alpha[-1]), minlength=len(logp))


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words as bytes with a blank before each."""
    size = end - start + 1
    off = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(off[-1]), np.uint8)
    at = np.repeat(start - 1 - off[:-1], size) + np.arange(len(out))
    out[:] = data[np.maximum(at, 0)]
    out[off[:-1]] = 32
    return out, off


#: Words whose log probabilities a worker keeps, 8 bytes each and 8 a language; scored anew otherwise.
KEPT = 1 << 18


class Model:
    def __init__(self, p: LangId, languages: list[str], probability: np.ndarray):
        self.p, self.languages, self.probability = p, languages, probability
        self.logs = np.log(probability)
        self.known = np.zeros(0, np.uint64), np.zeros((0, len(languages)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": (np.zeros(0, np.uint64), np.zeros((0, len(self.languages))))}

    def words(self, w: T.Words, first: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The log probabilities of some different words by language. Those that occur more often than once are kept until there are too many, so a worker scores frequent words once."""
        keys, (have, kept) = w.hash[first], self.known
        out = np.empty((len(first), len(self.languages)))
        at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
        old = have[at] == keys if len(have) else np.zeros(len(keys), bool)
        out[old] = kept[at[old]]
        new = np.flatnonzero(~old)
        v, long = pieces(self.p.vocabulary), w.end[first[new]] - w.start[first[new]] > LONG
        short = new[~long]
        for i in range(0, len(short), 8_000):
            part = first[short[i : i + 8_000]]
            b, o = spaced(w.data, w.start[part], w.end[part])
            out[short[i : i + 8_000]] = np.log(forward(v.edges(b, o), o, self.probability)[1])
        for i in new[long]:
            b, _ = spaced(w.data, w.start[first[i : i + 1]], w.end[first[i : i + 1]])
            out[i] = whole_log(v, b, self.logs)
        new = new[often[new] > 1]
        if len(have) + len(new) > KEPT:
            have, kept = have[:0], kept[:0]
        new = new[:KEPT]
        have, kept = np.concatenate([have, keys[new]]), np.concatenate([kept, out[new]])
        order = np.argsort(have)
        self.known = have[order], kept[order]
        return out

    def score(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's log probability by language, its words and their bytes, blanks counted."""
        data, off = T.buffers(col)
        n, langs = len(col), len(self.languages)
        out, count, size = np.zeros((n, langs)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for r0, r1 in T.rows(off, 1 << 22):
            w = T.words(data[off[r0] : off[r1]], off[r0 : r1 + 1] - off[r0])
            count[r0:r1] = np.diff(w.off)
            size[r0:r1] = T.sums(w.end - w.start + 1, w.off)
            if not langs or not len(w.hash):
                continue
            code, _ = pd.factorize(w.hash)
            often = np.bincount(code)
            first = np.full(len(often), -1)
            first[code[::-1]] = np.arange(len(code))[::-1]
            logs = self.words(w, first, often)
            for k in range(langs):
                out[r0:r1, k] = T.sums(logs[code, k], w.off)
        return out, count, size

    def judge(self, col: pa.Array) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """Language, log probability per byte, margin per word, and whether it is accepted."""
        logs, count, size = self.score(col)
        if not self.languages:
            return [None] * len(col), np.zeros(len(col)), np.zeros(len(col)), np.zeros(len(col), bool)
        best = logs.argmax(1)
        top = logs[np.arange(len(logs)), best]
        rest = logs.copy()
        rest[np.arange(len(logs)), best] = -np.inf
        words = np.maximum(count, 1)
        margin = (top - rest.max(1)) / words if len(self.languages) > 1 else np.full(len(logs), self.p.margin)
        per = top / np.maximum(size, 1)
        ok = (count > 0) & (margin >= self.p.margin) & (per >= self.p.floor)
        return [self.languages[b] if c else None for b, c in zip(best.tolist(), count.tolist(), strict=True)], per, np.where(count > 0, margin, 0.0), ok


def fit(counts: dict[str, dict[bytes, int]], p: LangId) -> Model:
    """Trains on words by language."""
    v = pieces(p.vocabulary)
    languages = sorted(counts)
    out = np.full((v.size, len(languages)), p.least)
    for k, language in enumerate(languages):
        found = counts[language]
        short = [x for x in found if len(x) <= LONG]
        joined = np.frombuffer(b"".join(short), np.uint8)
        size = np.array([len(x) for x in short], np.int64)
        end = np.cumsum(size)
        b, off = spaced(joined, end - size, end) if len(size) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        weight = np.array([found[x] for x in short], float)
        long = [(np.frombuffer(b" " + x, np.uint8), float(n)) for x, n in found.items() if len(x) > LONG]
        # a few thousand words at a time, so that their pieces stay small in the driver
        blocks = []
        for i in range(0, len(weight), 5000):
            j = min(i + 5000, len(weight))
            o = off[i : j + 1] - off[i]
            blocks.append((b[off[i] : off[j]], o, weight[i:j]))
        own = np.full(v.size, 1 / v.size)
        for _ in range(p.iterations):
            c = sum((expected(v.edges(x, o), o, own, n) for x, o, n in blocks), np.zeros(v.size))
            if long:
                logs = np.log(own)
                for x, n in long:
                    c += expected_log(v, x, logs, n)
            own = np.maximum(c / c.sum(), p.least)
        out[:, k] = own
    return Model(p, languages, out)


def train(df: DataFrame, p: LangId = LangId(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the languages in lang_col. The texts with the smallest hashes are the sample."""
    docs = texts(df, id_col, text_col, lang_col).where("c0 is not null").select(F.col("c0").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text")
    # a task keeps the first ``sample`` hashes of a language only: ranks are cut before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = docs.select("lang", "h").distinct().withColumn("rank", rank).where(f"rank <= {p.sample}").groupBy("lang").agg(F.max("h").alias("last")).collect()
    if not last:
        return Model(p, [], np.zeros((0, 0)))
    limit = F.element_at(F.create_map(*(F.lit(x) for r in last for x in (r["lang"], r["last"]))), F.col("lang"))
    sample = docs.where(F.col("h") <= limit).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.buffers(b.column("text"))
            lang = b.column("lang").to_pylist()
            found: dict[tuple[str, bytes], int] = {}
            for r0, r1 in T.rows(off):
                w = T.words(data[off[r0] : off[r1]], off[r0 : r1 + 1] - off[r0])
                raw = w.data.tobytes()
                for r in range(r0, r1):
                    for i in range(int(w.off[r - r0]), int(w.off[r - r0 + 1])):
                        key = (lang[r], raw[w.start[i] : w.end[i]])
                        found[key] = found.get(key, 0) + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found], pa.binary()), pa.array([*found.values()], pa.int64())], ["lang", "word", "n"])

    words = sample.select("text", "lang").mapInArrow(tidy(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {r["lang"]: {} for r in last}
    got = words.toArrow()
    for lang, word, n in zip(*(got[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][word] = n
    # a language whose texts have no words can't be told
    counts = {lang: own for lang, own in counts.items() if own}
    return fit(counts, p)


def language_id(df: DataFrame, p: LangId = LangId(), model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, score (log probability per byte), margin, accepted of every text. Without a model one is trained on df."""
    own = df.sparkSession.sparkContext.broadcast(model or train(df, p, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, margin, ok = own.value.judge(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(margin), pa.array(ok)], ["doc_id", "lang", "score", "margin", "accepted"])

    return texts(df, id_col, text_col).mapInArrow(tidy(run), "doc_id long, lang string, score double, margin double, accepted boolean")


def keep_known_languages(df: DataFrame, p: LangId = LangId(), model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of df whose text is accepted; decided row by row, so nothing is shuffled."""
    own = df.sparkSession.sparkContext.broadcast(model or train(df, p, id_col, text_col, lang_col))

    bound_batches(df.sparkSession)

    @F.arrow_udf("boolean")
    def accepted(col: pa.Array) -> pa.Array:
        ok = own.value.judge(col)[3]
        give_back()
        return pa.array(ok)

    return df.where(accepted(F.coalesce(F.lower(F.col(text_col)), F.lit(""))))
