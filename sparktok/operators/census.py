"""Which tokens of a vocabulary can come out of the encoder at all: a witness text, a reason why not, or neither.

Tokens are judged apart from each other, so the census is one pass over the tokens in as many tasks as wanted. The first
of these that holds is the verdict: the token is an added one; its bytes alone don't merge into it, so nothing does
(impossible, merge-order); its text encodes to it (self); no pretoken can hold its bytes (impossible, with a reason); a
text around it is found whose encoding has it (context). Whatever is left is unresolved.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes_path import encode_binary
from ..functions.unicode_pins import BARRIERS, NL, L, N, S, char_class
from .vocab import Vocab

LONGEST = 320
#: What one character can be: letter, number, blank, other white space, line break, all else.
LETTER, NUMBER, BLANK, WHITE, BREAK, OTHER = 1, 2, 4, 8, 16, 32
SCHEMA = "id int, hex string, text string, verdict string, reason string, witness_hex string, search_bound int"


@cache
def _units() -> tuple[np.ndarray, np.ndarray]:
    """For every codepoint: what it is, 0 for surrogates; and whether NFC text can hold it."""
    unit, stays = np.zeros(0x110000, np.uint8), np.ones(0x110000, bool)
    newer = {c for a, b in BARRIERS for c in range(a, b + 1)}
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        k = char_class(cp)
        unit[cp] = BLANK if cp == 32 else BREAK if k & NL else WHITE if k & S else LETTER if k == L else NUMBER if k == N else OTHER
        if cp > 0x2FF and cp not in newer and unicodedata.normalize("NFC", chr(cp)) != chr(cp):
            stays[cp] = False
    return unit, stays


def _length(lead: int) -> int:
    """Bytes of a character that begins so; 0 if none does."""
    return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def _rest(data: bytes) -> bool:
    return all(b & 0xC0 == 0x80 for b in data)


def _gather(cps: list[np.ndarray]) -> tuple[int, bool]:
    """The union of what some codepoints are, and whether none of them is ever in NFC text."""
    unit, stays = _units()
    own = np.concatenate(cps) if cps else np.zeros(0, np.int64)
    own = own[unit[own] > 0]
    return (int(np.bitwise_or.reduce(unit[own])) if len(own) else 0), bool(len(own)) and not stays[own].any()


@cache
def _ends_with(tail: bytes) -> tuple[int, bool]:
    """All characters whose encoding ends with these continuation bytes, and has more before them."""
    low = 0
    for b in tail:
        low = low << 6 | b & 63
    step, found = 1 << 6 * len(tail), []
    for size, a, z in ((2, 0x80, 0x7FF), (3, 0x800, 0xFFFF), (4, 0x10000, 0x10FFFF)):
        if size > len(tail):
            first = a + (low - a) % step
            found.append(np.arange(first, z + 1, step))
    return _gather(found)


@cache
def _begins_with(head: bytes) -> tuple[int, bool]:
    """All characters whose encoding begins with these bytes, and has more behind them."""
    size = _length(head[0])
    if size <= len(head) or not _rest(head[1:]):
        return 0, False
    value = head[0] & (0x7F >> size)
    for b in head[1:]:
        value = value << 6 | b & 63
    bits = 6 * (size - len(head))
    least = {2: 0x80, 3: 0x800, 4: 0x10000}[size]
    a, z = max(value << bits, least), min((value + 1 << bits) - 1, 0x10FFFF)
    return _gather([np.arange(a, z + 1)] if a <= z else [])


def _alignment(data: bytes, lead: int) -> tuple[list[int], bool] | None:
    """What the characters are if the first ``lead`` bytes end one that began before; None if that can't be. Also whether one of them is never in NFC text."""
    unit, stays = _units()
    out, excluded = [], False
    if lead:
        bits, never = _ends_with(data[:lead]) if _rest(data[:lead]) else (0, False)
        if not bits:
            return None
        out.append(bits)
        excluded |= never
    i = lead
    while i < len(data):
        size = _length(data[i])
        if not size:
            return None
        part = data[i : i + size]
        if len(part) == size:
            try:
                cp = ord(part.decode())
            except UnicodeDecodeError:
                return None
            out.append(int(unit[cp]))
            excluded |= not stays[cp]
        else:
            bits, never = _begins_with(part)
            if not bits:
                return None
            out.append(bits)
            excluded |= never
        i += size
    return (out, excluded) if out else None


def _fits(units: list[int]) -> bool:
    """Whether the characters can lie within one pretoken: letters behind one other character at most, one number, a blank and signs and line breaks, or white space."""
    every = lambda own, kind: all(u & kind for u in own)
    space = BLANK | WHITE | BREAK
    if every(units, LETTER) or every(units, space):
        return True
    if len(units) == 1:
        return bool(units[0] & (NUMBER | BLANK | WHITE | OTHER))
    if units[0] & (BLANK | WHITE | OTHER) and every(units[1:], LETTER):
        return True
    i = k = 1 if units[0] & BLANK else 0
    while i < len(units) and units[i] & OTHER:
        i += 1
    return i > k and every(units[i:], BREAK)


def _contraction(data: bytes) -> bool:
    """An apostrophe, a contraction's letters, and more letters: the contraction always comes off first."""
    if data[:1] != b"'":
        return False
    text = data[1:].decode("utf-8", "replace")
    folded = text.lower().replace("ſ", "s")
    size = next((len(s) for s in ("s", "t", "m", "d", "re", "ve", "ll") if folded.startswith(s)), 0)
    return 0 < size < len(text) and all(char_class(ord(c)) == L for c in text[size:])


def prove_impossible(data: bytes) -> str | None:
    """Why no pretoken can hold these bytes; None if one may."""
    if _contraction(data):
        return "contraction"
    aligned, fitting = False, False
    for lead in range(min(4, len(data))):
        got = _alignment(data, lead)
        if got:
            aligned = True
            if _fits(got[0]):
                if not got[1]:
                    return None
                fitting = True
    if fitting:
        return "nfc-excluded"
    if len(data) <= 3 and _rest(data):
        return None  # may lie inside one character
    return "pretoken-shape" if aligned else "invalid-utf8"


_PADS = (0x80, 0x90, 0x9F, 0xA0, 0xB0, 0xBF)
_LEADS = (0xC2, 0xC5, 0xD0, 0xE0, 0xE1, 0xE3, 0xE5, 0xEC, 0xED, 0xF0, 0xF1, 0xF4)
QUICK = tuple(x.encode() for x in ("", "q", "Z", "m", "K", "7", " ", ",", ":", "?", "\n", "’", "'", "ö", "語", "=", "+", ")")) + (b"\xc5", b"\xe5\xad", b"\xe7\x94", b"\xa8", b"\xbf", b"\xad\x97", b"\x84\xa1", b"\x9f\x8e\x89")
DEEP = QUICK + tuple(x.encode() for x in ("o", "n", "i", "r", "E", "S", "4", "  ", "\t", "\r\n", "\n\n", " \n", ".", ";", "!", "\"", "`", "{", "]", "\\", "*", "%", "ж", "β", "ñ", "か", "한", " ")) + (b"\xd0", b"\xe3\x81", b"\xec", b"\xf0\x9f", b"\xf0\x9f\x8e", b"\xb6", b"\x90\xbe")


def _glue(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Texts around bytes that begin or end within a character, made to complete it."""
    for k in range(min(3, len(data)) + 1):
        if not _rest(data[:k]):
            break
        i = k
        while i < len(data) and 0 < _length(data[i]) <= len(data) - i:
            i += _length(data[i])
        behind = 0
        if i < len(data):
            size = _length(data[i])
            if not size or not _rest(data[i + 1 :]):
                continue
            behind = size - (len(data) - i)
        before = [bytes([lead]) + bytes([p]) * (_length(lead) - 1 - k) for lead in _LEADS for p in _PADS if _length(lead) > k] if k else [b""]
        after = [bytes([p]) * behind for p in _PADS] if behind else [b""]
        yield from ((a, b) for a, b in product(dict.fromkeys(before), after) if a or b)
    if len(data) <= 2 and _rest(data):
        for lead in _LEADS:
            for at in range(1, _length(lead) - len(data) + 1):
                for p in _PADS:
                    yield bytes([lead]) + bytes([p]) * (at - 1), bytes([p]) * (_length(lead) - at - len(data))


def _exhaustive(vocab: Vocab, data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """All completions of a short fragment by one character, and by a second one that may take the first one's last byte away."""
    if len(data) > 3:
        return
    more = range(0x80, 0xC0)
    size = _length(data[0])
    missing = size - len(data)
    if size and 0 < missing <= 2:
        ends = [bytes(x) for x in product(more, repeat=missing)]
        yield from ((b"", e) for e in ends)
        if missing == 1:
            for e in ends:
                for lead in (*range(0x20, 0x7F), *range(0xC2, 0xF5)):
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                    yield b"", e + bytes([lead]) + bytes([low]) * (_length(lead) - 1)
    if _rest(data):
        for lead in range(0xC2, 0xF5):
            pads = _length(lead) - 1 - len(data)
            if 0 <= pads <= 2:
                for at in range(pads + 1):
                    for own in product(more, repeat=pads):
                        yield bytes([lead, *own[:at]]), bytes(own[at:])


class Census:
    def __init__(self, vocab: Vocab, deep: bool = False):
        self.vocab, self.deep = vocab, deep
        self.added = {a.id for a in vocab.added}

    def has(self, token: int, text: bytes) -> bool:
        """Whether a text, if it is one, encodes to something with the token in it."""
        if len(text) > LONGEST:
            return False
        try:
            text.decode()
        except UnicodeDecodeError:
            return False
        return token in encode_binary(self.vocab, text)

    def _context(self, token: int, data: bytes) -> tuple[bytes | None, int]:
        for a, b in _glue(data):
            if self.has(token, a + data + b):
                return a + data + b, 0
        pool, tries = DEEP if self.deep else QUICK, 0
        for a, b in product(pool, pool):
            if a or b:
                tries += 1
                if self.has(token, a + data + b):
                    return a + data + b, tries
        if self.deep:
            for a, b in _exhaustive(self.vocab, data):
                tries += 1
                if self.has(token, a + data + b):
                    return a + data + b, tries
        return None, tries

    def judge(self, token: int) -> tuple[int, str, str, str, str | None, str | None, int]:
        """One row of the census."""
        data = self.vocab.tokens[token]
        shown = "".join(chr(b) if 32 <= b < 127 else f"\\x{b:02x}" for b in data)

        def row(verdict: str, reason: str | None = None, witness: bytes | None = None, bound: int = 0) -> tuple:
            return token, data.hex(), shown, verdict, reason, None if witness is None else witness.hex(), bound

        if token in self.added:
            return row("added", None, data)
        if len(data) > LONGEST:
            return row("unresolved")
        if self.vocab.merge(data) != [token]:
            return row("impossible", "merge-order")
        if self.has(token, data):
            return row("self", None, data)
        reason = prove_impossible(data)
        if reason:
            return row("impossible", reason)
        witness, bound = self._context(token, data)
        return row("context", None, witness, bound) if witness is not None else row("unresolved", None, None, bound)


def census(spark: SparkSession, vocab: Vocab, deep: bool = False, limit: int | None = None, partitions: int | None = None) -> DataFrame:
    """A row for each token that is used, of the first ``limit`` ids if given."""
    shared = spark.sparkContext.broadcast(vocab)
    used = [(i,) for i, t in enumerate(vocab.tokens[:limit]) if t]
    # neighbours in id are alike in cost: deal them out
    ids = spark.createDataFrame(used, "id int").repartition(partitions or spark.sparkContext.defaultParallelism, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Census(shared.value, deep)
        for b in batches:
            rows = [own.judge(i) for i in b.column("id").to_pylist()]
            if rows:
                kinds = (pa.int32(), *[pa.string()] * 5, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return ids.mapInArrow(run, SCHEMA)


def verify(spark: SparkSession, vocab: Vocab, result: DataFrame) -> DataFrame:
    """The rows whose witness, encoded again, doesn't have the token: there should be none."""
    shared = spark.sparkContext.broadcast(vocab)

    @F.udf(returnType="boolean")
    def holds(token, witness):
        return token in encode_binary(shared.value, bytes.fromhex(witness))

    return result.where("witness_hex is not null").where(~holds("id", "witness_hex"))


def summary(result: DataFrame) -> DataFrame:
    """verdict, reason, n; the totals of each verdict and of all have nulls."""
    named = result.withColumn("reason", F.coalesce("reason", F.lit("-")))
    return named.rollup("verdict", "reason").agg(F.count("*").alias("n"))


def witness(vocab: Vocab, token: int) -> dict:
    """One token's row, searched deeply, and its witness's ids with the token marked."""
    row = dict(zip((x.split()[0] for x in SCHEMA.split(", ")), Census(vocab, True).judge(token), strict=True))
    ids = encode_binary(vocab, bytes.fromhex(row["witness_hex"])) if row["witness_hex"] else []
    return {**row, "ids": [f"*{i}" if i == token else str(i) for i in ids]}


@cache
def _script(text: str) -> str:
    names = {unicodedata.name(c, "?").split()[0] for c in text if char_class(ord(c)) == L}
    return names.pop() if len(names) == 1 else "MIXED" if names else "NONE"


def by_script(result: DataFrame) -> DataFrame:
    """script, n, reachable, impossible, unresolved: by the letters of whole characters in a token."""

    @F.udf(returnType="string")
    def script(hexed):
        return _script(bytes.fromhex(hexed).decode("utf-8", "ignore"))

    count = lambda *v: F.sum(F.col("verdict").isin(*v).cast("long"))
    return result.withColumn("script", script("hex")).groupBy("script").agg(F.count("*").alias("n"), count("added", "self", "context").alias("reachable"), count("impossible").alias("impossible"), count("unresolved").alias("unresolved"))


def delivery(spark: SparkSession, vocab: Vocab, result: DataFrame) -> DataFrame:
    """n, mean_tokens: how many tokens stand for the text of tokens that are impossible and are text by themselves."""
    shared = spark.sparkContext.broadcast(vocab)

    @F.udf(returnType="int")
    def size(hexed):
        data = bytes.fromhex(hexed)
        try:
            data.decode()
        except UnicodeDecodeError:
            return None
        return len(encode_binary(shared.value, data))

    dead = result.where("verdict = 'impossible'").withColumn("n", size("hex")).where("n is not null")
    return dead.agg(F.count("*").alias("n"), F.avg("n").alias("mean_tokens"))

