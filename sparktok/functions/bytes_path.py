"""Encoding of BINARY input: bytes that may be no valid UTF-8 at all. A malformed byte is one opaque character.

It is carried through text as a private mark above Unicode's range would be: here as a lone surrogate, which Python's
surrogateescape gives and takes back, in no class, with no part in NFC. Columns are split in the JVM, as texts are, with marks
that it can hold. Overlong forms, surrogates and codepoints beyond
10FFFF are malformed byte by byte.
"""

from __future__ import annotations

import codecs
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.bpe import encode_bytes
from ..operators.vocab import Vocab
from .columns import Merger, _added_names, _col, _encoded, _lists, _parts, _share
from .unicode_pins import NL, L, N, S, char_class, nfc


@cache
def _class(c: str) -> int:
    return char_class(ord(c))


_SUFFIXES = ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll")


def split(text: str) -> list[str]:
    """The pretokens of a normalized text that may hold lone surrogates: the pattern's alternatives in order, at each place."""
    out, i, n = [], 0, len(text)
    kind = [_class(c) for c in text]
    while i < n:
        j = i
        head = text[i : i + 3].replace("ſ", "s").lower() if text[i] == "'" else ""
        for s in _SUFFIXES if head else ():
            if head.startswith(s):
                j = i + len(s)
                break
        if j == i:
            k = i + 1 if not kind[i] & (L | N | NL) else i
            e = k
            while e < n and kind[e] & L:
                e += 1
            if e > k:
                j = e
            elif kind[i] & N:
                j = i + 1
            else:
                k = i + 1 if text[i] == " " else i
                e = k
                while e < n and not kind[e]:
                    e += 1
                if e > k:
                    while e < n and kind[e] & NL:
                        e += 1
                    j = e
                else:
                    e = i
                    while e < n and kind[e] & S:
                        e += 1
                    last = max((x for x in range(i, e) if kind[x] & NL), default=-1)
                    j = last + 1 if last >= 0 else e if e == n or e - i == 1 else e - 1
        out.append(text[i:j])
        i = j
    return out


def _escaped(data: bytes) -> str:
    """Text in which each malformed byte is a character of its own."""
    return data.decode("utf-8", "surrogateescape")


def _normal(text: str) -> str:
    if text.isascii():
        return text
    out, run = [], []
    for c in text:
        if "\udc80" <= c <= "\udcff":
            out += [nfc("".join(run)), c]
            run = []
        else:
            run.append(c)
    return "".join([*out, nfc("".join(run))])


def encode_binary(vocab: Vocab, data: bytes, raw: bool = False) -> list[int]:
    """The ids of any bytes, by the whole pipeline."""
    out: list[int] = []
    names = [] if raw else vocab.added_by_length
    start = i = 0
    byte_ids = list(vocab.byte_ids)

    def segment(part: bytes) -> None:
        text = _escaped(part)
        for p in split(_normal(text) if vocab.nfc else text):
            out.extend(encode_bytes(p.encode("utf-8", "surrogateescape"), byte_ids, vocab.pairs))

    firsts = {a.content[0] for a in names}
    while i < len(data):
        hit = next((a for a in names if data.startswith(a.content, i)), None) if data[i] in firsts else None
        if hit:
            segment(data[start:i])
            out.append(hit.id)
            i += len(hit.content)
            start = i
        else:
            i += 1
    segment(data[start:])
    return out


#: A column's malformed bytes go through the JVM as characters of a private plane, in no class and with no part in NFC either. Rows that hold such characters of their own are encoded one by one.
_MARK = 0x10FF00
_MARKS = re.compile(rb"\xf4\x8f([\xbe\xbf])([\x80-\xbf])")
_ODD = (b"\xf4\x8f\xbe", b"\xf4\x8f\xbf")


def _mark(e: UnicodeDecodeError) -> tuple[str, int]:
    return "".join(chr(_MARK + b) for b in e.object[e.start : e.end]), e.end


def _marked(data: pa.Array) -> pa.Array:
    """Texts in which each malformed byte is a mark."""
    codecs.register_error("sparktok.mark", _mark)
    return pa.array([None if b is None else b.decode("utf-8", "sparktok.mark") for b in data.to_pylist()], pa.string())


def _unmarked(texts: pa.Array) -> pa.Array:
    """The bytes that some texts with marks stand for."""
    texts = texts.cast(pa.binary())
    found = np.flatnonzero(pc.or_(*(pc.match_substring(texts, x) for x in _ODD)).to_numpy(zero_copy_only=False))
    if not len(found):
        return texts
    put = [_MARKS.sub(lambda m: bytes([(0x80 if m[1] == b"\xbe" else 0xC0) | m[2][0] & 0x3F]), texts[int(k)].as_py()) for k in found]
    at = np.arange(len(texts))
    at[found] = len(texts) + np.arange(len(found))
    return pa.concat_arrays([texts, pa.array(put, pa.binary())]).take(pa.array(at))


def encode_bytes_column(data: Column | str, vocab: Vocab, raw: bool = False, spark: SparkSession | None = None) -> Column:
    """array<int>: the ids of a BINARY column."""
    shared, key = _share(spark or SparkSession.active(), vocab)
    d = _col(data)

    def one_by_one(col: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.array(encode_binary(shared.value, b, raw), np.int32) for b in col.to_pylist()], pa.list_(pa.int32()))

    if not raw and len(_added_names(vocab, raw)) < len(vocab.added):
        # an added token that is no text may begin or end within a character
        @F.arrow_udf("array<int>")
        def all_of_them(col: pa.Array) -> pa.Array:
            return one_by_one(col)

        return all_of_them(d)

    @F.arrow_udf("string")
    def marked(col: pa.Array) -> pa.Array:
        return _marked(col)

    merger = Merger(shared, f"{key}-bytes", _unmarked)
    odd = F.contains(d, F.lit(_ODD[0])) | F.contains(d, F.lit(_ODD[1]))
    plain, held = _parts(marked(F.when(~odd, d)), vocab, raw)

    def lists(plain: pa.Array, held: pa.Array | None, odd: pa.Array) -> pa.Array:
        out = _lists(*_encoded(shared.value, merger, plain, held))
        if odd.null_count == len(odd):
            return out
        at = pc.if_else(odd.is_valid(), pa.array(np.arange(len(out)) + len(out)), pa.array(np.arange(len(out))))
        return pa.concat_arrays([out, one_by_one(odd)]).take(at)

    if held is None:

        @F.arrow_udf("array<int>")
        def two(a: pa.Array, b: pa.Array) -> pa.Array:
            return lists(a, None, b)

        return two(plain, F.when(odd, d))

    @F.arrow_udf("array<int>")
    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return lists(a, b, c)

    return three(plain, held, F.when(odd, d))
