"""The binary vocabulary image: writing, reading, and rules that say what is wrong with one.

Little-endian. A header of 136 bytes, zeros up to 192, then six sections at multiples of 64: token offsets, token bytes,
pair table, byte ids, added tokens, meta strings. Every rule is checked before anything is read from a section that it
guards; an image that breaks one gives no vocabulary at all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import FormatError, InputError
from ..operators.vocab import Added, Vocab, slots_log2

MAGIC, FIRST, ALIGN, EMPTY = 0x31565042, 192, 64, 0xFFFFFFFFFFFFFFFF
SECTIONS = ("token_offsets", "token_blob", "pair_table", "byte_to_id", "added", "meta")
HEADER = struct.Struct("<8I12QQ")
_U = np.uint64


def fmix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _pair_table(vocab: Vocab) -> np.ndarray:
    k = slots_log2(len(vocab.merges))
    table = np.full((1 << k, 2), EMPTY, np.uint64)
    keys = np.array([(a << 32) | b for a, b, _ in vocab.merges], np.uint64)
    slots = (fmix64(keys) & _U((1 << k) - 1)).astype(np.int64).tolist() if len(keys) else []
    used = bytearray(1 << k)
    for rank, (slot, (a, b, m)) in enumerate(zip(slots, vocab.merges, strict=True)):
        while used[slot]:
            slot = (slot + 1) & ((1 << k) - 1)
        used[slot] = 1
        table[slot] = (a << 32) | b, (rank << 32) | m
    return table


def write_image(vocab: Vocab) -> bytes:
    """The image of a vocabulary; the same vocabulary gives the same bytes."""
    ends = np.cumsum([0, *map(len, vocab.tokens)]).astype("<u4")
    added = np.array([(a.id, ends[a.id], len(a.content), int(a.special)) for a in vocab.added], "<u4")
    strings = [s.encode() for s in (vocab.name, vocab.converter, vocab.pattern)]
    parts = [
        ends.tobytes(),
        b"".join(vocab.tokens),
        _pair_table(vocab).astype("<u8").tobytes(),
        np.array(vocab.byte_ids, "<u4").tobytes(),
        added.tobytes(),
        b"".join(struct.pack("<I", len(s)) + s for s in strings),
    ]
    table, at = [], FIRST
    for p in parts:
        table += [at, len(p)]
        at += -(-len(p) // ALIGN) * ALIGN
    image = bytearray(at)
    HEADER.pack_into(image, 0, MAGIC, 1, int(vocab.nfc), 1, vocab.size, len(vocab.added), slots_log2(len(vocab.merges)), 0, *table, vocab.source_hash)
    for start, p in zip(table[::2], parts, strict=True):
        image[start : start + len(p)] = p
    return bytes(image)


@dataclass
class _Image:
    raw: bytes
    head: tuple
    sections: dict[str, tuple[int, int]]

    def part(self, name: str) -> bytes:
        at, n = self.sections[name]
        return self.raw[at : at + n]

    def array(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(self.part(name), kind)


def _open(raw: bytes) -> _Image:
    if len(raw) < FIRST:
        raise InputError(f"{len(raw)} bytes are no vocabulary")
    head = HEADER.unpack_from(raw)
    table = head[8:20]
    return _Image(raw, head, {n: (table[2 * k], table[2 * k + 1]) for k, n in enumerate(SECTIONS)})


def _structure(im: _Image, profiles: tuple[int, ...]) -> Iterator[tuple[str, str]]:
    magic, version, _, profile, count, added, log2, _ = im.head[:8]
    if magic != MAGIC:
        yield "magic", f"{magic:08x}"
    if version != 1:
        yield "version", str(version)
    if profile not in profiles:
        yield "profile", str(profile)
    if not 0 < count <= 1 << 21:
        yield "vocab_count", str(count)
    if added > 64:
        yield "added_count", str(added)
    if log2 > 32:
        yield "pair_slots_log2", str(log2)
    unit = {"token_offsets": 4, "pair_table": 16, "byte_to_id": 4, "added": 16}
    whole = {"token_offsets": 4 * (count + 1), "pair_table": 16 << min(log2, 64), "byte_to_id": 1024, "added": 16 * added}
    for name, (at, n) in im.sections.items():
        if at < FIRST or at % ALIGN:
            yield "section_alignment", name
        if n > len(im.raw) or at > len(im.raw) - n:
            yield "section_bounds", name
        if n % unit.get(name, 1):
            yield "section_unit", name
        if n != whole.get(name, n):
            yield "section_size", name
    spans = sorted((at, at + n, name) for name, (at, n) in im.sections.items() if n)
    for (_, end, x), (start, _, y) in zip(spans[:-1], spans[1:], strict=True):
        if start < end:
            yield "section_overlap", f"{x} and {y}"


def _content(im: _Image) -> Iterator[tuple[str, str]]:
    count = im.head[4]
    off = im.array("token_offsets", "<u4").astype(np.int64)
    if (np.diff(off) < 0).any():
        yield "offsets_order", str(int(np.flatnonzero(np.diff(off) < 0)[0]))
    if off.max() > im.sections["token_blob"][1]:
        yield "offsets_bounds", str(int(off.max()))
    pairs = im.array("pair_table", "<u8").reshape(-1, 2)
    full = pairs[pairs[:, 0] != _U(EMPTY)]
    for what, ids in (("left", full[:, 0] >> _U(32)), ("right", full[:, 0] & _U(0xFFFFFFFF)), ("merged", full[:, 1] & _U(0xFFFFFFFF))):
        if (ids >= count).any():
            yield "pair_range", what
    if len(full) > len(pairs) * 13 // 20:
        yield "pair_load", f"{len(full)} of {len(pairs)}"
    blob = im.part("token_blob")
    for b, i in enumerate(im.array("byte_to_id", "<u4").tolist()):
        if i >= count:
            yield "byte_range", f"{b:02x}"
        elif blob[off[i] : off[i + 1]] != bytes([b]) or off[i + 1] - off[i] != 1:
            yield "byte_token", f"{b:02x}"
    last = -1
    for i, at, n, _ in im.array("added", "<u4").reshape(-1, 4).tolist():
        if i >= count:
            yield "added_range", str(i)
            continue
        if not 1 <= n <= 250:
            yield "added_length", str(i)
        if at != off[i] or n != off[i + 1] - off[i]:
            yield "added_span", str(i)
        if i <= last:
            yield "added_order", str(i)
        last = i
    meta = im.part("meta")
    if len(meta) < 4 or struct.unpack_from("<I", meta)[0] > len(meta) - 4:
        yield "meta", str(len(meta))


def _merges(im: _Image) -> list[tuple[int, int, int]]:
    pairs = im.array("pair_table", "<u8").reshape(-1, 2)
    full = pairs[pairs[:, 0] != _U(EMPTY)]
    full = full[np.argsort(full[:, 1] >> _U(32), kind="stable")]
    low = _U(0xFFFFFFFF)
    return list(zip((full[:, 0] >> _U(32)).tolist(), (full[:, 0] & low).tolist(), (full[:, 1] & low).tolist(), strict=True))


def _strict(im: _Image) -> Iterator[tuple[str, str]]:
    raw = im.raw
    if any(raw[HEADER.size : FIRST]) or im.head[7]:
        yield "reserved", "header"
    if im.head[2] & ~1:
        yield "flags", f"{im.head[2]:x}"
    at = [im.sections[n] for n in SECTIONS]
    if any(x[0] > y[0] for x, y in zip(at[:-1], at[1:], strict=True)):
        yield "section_order", ""
    for x, y in zip(at, [*at[1:], (len(raw), 0)], strict=True):
        if any(raw[x[0] + x[1] : y[0]]):
            yield "padding", str(x[0])
    off = im.array("token_offsets", "<u4")
    if off[0] or off[-1] != im.sections["token_blob"][1]:
        yield "offsets_cover", ""
    tokens = _tokens(im)
    pairs = im.array("pair_table", "<u8").reshape(-1, 2)
    where = np.flatnonzero(pairs[:, 0] != _U(EMPTY))
    home = (fmix64(pairs[where, 0]) & _U(len(pairs) - 1)).astype(np.int64)
    taken = np.zeros(len(pairs), bool)
    taken[where] = True
    for s, h in zip(where.tolist(), home.tolist(), strict=True):
        while h != s and taken[h] and pairs[h, 0] != pairs[s, 0]:
            h = (h + 1) % len(pairs)
        if h != s:
            yield "pair_unreachable", str(s)
    ranks = np.sort(pairs[where, 1] >> _U(32))
    if not np.array_equal(ranks, np.arange(len(ranks), dtype=np.uint64)):
        yield "ranks", ""
    for a, b, m in _merges(im):
        if tokens[a] + tokens[b] != tokens[m]:
            yield "merge_bytes", f"{a} {b}"
    for i, *_ in im.array("added", "<u4").reshape(-1, 4).tolist():
        try:
            tokens[i].decode()
        except UnicodeDecodeError:
            yield "added_text", str(i)
    if len(_strings(im)) != 3:
        yield "meta_strings", str(len(_strings(im)))


def _tokens(im: _Image) -> list[bytes]:
    off, blob = im.array("token_offsets", "<u4").tolist(), im.part("token_blob")
    return [blob[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def _strings(im: _Image) -> list[bytes]:
    meta, at, out = im.part("meta"), 0, []
    while at + 4 <= len(meta):
        n = struct.unpack_from("<I", meta, at)[0]
        if at + 4 + n > len(meta):
            break
        out.append(meta[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def violations(raw: bytes, strict: bool = False) -> list[tuple[str, str]]:
    """(rule, detail) of all that is wrong with an image; contents are looked at only where the structure is sound. Strict: also what a loader may live with; it takes profile 0."""
    im = _open(raw)
    found = list(_structure(im, (0, 1) if strict else (1,)))
    if not found:
        found = list(_content(im))
    if strict and not found:
        found = list(_strict(im))
    return found


def read_image(raw: bytes, strict: bool = False) -> Vocab:
    """The vocabulary of an image, or an error and nothing."""
    found = violations(raw, strict)
    if found:
        raise FormatError("; ".join(f"{a}: {b}" for a, b in found[:5]))
    im = _open(raw)
    tokens, text = _tokens(im), _strings(im) + [b""] * 3
    added = tuple(Added(i, tokens[i], bool(f & 1)) for i, _, _, f in im.array("added", "<u4").reshape(-1, 4).tolist())
    return Vocab(tuple(tokens), tuple(_merges(im)), tuple(im.array("byte_to_id", "<u4").tolist()), added, bool(im.head[2] & 1), text[0].decode("utf-8", "replace"), im.head[20], text[1].decode("utf-8", "replace"), text[2].decode("utf-8", "replace"))


def load(path: str, strict: bool = False) -> Vocab:
    try:
        with open(path, "rb") as f:
            return read_image(f.read(), strict)
    except OSError as e:
        raise InputError(str(e)) from None


def save(vocab: Vocab, path: str) -> Vocab:
    """Writes the image and reads it back; a difference is an error."""
    with open(path, "wb") as f:
        f.write(write_image(vocab))
    again = load(path, strict=True)
    if again != vocab:
        raise FormatError("what was read back isn't what was written")
    return again


def report(vocab: Vocab, samples: int = 8) -> dict:
    """What there is to say of a vocabulary: its figures, added tokens, evenly spaced tokens and pair statistics."""
    at = sorted({k * (vocab.size - 1) // max(samples - 1, 1) for k in range(samples)}) if samples else []
    slots = 1 << slots_log2(len(vocab.merges))
    return {
        **vocab.info(),
        "unused": sum(not t for t in vocab.tokens),
        "added_tokens": [(a.id, sanitized(a.content), a.special) for a in vocab.added],
        "samples": [(i, vocab.tokens[i].hex(), sanitized(vocab.tokens[i])) for i in at],
        "pair_slots": slots,
        "pair_load": len(vocab.merges) / slots,
    }


def sanitized(data: bytes) -> str:
    """Text that a terminal can be trusted with: control bytes as \\xNN."""
    text = data.decode("utf-8", "backslashreplace")
    return "".join(c if " " <= c != "\x7f" else f"\\x{ord(c):02x}" for c in text)


def violations_df(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, rule, detail) over any number of images."""

    def check(raw: bytes) -> list[tuple[str, str]]:
        try:
            return violations(bytes(raw), strict)
        except InputError as e:
            return [("too_short", str(e))]

    found = F.udf(check, "array<struct<rule:string,detail:string>>")
    files = spark.read.format("binaryFile").load(path).select("path", F.explode(found("content")).alias("x"))
    return files.select("path", "x.rule", "x.detail")


class BpvSource(DataSource):
    """spark.read.format("bpv").load(path): the tokens of an image, as Vocab.tokens_df() has them; option table: tokens or merges."""

    @classmethod
    def name(cls) -> str:
        return "bpv"

    def schema(self) -> str:
        return "rank int, left int, right int, merged int" if self.options.get("table") == "merges" else "id int, bytes binary, is_added boolean, special boolean"

    def reader(self, schema) -> DataSourceReader:
        return BpvReader(self.options["path"], self.options.get("table", "tokens"))


class BpvReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path.removeprefix("file:"), table

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        vocab = load(self.path)
        if self.table == "merges":
            yield from ((k, *m) for k, m in enumerate(vocab.merges))
            return
        flags = {a.id: a.special for a in vocab.added}
        yield from ((i, t, i in flags, flags.get(i, False)) for i, t in enumerate(vocab.tokens) if t)
