"""Tokenization as Column expressions.

Splitting is Spark's own: a pattern at a fixed Unicode version, evaluated in the JVM. Only NFC, for texts that it may
change, and merging go to Python, in Arrow batches. Merging sees each distinct pretoken of a batch once: the batch is
dictionary-encoded, its dictionary looked up in a cache that a worker keeps, and ids are gathered by array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..errors import RangeError
from ..operators.batch_bpe import PairTable, merge_many
from ..operators.vocab import Vocab
from .unicode_pins import MAY_CHANGE, SPLIT_JAVA, nfc

#: Distinct pretokens that a worker remembers: about 100 MB. New ones come up in proportion to the input, so more would only fill memory.
CACHE_SIZE = 1 << 18
#: Vocabularies whose pretokens a worker remembers, those last used; it lives on for all queries of a session.
KEPT = 2


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else nfc(t) for t in texts.to_pylist()], pa.string())


def normalize(text: Column | str) -> Column:
    """NFC of Unicode 9.0. Texts without any character that it could change don't leave the JVM."""
    c = _col(text)
    return F.coalesce(_nfc(F.when(c.rlike(MAY_CHANGE), c)), c)


def pretokenize(text: Column | str) -> Column:
    """The pretokens of a normalized text, which they partition. Null for null, none for an empty text."""
    return F.regexp_extract_all(_col(text), F.lit(SPLIT_JAVA), F.lit(0))


def split_class(pretoken: Column | str) -> Column:
    """Which alternative of the pattern made a pretoken, A1 to A7. A6 and A7 differ by what follows: A6 is given for runs that end a text or lie before another white space."""
    c = _col(pretoken)
    first = lambda p: c.rlike("(?U)^(?:" + p + ")$")
    return (
        F.when(first("(?i:'s|'t|'re|'ve|'m|'ll|'d)"), "A1")
        .when(first("\\s*[\\r\\n]+"), "A5")
        .when(first("\\s+"), "A6-7")
        .when(first("\\p{N}"), "A3")
        .when(first("[^\\r\\n\\p{L}\\p{N}]?\\p{L}+"), "A2")
        .otherwise("A4")
    )


def java_quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _added_names(vocab: Vocab, raw: bool) -> list[str]:
    """The added tokens that a string can hold, longest first."""
    names = [a.content.decode("utf-8", "surrogateescape") for a in vocab.added_by_length]
    return [] if raw else [n for n in names if not any("\udc80" <= x <= "\udcff" for x in n)]


def _has_added(c: Column, names: list[str]) -> Column:
    some = F.lit(False)
    for n in _roots(names):
        some = some | c.contains(n)
    return some


def _cut(c: Column, names: list[str]) -> Column:
    pattern = F.lit("(?s)(.*?)(" + "|".join(map(java_quote, names)) + "|\\z)")
    pairs = F.zip_with(F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2)), lambda a, b: F.struct(a.alias("seg"), b.alias("added")))
    return F.filter(pairs, lambda x: (x["seg"] != "") | (x["added"] != ""))


def added_split(text: Column | str, vocab: Vocab, raw: bool = False) -> Column:
    """array<struct<seg, added>>: each stretch of a text, and the added token behind it, empty at the end. Leftmost, then longest; raw: no added tokens. What is empty on both sides is left out."""
    c, names = _col(text), _added_names(vocab, raw)
    whole = F.when(F.length(c) > 0, F.array(F.struct(c.alias("seg"), F.lit("").alias("added")))).otherwise(F.array().cast("array<struct<seg:string,added:string>>"))
    return F.when(c.isNotNull(), F.when(_has_added(c, names), _cut(c, names)).otherwise(whole) if names else whole)


def _roots(names: list[str]) -> list[str]:
    """Those of the names that hold no other one: a text without them has none."""
    return [n for n in names if not any(m != n and m in n for m in names)]


_WORKER: dict[Any, _Known] = {}


class _Known:
    """What a worker has merged so far: pretokens, and where their ids are."""

    def __init__(self, vocab: Vocab, raw_bytes: Callable[[pa.Array], pa.Array] | None = None):
        self.vocab, self.table, self.byte_ids, self.raw_bytes = vocab, PairTable(vocab.merges), np.array(vocab.byte_ids, np.int32), raw_bytes
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.end = np.zeros(1024, np.int32), np.zeros(1, np.int64)

    def merge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct texts, merged now."""
        if self.raw_bytes:
            texts = self.raw_bytes(texts)
        _, o, d = texts.buffers()
        off = np.frombuffer(o, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(1, np.uint8)
        return merge_many(data, off, self.byte_ids, self.table, self.vocab.merge)

    def places(self, texts: pa.Array) -> np.ndarray:
        """The number of each of some distinct texts, those not known yet merged."""
        names = texts.to_pylist()
        if len(self.place) + len(names) > CACHE_SIZE:
            self.clear()
        place = self.place
        out = np.fromiter((place.get(t, -1) for t in names), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            ids, end = self.merge(texts.take(pa.array(new)))
            used = int(self.end[-1])
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[:used], np.zeros(max(len(ids), used), np.int32)])
            self.ids[used : used + len(ids)] = ids
            out[new] = np.arange(len(new)) + len(self.end) - 1
            self.end = np.concatenate([self.end, end[1:] + used])
            place.update(zip((names[k] for k in new.tolist()), out[new].tolist(), strict=True))
        return out


class Merger:
    """Ids of pretokens by batch; a worker keeps what it has merged. key tells vocabularies apart. raw_bytes: the bytes that pretokens stand for, if those aren't their own."""

    def __init__(self, shared: Any, key: str, raw_bytes: Callable[[pa.Array], pa.Array] | None = None):
        self.shared, self.key, self.raw_bytes = shared, key, raw_bytes

    def ids(self, pretokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pretokens without nulls."""
        if self.key not in _WORKER:
            while len(_WORKER) >= KEPT:
                del _WORKER[next(iter(_WORKER))]
            _WORKER[self.key] = _Known(self.shared.value, self.raw_bytes)
        known = _WORKER[self.key] = _WORKER.pop(self.key)
        if isinstance(pretokens, pa.ChunkedArray):
            pretokens = pretokens.combine_chunks()
        coded = pc.dictionary_encode(pretokens)
        words = coded.dictionary.cast(pa.string())
        code = coded.indices.to_numpy().astype(np.int64)
        if len(words) > CACHE_SIZE // 2:
            own, end = known.merge(words)
        else:
            code = known.places(words)[code]
            own, end = known.ids, known.end
        size = np.diff(end)[code]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(end[:-1][code] - off[:-1], size) + np.arange(off[-1])
        return own[at], off


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Texts go to Python 8 MB at a time, not Spark's 64, so that a task's memory stays small with long texts too. A setting of the user's own is kept."""
    if spark.conf.get(BATCH, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(BATCH, str(8 << 20))


def _share(spark: SparkSession, vocab: Vocab) -> tuple[Any, str]:
    """One broadcast for each vocabulary and session. What is shared is used on batches, which are bounded here."""
    bound_batches(spark)
    known = spark.__dict__.setdefault("_sparktok_vocabularies", {})
    key = f"{id(vocab)}-{vocab.size}-{len(vocab.merges)}-{vocab.source_hash:x}-{spark.sparkContext.applicationId}"
    if key not in known:
        known[key] = (spark.sparkContext.broadcast(vocab), vocab)
    return known[key][0], key


def _nested(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(flat values, offsets, which are null) of a list array."""
    null = lists.is_null().to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.concatenate([[0], np.cumsum(size)]), null


def _parts(c: Column, vocab: Vocab, raw: bool) -> tuple[Column, Column | None]:
    """Of each text one of: its pretokens, if no added token is in it; or array<struct<pre, added>>, each segment's pretokens and the added token behind it. The other is null, so that nothing is evaluated for it."""
    names = _added_names(vocab, raw)
    has = _has_added(c, names)
    own = F.when(~has, c) if names else c
    plain = F.coalesce(_nfc(F.when(own.rlike(MAY_CHANGE), own)), own) if vocab.nfc else own
    if not names:
        return pretokenize(plain), None
    held = F.when(has, _cut(F.when(has, c), names))
    if vocab.nfc:
        changed = _nfc_all(F.when(has & c.rlike(MAY_CHANGE), F.transform(held, lambda x: x["seg"])))
        held = F.when(changed.isNotNull(), F.zip_with(changed, held, lambda seg, x: F.struct(seg.alias("seg"), x["added"].alias("added")))).otherwise(held)
    return pretokenize(plain), F.transform(held, lambda x: F.struct(pretokenize(x["seg"]).alias("pre"), x["added"].alias("added")))


def _segments(c: Column, vocab: Vocab, raw: bool) -> Column:
    """array<struct<pre, added>> of every text."""
    plain, held = _parts(c, vocab, raw)
    whole = F.when(plain.isNotNull(), F.array(F.struct(plain.alias("pre"), F.lit("").alias("added"))))
    return whole if held is None else F.coalesce(held, whole)


@F.arrow_udf(ArrayType(StringType()))
def _nfc_all(lists: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [nfc(t) for t in x] for x in lists.to_pylist()], pa.list_(pa.string()))


def _gathered(sizes: np.ndarray, ids: np.ndarray, off: np.ndarray, out: np.ndarray, to: np.ndarray) -> None:
    """Writes each row's ids where the row's place is."""
    out[np.repeat(to - off[:-1], sizes) + np.arange(off[-1])] = ids


def _encoded(vocab: Vocab, merger: Any, plain: pa.Array, held: pa.Array | None, mark: Callable[[np.ndarray], np.ndarray] = np.asarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets by row, which rows are null), of what _parts() gives. mark: what stands for the ids of added tokens."""
    pre, rows, null = _nested(plain)
    ids, off = merger.ids(pre)
    off = off[rows]
    if held is None or held.null_count == len(held):
        return ids, off, null
    flat, segs, none = _nested(held)
    pre, seg, _ = _nested(flat.field("pre"))
    more, ends = merger.ids(pre)
    ends = ends[seg]
    names = flat.field("added")
    by_name = {a.content.decode("utf-8", "replace"): a.id for a in reversed(vocab.added_by_length)}
    marks = np.flatnonzero(pc.not_equal(names, "").to_numpy(zero_copy_only=False))
    added = np.array([by_name[x] for x in names.take(pa.array(marks)).to_pylist()], np.int32)
    added = mark(added)
    more = np.insert(more, ends[marks + 1], added)
    ends = (ends + np.concatenate([[0], np.cumsum(np.bincount(marks, minlength=len(flat)))]))[segs]
    size, extra = np.diff(off), np.diff(ends)
    end = np.concatenate([[0], np.cumsum(size + extra)])
    out = np.empty(int(end[-1]), np.int32)
    _gathered(size, ids, off, out, end[:-1])
    _gathered(extra, more, ends, out, end[:-1])
    return out, end, null & none


def encode(text: Column | str, vocab: Vocab, raw: bool = False, spark: SparkSession | None = None, once: bool = False) -> Column:
    """array<int>: the token ids of a text. raw: added tokens in it are ordinary text. Null for null, none for an empty text. once: a filter on the result isn't pushed below it, which would encode every text twice; an aggregate can't hold it then."""
    shared, key = _share(spark or SparkSession.active(), vocab)
    merger = Merger(shared, key)

    def lists(plain: pa.Array, held: pa.Array | None) -> pa.Array:
        return _lists(*_encoded(shared.value, merger, plain, held))

    return _applied(lists, "array<int>", *_parts(_col(text), vocab, raw), once)


def _lists(ids: np.ndarray, off: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null) if null.any() else None)


def token_count(text: Column | str, vocab: Vocab, raw: bool = False, spark: SparkSession | None = None, once: bool = False) -> Column:
    """bigint: how many ids encode() gives, without giving them. once: as in encode()."""
    shared, key = _share(spark or SparkSession.active(), vocab)
    merger = Merger(shared, key)

    def counts(plain: pa.Array, held: pa.Array | None) -> pa.Array:
        _, off, null = _encoded(shared.value, merger, plain, held)
        return pa.array(np.diff(off), pa.int64(), mask=null)

    return _applied(counts, "bigint", *_parts(_col(text), vocab, raw), once)


def _applied(f: Callable[[pa.Array, pa.Array | None], pa.Array], kind: str, plain: Column, held: Column | None, once: bool = False) -> Column:
    if held is None:

        @F.arrow_udf(kind)
        def one(a: pa.Array) -> pa.Array:
            return f(a, None)

        return (one.asNondeterministic() if once else one)(plain)

    @F.arrow_udf(kind)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return f(a, b)

    return (two.asNondeterministic() if once else two)(plain, held)


def token_totals(df: DataFrame, text: Column, vocab: Vocab, raw: bool = False) -> DataFrame:
    """id, n: how often each token is in the encodings of a table's texts; a batch gives each of its ids once, and no id lists leave Python."""
    shared, key = _share(df.sparkSession, vocab)
    merger = Merger(shared, key)
    plain, held = _parts(text, vocab, raw)
    both = held is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.size, np.int64)
        for b in batches:
            ids, _, _ = _encoded(shared.value, merger, b.column(0), b.column(1) if both else None)
            total += np.bincount(ids, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["id", "n"])

    parts = df.select(plain.alias("plain"), *([] if held is None else [held.alias("held")]))
    return parts.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def truncate(ids: Column | str, cap: int) -> Column:
    """The first cap ids; size() of the column still is the true count."""
    return F.slice(_col(ids), 1, cap)


def _flat_tokens(vocab: Vocab, skip_special: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, their offsets, which ids are used); special ones without bytes where they are skipped. Made once a vocabulary."""
    made = vocab.__dict__.setdefault("_flat_tokens", {})
    if skip_special not in made:
        shown = [b"" if skip_special and i in vocab.specials else t for i, t in enumerate(vocab.tokens)]
        off = np.concatenate([[0], np.cumsum([len(t) for t in shown])]).astype(np.int64)
        made[skip_special] = np.frombuffer(b"".join(shown), np.uint8), off, np.array([bool(t) for t in vocab.tokens], bool)
    return made[skip_special]


def decode_lists(vocab: Vocab, lists: pa.Array, skip_special: bool, errors: str) -> pa.Array:
    """The bytes of lists of ids, gathered from those of all tokens."""
    flat, rows, null = _nested(lists)
    data, at, used = _flat_tokens(vocab, skip_special)
    flat = flat.cast(pa.int64())
    ids = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
    bad = (ids < 0) | (ids >= vocab.size)
    if bad.any():
        ids = np.where(bad, 0, ids)
    bad |= ~used[ids]
    if bad.any():
        if errors != "null":
            wrong = int(pc.fill_null(flat, -1)[int(np.flatnonzero(bad)[0])].as_py())
            raise RangeError(f"token id {wrong} is not below {vocab.size}, or isn't used")
        null = null | (np.bincount(np.repeat(np.arange(len(lists)), np.diff(rows))[bad], minlength=len(lists)) > 0)
    size = at[ids + 1] - at[ids]
    off = np.concatenate([[0], np.cumsum(size)])
    out = data[np.repeat(at[ids] - off[:-1], size) + np.arange(off[-1])] if len(ids) else np.zeros(0, np.uint8)
    # a batch of less than 2 GB of bytes has 32-bit offsets, as Spark's binaries have
    ends = pa.array(off[rows], pa.int32()).buffers()[1]
    valid = pa.array(~null).buffers()[1] if null.any() else None
    return pa.Array.from_buffers(pa.binary(), len(lists), [valid, ends, pa.py_buffer(out.tobytes())])


def decode(ids: Column | str, vocab: Vocab, skip_special: bool = False, errors: str = "raise", spark: SparkSession | None = None) -> Column:
    """binary: the bytes of ids. An id that is out of range or unused is an error, or with errors="null" makes the row null."""
    shared, _ = _share(spark or SparkSession.active(), vocab)

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        return decode_lists(shared.value, lists, skip_special, errors)

    # no cast around it: ids that come from Python stay in the same worker
    return run(_col(ids))


def decode_text(ids: Column | str, vocab: Vocab, skip_special: bool = False, errors: str = "raise", spark: SparkSession | None = None) -> Column:
    """string: decode() as text, malformed bytes replaced."""
    shared, _ = _share(spark or SparkSession.active(), vocab)

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        raw = decode_lists(shared.value, lists, skip_special, errors)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([None if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())

    return run(_col(ids))


def parse_ids(text: Column | str) -> Column:
    """array<bigint>: the numbers in a text; all else is skipped. One that no 32 bits hold becomes -1, which decode() refuses."""
    found = F.regexp_extract_all(_col(text), F.lit("-?[0-9]+"), F.lit(0))
    return F.transform(found, lambda x: F.when(F.length(F.regexp_replace(x, "^0+", "")) <= 10, x.cast("bigint")).otherwise(-1)).cast("array<bigint>")


def format_ids(ids: Column | str) -> Column:
    """One id a line, as text."""
    return F.concat_ws("\n", F.transform(_col(ids), lambda x: x.cast("string")))


def sanitize(text: Column | str) -> Column:
    """Text safe for terminals: control characters as \\xNN."""
    c = _col(text)
    for b in [*range(32), 127]:
        c = F.replace(c, F.lit(chr(b)), F.lit(f"\\x{b:02x}"))
    return c

