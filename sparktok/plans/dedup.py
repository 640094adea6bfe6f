"""Encoding that merges each distinct pretoken once in the whole job, and moves distinct pretokens only.

Texts are taken in chunks of a task. A chunk keeps its texts as numbers of its own distinct pretokens, and sends each of
these once, packed by the part of the key space it falls in; a part merges what it gets and answers each chunk, which puts
its ids together. All goes through one flow of rows, so that no step is evaluated twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import columns as C
from ..operators.vocab import Vocab

#: Pretokens of a chunk; a chunk ends with its task, too.
CHUNK = 2_000_000
_SENT = "chunk string, part int, size binary, code binary, at binary, words array<string>"
_ANSWERED = "chunk string, size binary, code binary, at binary, n binary, ids binary"


class _Numbered:
    """Gives pretokens their numbers in a chunk, in the place of ids."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}

    def ids(self, pretokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = pc.dictionary_encode(pretokens)
        place = self.place
        own = np.array([place.setdefault(w, len(place)) for w in coded.dictionary.to_pylist()], np.int32)
        return own[coded.indices.to_numpy()], np.arange(len(pretokens) + 1)


class _Chunk:
    def __init__(self, vocab: Vocab, parts: int, keys: pa.DataType):
        self.vocab, self.parts, self.key_type = vocab, parts, keys
        self.clear()

    def clear(self) -> None:
        self.numbered, self.n = _Numbered(), 0
        self.keys: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []

    def add(self, key: pa.Array, plain: pa.Array, held: pa.Array | None) -> None:
        """Texts as numbers of pretokens; an added token is its id, inverted. A null text has size -1."""
        code, off, null = C._encoded(self.vocab, self.numbered, plain, held, np.invert)
        self.keys.append(key)
        self.sizes.append(np.where(null, -1, np.diff(off)).astype(np.int32))
        self.codes.append(code.astype(np.int32))
        self.n += len(code)

    def sent(self, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The chunk, and the distinct pretokens of each part."""
        if not self.keys:
            return
        keys = pa.concat_arrays([k.cast(self.key_type) for k in self.keys])
        size, code, words = np.concatenate(self.sizes), np.concatenate(self.codes), list(self.numbered.place)
        raw = [w.encode() for w in words]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("k", keys.type)])) as out:
            out.write_batch(pa.record_batch([keys], names=["k"]))
        # by what it holds: an answer to another run of the task fits no chunk of this one
        name = hashlib.md5(sink.getvalue().to_pybytes() + size.tobytes() + code.tobytes() + b"\0".join(raw)).hexdigest()
        cells = {"chunk": [name], "part": [crc32(name.encode()) % self.parts], "size": [size.tobytes()], "code": [code.tobytes()], "at": [None], "words": [None], "keys": [keys]}
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(keys)], keys).cast(schema.field(n).type) if n == "keys" else pa.array(cells[n], schema.field(n).type) for n in names], schema=schema)
        part = np.fromiter((crc32(w) % self.parts for w in raw), np.int32, len(raw))
        order = np.argsort(part, kind="stable").astype(np.int32)
        found, first = np.unique(part[order], return_index=True)
        ends = np.append(first, len(order))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()).take(pa.array(order)))
        at = [order[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        columns = {"chunk": pa.array([name] * len(found), pa.string()), "part": pa.array(found, pa.int32()), "at": pa.array(at, pa.binary()), "words": lists}
        for k in range(0, len(found), 1000):
            rows = slice(k, k + 1000)
            yield pa.RecordBatch.from_arrays([columns[n][rows].cast(schema.field(n).type) if n in columns else pa.nulls(len(found[rows]), schema.field(n).type) for n in names], schema=schema)


def _ints(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.int32)


def encoded(df: DataFrame, vocab: Vocab, text_col: str, raw: bool, key: str, ids: bool, size: int = CHUNK) -> DataFrame:
    """__key, ids, n_tokens; without the ids if they aren't asked for. One row a row of df, nulls for a null text. size: pretokens of a chunk."""
    spark = df.sparkSession
    shared, name = C._share(spark, vocab)
    merger = C.Merger(shared, name)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain, held = C._parts(F.col(text_col), vocab, raw)
    both = held is not None
    kind = df.schema[key].dataType

    sent = StructType([*StructType.fromDDL(_SENT), StructField("keys", ArrayType(kind))])
    answered = StructType([*StructType.fromDDL(_ANSWERED), StructField("keys", ArrayType(kind))])
    done = StructType([StructField("__key", kind), *([StructField("ids", ArrayType(IntegerType()))] if ids else []), StructField("n_tokens", LongType())])
    sent_arrow, answered_arrow, done_arrow = (to_arrow_schema(s) for s in (sent, answered, done))
    key_type = done_arrow.field("__key").type

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(shared.value, parts, key_type)
        for b in batches:
            chunk.add(b.column(0), b.column(1), b.column(2) if both else None)
            if chunk.n >= size:
                yield from chunk.sent(sent.names, sent_arrow)
                chunk.clear()
        yield from chunk.sent(sent.names, sent_arrow)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.filter(pc.is_null(b.column("at")))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(own), f.type) if f.name in ("n", "ids") else own.column(f.name).cast(f.type) for f in answered_arrow], schema=answered_arrow)
            asked = b.filter(pc.is_valid(b.column("at")))
            if not len(asked):
                continue
            words, rows, _ = C._nested(asked.column("words"))
            got, off = merger.ids(words)
            each, got = np.diff(off).astype(np.int32), got.astype(np.int32)
            cells = {
                "n": pa.array([each[x:y].tobytes() for x, y in zip(rows[:-1], rows[1:], strict=True)], pa.binary()),
                "ids": pa.array([got[x:y].tobytes() for x, y in zip(off[rows[:-1]], off[rows[1:]], strict=True)], pa.binary()) if ids else pa.nulls(len(asked), pa.binary()),
                "chunk": asked.column("chunk"), "at": asked.column("at"),
            }
            yield pa.RecordBatch.from_arrays([cells[f.name].cast(f.type) if f.name in cells else pa.nulls(len(asked), f.type) for f in answered_arrow], schema=answered_arrow)

    def put_together(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own = group.filter(pc.is_valid(group.column("code")))
        answers = group.filter(pc.is_valid(group.column("at")))
        keys = pa.concat_arrays([c.flatten() for c in own.column("keys").chunks]) if own.num_rows else pa.nulls(0, key_type)
        held, code = _ints(own.column("size")), _ints(own.column("code"))
        at, n = _ints(answers.column("at")), _ints(answers.column("n"))
        known = np.zeros(max(len(at), 1), np.int64)
        if own.num_rows != 1 or len(at) and not np.array_equal(np.sort(at), np.arange(len(at))) or code.max(initial=-1) >= len(at):
            raise RuntimeError("a chunk of texts and the answers to it don't fit: the table that is encoded gave other rows when it was read again")
        known[at] = n
        each = np.where(code < 0, 1, known[np.maximum(code, 0)])
        off = np.concatenate([[0], np.cumsum(each)])
        ends = off[np.concatenate([[0], np.cumsum(np.maximum(held, 0))])]
        null = held < 0
        columns = [keys.cast(key_type), pa.array(np.diff(ends), pa.int64(), mask=null)]
        if ids:
            # ids of added tokens stand behind those of the answers
            pool, start = np.concatenate([_ints(answers.column("ids")), np.arange(shared.value.size, dtype=np.int32)]), np.zeros(len(known), np.int64)
            start[at] = np.cumsum(n) - n
            start = np.where(code < 0, len(pool) - shared.value.size + ~code, start[np.maximum(code, 0)])
            flat = pool[np.repeat(start - off[:-1], each) + np.arange(off[-1])]
            columns.insert(1, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null)).cast(done_arrow.field("ids").type))
        return pa.Table.from_arrays(columns, schema=done_arrow)

    chunks = df.select(F.col(key).alias("__key"), plain.alias("__plain"), *([held.alias("__held")] if both else [])).mapInArrow(pack, sent)
    return chunks.repartition(parts, "part").mapInArrow(answer, answered).groupBy("chunk").applyInArrow(put_together, done)
