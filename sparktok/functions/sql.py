"""The functions by name in SQL."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.vocab import Vocab
from .bytes_path import encode_binary, split
from .columns import Merger, _share, decode_lists
from .unicode_pins import nfc


def register(spark: SparkSession, vocab: Vocab, prefix: str = "tok_") -> None:
    """tok_encode(text), tok_encode_raw(text), tok_count(text), tok_decode(ids), tok_nfc(text), and the table function tok_explode(text) of (pos, id, bytes).

    All but the table function work on whole batches: a batch's distinct pretokens are merged together and kept, as by the
    Column functions. Those are faster all the same, as they split in the JVM.
    """
    shared, key = _share(spark, vocab)
    merger = Merger(shared, key)

    def pretokens(texts: list[str | None], raw: bool) -> tuple[pa.Array, np.ndarray, dict[int, int]]:
        """The pretokens of some texts, their offsets by text, and the ids of those that are added tokens, by place."""
        v, out, off, added = shared.value, [], [0], {}
        names = {} if raw else {a.content.decode("utf-8", "replace"): a.id for a in reversed(v.added_by_length)}
        cut = re.compile("(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + ")") if names else None
        for t in texts:
            for k, part in enumerate(cut.split(t or "") if cut else [t or ""]):
                if k % 2:
                    added[len(out)] = names[part]
                    out.append("")
                elif part:
                    out += split(nfc(part) if v.nfc else part)
            off.append(len(out))
        return pa.array(out, pa.string()), np.array(off), added

    def encoded(texts: pa.Array, raw: bool) -> tuple[np.ndarray, np.ndarray]:
        pre, rows, added = pretokens(texts.to_pylist(), raw)
        ids, off = merger.ids(pre)
        if added:
            place = np.array([*added])
            ids = np.insert(ids, off[place], np.array([*added.values()], np.int32))
            off = off + np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(pre)))])
        return ids, off[rows]

    def encoder(raw: bool):
        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            ids, off = encoded(texts, raw)
            return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null() if texts.null_count else None)

        return run

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(np.diff(encoded(texts, False)[1]), pa.int64(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return decode_lists(shared.value, ids, False, "raise")

    @F.arrow_udf("string")
    def normal(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else nfc(t) for t in texts.to_pylist()], pa.string())

    class Explode:
        def eval(self, text: str):
            for pos, i in enumerate(encode_binary(shared.value, text.encode()) if text is not None else []):
                yield pos, i, shared.value.tokens[i]

    for name, f in (("encode", encoder(False)), ("encode_raw", encoder(True)), ("count", count), ("decode", decode), ("nfc", normal)):
        spark.udf.register(prefix + name, f)
    spark.udtf.register(prefix + "explode", F.udtf(Explode, returnType="pos int, id int, bytes binary"))
