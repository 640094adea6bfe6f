"""Encoding in Structured Streaming: it keeps no state, so a stream is encoded as a table is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vocab import Vocab
from ..plans.encoding import encode


def encode_stream(stream: DataFrame, vocab: Vocab, text_col: str = "text", raw: bool = False, ids: bool = True) -> DataFrame:
    """The stream with ids and n_tokens."""
    return encode(stream, vocab, text_col, raw, "arrow", ids=ids)


def token_rate(stream: DataFrame, vocab: Vocab, time_col: str, window: str = "1 minute", late: str = "10 minutes", text_col: str = "text") -> DataFrame:
    """start, n_texts, n_tokens of each window; rows later than ``late`` are dropped."""
    counted = encode(stream.withWatermark(time_col, late), vocab, text_col, ids=False)
    return counted.groupBy(F.window(time_col, window).alias("w")).agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens")).select(F.col("w.start").alias("start"), "n_texts", "n_tokens")
