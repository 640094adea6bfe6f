"""Measuring strategies against each other: timed first, compared afterwards, failures recorded as results."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import differences
from ..operators.vocab import Vocab
from .encoding import encode

Strategy = Callable[[DataFrame], DataFrame]
SCHEMA = "strategy string, seconds double, mb_per_s double, n_tokens long, exact boolean, failure string"


def strategies(vocab: Vocab, key: str, text_col: str = "text") -> dict[str, Strategy]:
    """Each built-in way to add ids to a table with a unique key."""
    return {s: lambda df, s=s: encode(df, vocab, text_col, strategy=s, key=key) for s in ("arrow", "dedup", "native")}


def audit(df: DataFrame, ways: dict[str, Strategy], key: str, text_col: str = "text", rounds: int = 3) -> DataFrame:
    """One row a strategy: the best of some rounds, and whether its ids are those of the first strategy."""
    spark: SparkSession = df.sparkSession
    docs = df.select(key, text_col).persist()
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows, reference = [], None
    for name, way in ways.items():
        try:
            best = float("inf")
            for _ in range(rounds):
                start = time.perf_counter()
                n = way(docs).select(F.sum(F.size("ids"))).first()[0]
                best = min(best, time.perf_counter() - start)
            ids = way(docs).select(key, F.col("ids").alias("b"))
            exact = True
            if reference is None:
                reference = ids.withColumnRenamed("b", "a")
            else:
                exact = differences(reference.join(ids, key), "a", "b").isEmpty()
            rows.append((name, best, size / best / 1e6, n, exact, None))
        except Exception as e:  # a strategy that can't do it is a result
            rows.append((name, None, None, None, False, str(e).split("\n")[0][:200]))
    docs.unpersist()
    return spark.createDataFrame(rows, SCHEMA)


def markdown(result: DataFrame) -> str:
    """The audit as a table, fastest first."""
    lines = ["| strategy | MB/s | seconds | tokens | exact |", "|-|-|-|-|-|"]
    for r in result.orderBy(F.desc_nulls_last("mb_per_s")).collect():
        lines.append(f"| {r.strategy} | {r.failure} | | | no |" if r.failure else f"| {r.strategy} | {r.mb_per_s:.2f} | {r.seconds:.3f} | {r.n_tokens} | {'yes' if r.exact else 'no'} |")
    return "\n".join(lines)
