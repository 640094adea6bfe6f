"""Comparing two encoders: where they differ first, and the shortest part of a text on which they do."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[str], Sequence[int]]


def first_difference(a: Sequence[int], b: Sequence[int]) -> int | None:
    """The first index at which two id lists differ; None if they are equal."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return k
    return None if len(a) == len(b) else min(len(a), len(b))


def shortest_difference(text: str, a: Encoder, b: Encoder) -> str | None:
    """A part of the text on which the encoders differ and no part of which, cut at either end, still does; None if they agree on all of it."""
    differ = lambda t: list(a(t)) != list(b(t))
    if not differ(text):
        return None
    step = max(1, len(text) // 2)
    while step:
        shorter = next((t for t in (text[step:], text[:-step]) if t and differ(t)), None)
        if shorter is not None:
            text = shorter
        else:
            step //= 2
        step = min(step, len(text) - 1)
    return text


def differences(df: DataFrame, left: str, right: str) -> DataFrame:
    """The rows of df whose id columns differ, with ``at``, the first place where they do."""
    size = F.least(F.size(left), F.size(right))
    equal = F.zip_with(F.slice(left, 1, size), F.slice(right, 1, size), lambda x, y: x == y)
    at = F.array_position(equal, False)
    return df.where(~F.col(left).eqNullSafe(F.col(right))).withColumn("at", F.when(at > 0, at - 1).otherwise(size))
