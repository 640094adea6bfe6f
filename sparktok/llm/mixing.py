"""Mixing sources to target weights by entropy balancing.

Each document gets the rate that stays closest to 1, in relative entropy, while each source has its share of all tokens:
the minimum of sum(w log w - w) with sum of w * tokens over a source equal to its target. The dual is convex and without
constraints; its solution is the exponential tilt w = exp(sum of multipliers of a document's sources * its tokens), found
by Newton's method with backtracking. Further columns can have targets of their own, as languages, and then share the
Hessian.

Documents that agree in their constraint columns and tokens have one rate, so the sums of each iteration run over one row
for each such group, written out once. A rate is rounded to its floor, or one more with the probability of its fraction, by
a hash of the id and the row's text length: the expected tokens are the targets.

Nulls and odd cases: a null or empty text has no tokens, so no constraint reaches it and its rate is 1. A null source is a
source of its own. Targets of sources that are absent are left out and the others scaled up to sum to 1; a source without
target keeps nothing: its rate is 0. Sources with a target but no tokens can't get any, and are left out as if absent. Rows
that repeat an id have the same rate if they have the same tokens and source, and then the same copies. An empty table
gives no rows. Columns added to a table that has such names get underscores behind theirs until they are its only ones.

The driver solves for one multiplier a constrained value, with a Hessian of their number squared: more than ``most`` values
are refused. Values find their multipliers by a join with a broadcast table of so many rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import Scratch, bound_batches, give_back


@dataclass(frozen=True)
class Mixing:
    """total: tokens wanted in all, as a multiple of what there is. tolerance: of each constraint, relative to all tokens. most: constrained values in all."""

    total: float = 1.0
    iterations: int = 60
    tolerance: float = 1e-9
    most: int = 4096


NONE = "\0none"


def tokens(text: Column) -> Column:
    """Words of a text (text.py), 0 for null. Counted once a row: Spark evaluates a pattern anew wherever its count is used, a function of batches once."""

    @F.arrow_udf("bigint")
    def count(col: pa.Array) -> pa.Array:
        data, off = T.buffers(col)
        out = np.zeros(len(col), np.int64)
        for i, j in T.rows(off):
            out[i:j] = np.diff(T.words(data[off[i] : off[j]], off[i : j + 1] - off[i]).off)
        give_back()
        return pa.array(out)

    return count(F.lower(text))


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(NONE))


def solve(groups: DataFrame, keys: list[str], targets: list[dict[str, float]], p: Mixing) -> tuple[list[dict[str, float]], float, int]:
    """(multipliers of each key column by value, scale of tokens, iterations). groups: the key columns, t, n.

    Each iteration is one distributed pass that gives the driver, for each pair of values, the sums of the gradient and
    the Hessian: their size is that of the constraints, not of the data.
    """
    by = [groups.groupBy(k).agg(F.sum(F.col("t") * F.col("n")), F.sum("n")).limit(p.most + 1).collect() for k in keys]
    if sum(map(len, by)) > p.most:
        raise ValueError(f"more than {p.most} values have constraints")
    have = [{r[0]: (r[1], r[2]) for r in own} for own in by]
    total = sum(x for x, _ in have[0].values())
    if not total:
        return [{} for _ in keys], 1.0, 0
    scale = total / sum(x for _, x in have[0].values())
    index: list[dict[str, int]] = []
    want: list[float] = []
    for k, target in enumerate(targets):
        own = {v: w for v, w in target.items() if w > 0 and have[k].get(v, (0, 0))[0] > 0}
        mass = sum(own.values())
        index.append({})
        for v in sorted(own):
            index[k][v] = len(want)
            want.append(own[v] / mass * total * p.total / scale)
    goal = np.array(want)
    multiplier = np.zeros(len(goal))
    rows = groups.where("t > 0")
    for k, ix in zip(keys, index, strict=True):
        # rows of values without a target go
        rows = rows.join(F.broadcast(groups.sparkSession.createDataFrame([*ix.items()], f"{k} string, i_{k} int")), k)
    t = F.col("t") / scale

    def sums(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual's value, gradient and Hessian."""
        table = F.array(*(F.lit(float(x)) for x in m))
        tilt = sum((F.element_at(table, F.col(f"i{k}") + 1) for k in range(len(keys))), F.lit(0.0)) * t
        w = F.col("n") * F.exp(F.least(tilt, F.lit(700.0)))
        placed = rows.select("n", "t", *(F.col(f"i_{k}").alias(f"i{j}") for j, k in enumerate(keys)))
        got = placed.groupBy(*(f"i{k}" for k in range(len(keys)))).agg(F.sum(w).alias("w"), F.sum(w * t).alias("g"), F.sum(w * t * t).alias("h")).collect()
        value, grad, hess = -float(goal @ m), -goal.copy(), np.zeros((len(m), len(m)))
        for r in got:
            at = [r[f"i{k}"] for k in range(len(keys))]
            value += r["w"]
            for a in at:
                grad[a] += r["g"]
                for b in at:
                    hess[a, b] += r["h"]
        return value, grad, hess

    value, grad, hess = sums(multiplier)
    done = 0
    while done < p.iterations and np.abs(grad).max() > p.tolerance * goal.sum():
        # several sets of constraints overlap in the sum of all: a little ridge keeps the step defined
        step = np.linalg.solve(hess + np.eye(len(goal)) * 1e-12 * max(np.trace(hess), 1e-300), -grad)
        size, slope = 1.0, float(grad @ step)
        while True:
            done += 1
            new = sums(multiplier + size * step)
            if math.isfinite(new[0]) and new[0] <= value + 1e-4 * size * slope + 1e-12 * abs(value) or size < 1e-8:
                break
            size /= 2
        multiplier = multiplier + size * step
        value, grad, hess = new
    return [{v: float(multiplier[i]) for v, i in ix.items()} for ix in index], scale, done


def free(name: str, taken: list[str]) -> str:
    """A name that no column has, whatever its case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def rates(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, p: Mixing = Mixing(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, str, str, str]:
    """df with each row's tokens, rate and copies, and these columns' names. targets: for each constraint column, the shares of its values; by default every source has the same."""
    spark = df.sparkSession
    at = Scratch(spark, "mixing")
    bound_batches(spark)
    keys = list(targets) if targets else [source_col]
    n_tokens, rate, many = (free(c, df.columns) for c in ("__tokens", "__rate", "__copies"))
    counted = df.withColumn(n_tokens, tokens(F.col(text_col)))
    groups = at.save(counted.groupBy(*(_value(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(n_tokens).alias("t")).agg(F.count("*").alias("n")), "groups")
    if targets:
        shares = [{NONE if v is None else str(v): w for v, w in targets[k].items()} for k in keys]
    else:
        shares = [{r[0]: 1.0 for r in groups.where("t > 0").select("k0").distinct().limit(p.most + 1).collect()}]
    found, scale, _ = solve(groups, [f"k{i}" for i in range(len(keys))], shares, p)
    at.drop("groups")
    out, tilt, known, more = counted, F.lit(0.0), F.lit(True), []
    for i, (k, by) in enumerate(zip(keys, found, strict=True)):
        value, multiplier = (free(f"__{x}{i}", df.columns) for x in ("value", "multiplier"))
        table = spark.createDataFrame([*by.items()], f"`{value}` string, `{multiplier}` double")
        out = out.join(F.broadcast(table), _value(k) == F.col(value), "left")
        tilt, known = tilt + F.coalesce(F.col(multiplier), F.lit(0.0)), known & F.col(multiplier).isNotNull()
        more += [value, multiplier]
    out = out.withColumn(rate, F.when(F.col(n_tokens) == 0, 1.0).when(known, F.exp(tilt * F.col(n_tokens) / scale)).otherwise(0.0)).drop(*more)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.length(text_col), F.lit("copies")), F.lit(1 << 52)) / float(1 << 52)
    return out.withColumn(many, (F.floor(rate) + (draw < F.col(rate) - F.floor(rate)).cast("long")).cast("long")), n_tokens, rate, many


def copies(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, p: Mixing = Mixing(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, rate, copies of every document."""
    out, n_tokens, rate, many = rates(df, targets, p, id_col, text_col, source_col)
    return out.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(n_tokens).alias("n_tokens"), F.col(rate).alias("rate"), F.col(many).alias("copies"))


def repeat(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, p: Mixing = Mixing(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of df as often as its copies say, with the columns rate and copy (from 1)."""
    out, _, rate, many = rates(df, targets, p, id_col, text_col, source_col)
    own = [F.col(f"`{c}`") for c in df.columns]
    numbered = F.explode(F.sequence(F.lit(1).cast("long"), F.col(many)))
    return out.where(F.col(many) > 0).select(*own, F.col(rate).alias(free("rate", df.columns)), numbered.alias(free("copy", df.columns)))
