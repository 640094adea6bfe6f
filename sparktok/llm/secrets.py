"""Secret scans: a deterministic automaton for all rules but those APART, and one for these, each read each byte once.

The rules are compiled by subset construction and minimised into transition arrays (automaton.py). Lines are read side by
side as arrays, as no rule of the automaton goes past a line break; a private key with its END line is one secret from header
to footer, found by BLOCKS. Only where the automaton says that a match of a rule ends is the
rule's reversed automaton run back to its first possible start. Of the matches of one rule in a text the leftmost, then
the longest, counts, and the next is looked for behind it.

Nulls and odd cases: a null or empty text holds no secret; a row without an id is reported without one; rows that repeat
an id are scanned each. An empty table gives no rows. Only the columns named are read; redact() keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .automaton import Combined
from .common import bound_batches, give_back, tidy

#: (rule, regular expression in the syntax of automaton.py)
RULES: list[tuple[str, str]] = [
    ("aws_access_key", r"(AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[0-9A-Za-z]{36}"),
    ("gitlab_token", r"glpat-[0-9A-Za-z_\-]{20}"),
    ("google_api_key", r"AIza[0-9A-Za-z_\-]{35}"),
    ("slack_token", r"xox[abprs]-[0-9A-Za-z\-]{10,}"),
    ("stripe_key", r"[rs]k_(live|test)_[0-9A-Za-z]{24,99}"),
    ("json_web_token", r"eyJ[0-9A-Za-z_\-]{8,}\.eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}"),
    ("private_key", r"-----BEGIN ([A-Z]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"),
    ("assigned_secret", r"(?i)[0-9a-z_\-]*(?:token|secret|password|passwd|pwd|key)[\"']?[ \t]*[=:][ \t]*[\"']?[0-9a-z_\-/+=.]{15,}[0-9a-z_\-/+=]"),
]

#: Rules that begin with any run of GUARD's bytes have an automaton of their own: in one with the others the states would multiply.
APART = {"assigned_secret"}

#: Rules whose secrets go on over line breaks: from BEGIN to the END of the same name, with no other line of dashes between, which PEM and PGP bodies don't have.
BLOCKS: dict[str, re.Pattern[bytes]] = {"private_key": re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?)-----(?:(?!-----)[\s\S])*-----END \1-----")}


@cache
def compiled(rules: tuple[tuple[str, str], ...], apart: bool = False) -> Combined:
    """The automaton of the rules that are APART, or of the others."""
    return Combined([r for name, r in rules if (name in APART) == apart])


def spans(col: pa.Array, rules: tuple[tuple[str, str], ...]) -> Iterator[tuple[int, int, int, int]]:
    """(row, rule, first byte, end byte) of the secrets in texts that end with a line break, in order of row, rule and place."""
    groups = [(compiled(rules, apart), own) for apart in (False, True) if (own := [k for k, (name, _) in enumerate(rules) if (name in APART) == apart])]
    blocks = [(k, BLOCKS[name]) for k, (name, _) in enumerate(rules) if name in BLOCKS]
    data, boff = T.buffers(col)
    for r0, r1 in T.rows(boff, 1 << 22):
        part, off = data[boff[r0] : boff[r1]], boff[r0 : r1 + 1] - boff[r0]
        raw = part.tobytes()
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for k, block in blocks:
            for m in block.finditer(raw):
                d = int(np.searchsorted(off, m.start(), "right")) - 1
                if m.end() <= off[d + 1]:
                    found.setdefault((d, k), []).append(m.span())
        for auto, numbers in groups:
            place, mark = auto.read(part, off)
            row = np.searchsorted(off, place, "right") - 1
            for d, e, m in zip(row.tolist(), place.tolist(), mark.tolist(), strict=True):
                for i, k in enumerate(numbers):
                    if m >> i & 1:
                        s = auto.backward[i].begin(raw, int(off[d]), e)
                        if s >= 0:
                            found.setdefault((d, k), []).append((s, e))
        for (d, k), own in sorted(found.items()):
            done = 0
            for s, e in sorted(own, key=lambda x: (x[0], -x[1])):
                if s >= done:
                    yield r0 + d, k, s - int(off[d]), e - int(off[d])
                    done = e


def _lined(c: Column) -> Column:
    return F.concat(F.coalesce(c, F.lit("")), F.lit("\n"))


def secrets(df: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rule, start, n_chars: the characters of each text that are a secret."""
    own = tuple(RULES if rules is None else rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.buffers(b.column("text"))
            got = []
            for r, k, s, e in spans(b.column("text"), own):
                raw = data[off[r] : off[r + 1]]
                lead = (raw & 0xC0) != 0x80
                got.append((r, own[k][0], int(lead[:s].sum()), int(lead[s:e].sum())))
            if got:
                r, rule, s, n = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(r)), pa.array(rule), pa.array(s, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "rule", "start", "n_chars"])

    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), _lined(F.col(text_col)).alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id long, rule string, start long, n_chars long")


def redact(df: DataFrame, rules: list[tuple[str, str]] | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with each secret in its text replaced by [rule]; what overlaps is replaced as one, by the first rule's name. length_col, if there is one, gets the new length. A null text stays null."""
    own = tuple(RULES if rules is None else rules)
    bound_batches(df.sparkSession)

    @F.arrow_udf("string")
    def clean(col: pa.Array) -> pa.Array:
        data, off = T.buffers(col)
        cut: dict[int, list[tuple[int, int, str]]] = {}
        for r, k, s, e in spans(col, own):
            cut.setdefault(r, []).append((s, e, own[k][0]))
        give_back()
        if not cut:
            return col.cast(pa.string())
        out = col.to_pylist()
        for r, parts in cut.items():
            raw, new, at, until = data[off[r] : off[r + 1]].tobytes(), b"", 0, -1
            for s, e, rule in sorted(parts):
                if s >= until:
                    new += raw[at:s] + f"[{rule}]".encode()
                at = until = max(until, e)
            out[r] = (new + raw[at:]).decode()
        return pa.array(out, pa.string())

    done = F.when(F.col(text_col).isNotNull(), clean(_lined(F.col(text_col))))
    out = df.withColumn(text_col, done)
    out = out.withColumn(text_col, F.substring(F.col(text_col), 1, F.length(text_col) - 1))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(df.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out
