"""Chat formatting: where each turn ends up in a conversation's rendering, found without looking into the template.

A template is any function of a list of messages that gives a string. It renders the conversation's first 0, 1, 2, ... turns,
and consecutive outputs are compared:

- append: the old output is a prefix of the new one; what is new is the turn's span.
- trailer: the old output is a prefix but for an ending that the new one ends with as well; the turn lies before it.
  Where the turn begins as the ending does, what all outputs end with tells them apart.
- rewrite: else, the template changed history from the first difference on; the span goes from there to the end.
- error: the template raised; the turn has no span, and the next is compared with the output before.

A span of an earlier turn that a later change reaches into is void: ``rewritten_at`` is the first position that does so.

Nulls and odd cases: rows without a conversation or a turn number are left out; a null role or text is empty. Turns are
ordered by number, then role, then text, so ties and repeated rows have one order; each is a turn of its own. A template
that rewrites at every turn, very long texts and conversations of one turn need nothing special. An empty table gives no
rows. Only the columns named are read. Positions count characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

Message = dict[str, str]
Template = Callable[[list[Message]], str]


def chatml(messages: list[Message]) -> str:
    """Turns between marks; only ever appends."""
    return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)


def closed(messages: list[Message]) -> str:
    """Turns in brackets, and one mark at the very end."""
    return "<s>" + "".join(f"[{m['role']}] {m['content']} [/{m['role']}]" for m in messages) + "</s>"


def reasoning(messages: list[Message]) -> str:
    """An assistant's turn has a reasoning block while it is the last; rewrites history when it isn't any more."""
    last = len(messages) - 1
    block = "<think>\n\n</think>\n\n"
    return "".join(f"<|im_start|>{m['role']}\n{block if k == last and m['role'] == 'assistant' else ''}{m['content']}<|im_end|>\n" for k, m in enumerate(messages))


TEMPLATES: dict[str, Template] = {"chatml": chatml, "closed": closed, "reasoning": reasoning}


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def common_suffix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low]:
            low = mid
        else:
            high = mid - 1
    return low


def spans(template: Template, messages: list[Message]) -> list[tuple[str, int | None, int | None, int | None]]:
    """(status, start, end, rewritten_at) of each turn."""
    outputs: list[str | None] = []
    for i in range(len(messages) + 1):
        try:
            outputs.append(template([dict(m) for m in messages[:i]]))
        except Exception:  # a template may refuse some conversations, as an empty one
            outputs.append(None)
    given = [x for x in outputs if x is not None]
    ending = min((common_suffix(x, y) for x, y in zip(given[:-1], given[1:], strict=True)), default=0)
    old = outputs[0] or ""
    out: list[list] = []
    for i, new in enumerate(outputs[1:], 1):
        if new is None:
            out.append(["error", None, None, None])
            continue
        if new.startswith(old):
            kind, first, end = "append", len(old), len(new)
        else:
            same, tail = common_prefix(old, new), common_suffix(old, new)
            if len(old) - tail <= same:
                # by two outputs alone, several places are possible where the turn begins as the ending does
                tail = min(max(ending, len(old) - same), tail)
                kind, first, end = "trailer", len(old) - tail, len(new) - tail
            else:
                kind, first, end = "rewrite", same, len(new)
        for span in out:
            if span[2] is not None and span[3] is None and first < span[2]:
                span[3] = i
        out.append([kind, first, end, None])
        old = new
    return [tuple(x) for x in out]


def turn_spans(df: DataFrame, templates: dict[str, Template] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """template, conv_id, position (from 1), turn, role, status, start, end, rewritten_at of every turn under each template."""
    bound_batches(df.sparkSession)
    own = TEMPLATES if templates is None else templates
    turns = df.select(F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = turns.where("conv is not null and t.turn is not null").groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["template", "conv_id", "position", "turn", "role", "status", "start", "end", "rewritten_at"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            rows: list[tuple] = []
            for conv, turns in zip(b.column("conv").to_pylist(), b.column("turns"), strict=True):
                turns = turns.as_py()
                messages = [{"role": t["role"], "content": t["text"]} for t in turns]
                for name, template in own.items():
                    for k, (t, span) in enumerate(zip(turns, spans(template, messages), strict=True)):
                        rows.append((name, conv, k + 1, t["turn"], t["role"], *span))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)], names)

    return convs.mapInArrow(tidy(run), "template string, conv_id long, position long, turn long, role string, status string, start long, end long, rewritten_at long")
