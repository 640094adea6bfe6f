"""Command line: encode, count, decode, bench, census, witness, info, dump, convert, fingerprint, diff.

python -m sparktok.cli COMMAND VOCABULARY.bpv ... Exit status: 0 done, 1 usage, 2 input, 3 vocabulary, 4 encoding or
decoding, 5 a witness that doesn't hold, 6 fingerprints that differ.
"""

from __future__ import annotations

import json
import sys
import time

from .errors import FormatError, InputError, RangeError, TokError
from .functions.bytes_path import encode_binary
from .operators.vocab import Vocab, from_tokenizer_json
from .sources import bpv
from .sources.text import cut_documents

USAGE = """usage: encode|count|decode|bench VOCAB [FILE] [--raw] [--scalar] [--skip-special]
       census VOCAB [OUT.json] [--deep] [--limit N]
       witness VOCAB ID
       info VOCAB
       dump VOCAB
       convert TOKENIZER.json OUT.bpv
       fingerprint VOCAB OUT.json [--quick]
       diff A.json B.json"""
FLAGS = {"--raw", "--scalar", "--skip-special", "--deep", "--quick"}


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sparktok").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _read(path: str | None) -> bytes:
    try:
        if path in (None, "-"):
            return sys.stdin.buffer.read()
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise InputError(str(e)) from None


def _vocab(path: str) -> Vocab:
    try:
        return bpv.load(path)
    except InputError as e:
        raise FormatError(str(e)) from None


def parse_ids(data: bytes) -> list[int]:
    """The numbers in a text; one that no unsigned 32 bits hold is an error."""
    import re

    ids = [int(x) for x in re.findall(rb"-?[0-9]+", data)]
    for i in ids:
        if not 0 <= i < 1 << 32:
            raise RangeError(f"id {i} is out of range")
    return ids


def _bench(vocab: Vocab, data: bytes, raw: bool) -> None:
    from pyspark.sql import functions as F

    from .functions.bytes_path import encode_bytes_column

    if not data:
        raise InputError("nothing to measure")
    spark = _session()
    docs = spark.createDataFrame([(bytearray(d),) for d in cut_documents(data)], "content binary").repartition(spark.sparkContext.defaultParallelism).persist()
    docs.count()
    best, tokens = float("inf"), 0
    for _ in range(3):
        start = time.perf_counter()
        tokens = docs.select(F.sum(F.size(encode_bytes_column("content", vocab, raw, spark)))).first()[0]
        best = min(best, time.perf_counter() - start)
    print(json.dumps({"bytes": len(data), "tokens": tokens, "seconds": round(best, 4), "mb_per_s": round(len(data) / best / 1e6, 3)}))


def _census(vocab: Vocab, out: str | None, deep: bool, limit: int | None) -> int:
    from .operators import census as cen

    spark = _session()
    result = cen.census(spark, vocab, deep, limit).persist()
    failed = cen.verify(spark, vocab, result).count()
    if out:
        rows = [r.asDict() for r in result.orderBy("id").toLocalIterator()]
        with open(out, "w") as f:
            json.dump({"vocab": vocab.name, "size": vocab.size, "tokens": rows}, f)
    for r in cen.summary(result).where("verdict is not null").orderBy("verdict", "reason").collect():
        print(f"{r.verdict} {r.reason or 'all'} {r.n}")
    print(f"witnesses that don't hold: {failed}")
    return 5 if failed else 0


def _fingerprint(vocab: Vocab, out: str, quick: bool) -> None:
    from .operators import fingerprint as fp

    nested: dict[str, dict[str, str]] = {}
    for r in fp.take(_session(), vocab, quick).orderBy("section", "key").toLocalIterator():
        nested.setdefault(r.section, {})[r.key] = r.value
    with open(out, "w") as f:
        json.dump(nested, f, indent=1, ensure_ascii=False)


def _diff(a: str, b: str) -> int:
    """Named changes, the first 20 of each section. A section that only one has is a note, not a difference."""
    try:
        left, right = json.loads(_read(a)), json.loads(_read(b))
    except ValueError as e:
        raise InputError(str(e)) from None
    status = 0
    for section in sorted(left.keys() | right.keys()):
        if section not in left or section not in right:
            print(f"note: only one has {section}")
            continue
        x, y = left[section], right[section]
        changed = [k for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)]
        for k in changed[:20]:
            print(f"{section} {k}: {x.get(k)} -> {y.get(k)}")
        if changed:
            status = 6
            print(f"{section}: {len(changed)} differences")
    return status


def run(args: list[str]) -> int:
    flags, rest, limit = set(), [], None
    it = iter(args)
    for a in it:
        if a == "--limit":
            text = next(it, "")
            if not text.isdigit():
                print(USAGE, file=sys.stderr)
                return 1
            limit = int(text)
        elif a in FLAGS:
            flags.add(a)
        else:
            rest.append(a)
    command, rest = (rest[0], rest[1:]) if rest else ("", [])
    least = {"encode": (1, 2), "count": (1, 2), "decode": (1, 2), "bench": (1, 2), "census": (1, 2), "witness": (2, 2), "info": (1, 1), "dump": (1, 1), "convert": (2, 2), "fingerprint": (2, 2), "diff": (2, 2)}
    if command not in least or not least[command][0] <= len(rest) <= least[command][1] or any(x.startswith("--") for x in rest) or command == "witness" and not rest[1].isdigit():
        print(USAGE, file=sys.stderr)
        return 1
    try:
        if command == "convert":
            bpv.save(from_tokenizer_json(_read(rest[0]), rest[0].rsplit("/", 1)[-1]), rest[1])
            return 0
        if command == "diff":
            return _diff(*rest)
        start = time.perf_counter()
        vocab = _vocab(rest[0])
        opened = time.perf_counter() - start
        file = rest[1] if len(rest) > 1 else None
        if command == "info":
            print("\n".join(f"{k}: {bpv.sanitized(str(v).encode())}" for k, v in vocab.info().items()) + f"\nopened in: {opened * 1000:.3f} ms")
        elif command == "dump":
            print(json.dumps(bpv.report(vocab), indent=1))
        elif command == "fingerprint":
            _fingerprint(vocab, file, "--quick" in flags)
        elif command in ("encode", "count"):
            ids = encode_binary(vocab, _read(file), "--raw" in flags)
            print(len(ids) if command == "count" else "\n".join(map(str, ids)), end="\n" if command == "count" or ids else "")
        elif command == "decode":
            sys.stdout.buffer.write(vocab.decode(parse_ids(_read(file)), "--skip-special" in flags))
            sys.stdout.buffer.flush()
        elif command == "bench":
            _bench(vocab, _read(file), "--raw" in flags)
        elif command == "census":
            return _census(vocab, file, "--deep" in flags, limit)
        else:
            from .operators.census import witness

            token = int(rest[1])
            if token >= vocab.size or not vocab.tokens[token]:
                raise RangeError(f"token {token} isn't used")
            for k, v in witness(vocab, token).items():
                print(f"{k}: {' '.join(v) if k == 'ids' else v}")
    except TokError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_status
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
