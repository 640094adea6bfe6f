"""Vocabularies: token bytes, ranked merges, byte tokens and added tokens, with their DataFrames and import from tokenizer files."""

from __future__ import annotations

import json
import warnings
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..errors import FormatError, RangeError
from ..functions.unicode_pins import PROFILE_1
from .bpe import Pairs, encode_bytes


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in tokenizer files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


ALPHABET = byte_alphabet()
_BYTE_OF = {c: b for b, c in enumerate(ALPHABET)}


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


@dataclass(frozen=True)
class Added:
    id: int
    content: bytes
    special: bool


@dataclass(frozen=True)
class Vocab:
    """tokens[id]: bytes, empty for an id that isn't used; merges[rank]: (left, right, merged); byte_ids[byte]: id; added: by id."""

    tokens: tuple[bytes, ...]
    merges: tuple[tuple[int, int, int], ...]
    byte_ids: tuple[int, ...]
    added: tuple[Added, ...] = ()
    nfc: bool = True
    name: str = ""
    source_hash: int = 0
    converter: str = field(default=__version__)
    pattern: str = PROFILE_1

    @property
    def size(self) -> int:
        return len(self.tokens)

    @cached_property
    def pairs(self) -> Pairs:
        return {(a, b): (rank, m) for rank, (a, b, m) in enumerate(self.merges)}

    @cached_property
    def added_by_length(self) -> list[Added]:
        """Longest first, of equals the smallest id: the order in which they are tried at a place."""
        return sorted(self.added, key=lambda a: -len(a.content))

    @cached_property
    def specials(self) -> frozenset[int]:
        return frozenset(a.id for a in self.added if a.special)

    @property
    def topological(self) -> bool:
        """Every merge's sides are bytes or made by earlier merges, so merges can be done one after the other."""
        made = set(self.byte_ids)
        for a, b, m in self.merges:
            if a not in made or b not in made or m in made:
                return False
            made.add(m)
        return True

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pretoken."""
        return encode_bytes(data, list(self.byte_ids), self.pairs)

    def decode(self, ids: list[int], skip_special: bool = False) -> bytes:
        out = []
        for i in ids:
            if not 0 <= i < self.size:
                raise RangeError(f"token id {i} is not below {self.size}")
            if skip_special and i in self.specials:
                continue
            if not self.tokens[i]:
                raise RangeError(f"token id {i} isn't used")
            out.append(self.tokens[i])
        return b"".join(out)

    def with_merges(self, n: int) -> Vocab:
        """The same bytes, added tokens and first n merges; ids of other tokens become unused."""
        kept = {*self.byte_ids, *(m for _, _, m in self.merges[:n]), *(a.id for a in self.added)}
        return Vocab(tuple(t if i in kept else b"" for i, t in enumerate(self.tokens)), self.merges[:n], self.byte_ids, self.added, self.nfc, self.name, self.source_hash)

    # DataFrames

    def tokens_df(self, spark: SparkSession) -> DataFrame:
        flags = {a.id: a.special for a in self.added}
        rows = [(i, bytearray(t), i in flags, flags.get(i, False)) for i, t in enumerate(self.tokens) if t]
        return spark.createDataFrame(rows, "id int, bytes binary, is_added boolean, special boolean")

    def merges_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *m) for k, m in enumerate(self.merges)], "rank int, left int, right int, merged int")

    def byte_tokens_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.byte_ids)), "byte int, id int")

    def added_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a.id, a.content.decode("utf-8", "replace"), a.special) for a in self.added], "id int, content string, special boolean")

    def header_df(self, spark: SparkSession) -> DataFrame:
        row = (1, self.nfc, 1, self.size, len(self.added), slots_log2(len(self.merges)), f"{self.source_hash:016x}")
        return spark.createDataFrame([row], "format_version int, nfc boolean, profile_id int, vocab_count int, added_count int, pair_slots_log2 int, source_hash string")

    def write_parquet(self, spark: SparkSession, path: str) -> None:
        """The vocabulary as a folder of tables."""
        for name, df in (("tokens", self.tokens_df(spark)), ("merges", self.merges_df(spark)), ("byte_tokens", self.byte_tokens_df(spark)), ("added", self.added_df(spark)), ("header", self.header_df(spark))):
            df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def read_parquet(spark: SparkSession, path: str, name: str = "") -> Vocab:
        header = spark.read.parquet(f"{path}/header").first()
        tokens = [b""] * header.vocab_count
        for r in spark.read.parquet(f"{path}/tokens").select("id", "bytes").collect():
            tokens[r.id] = bytes(r.bytes)
        merges = [(r.left, r.right, r.merged) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
        byte_ids = [r.id for r in spark.read.parquet(f"{path}/byte_tokens").orderBy("byte").collect()]
        added = [Added(r.id, tokens[r.id], r.special) for r in spark.read.parquet(f"{path}/added").orderBy("id").collect()]
        return Vocab(tuple(tokens), tuple(merges), tuple(byte_ids), tuple(added), header.nfc, name, int(header.source_hash, 16))

    def info(self) -> dict[str, Any]:
        return {"name": self.name, "size": self.size, "merges": len(self.merges), "added": len(self.added), "nfc": self.nfc, "version": __version__}


def slots_log2(n: int) -> int:
    """The smallest power of two, 16 at least, that n pairs fill to 65 % at most."""
    k = 4
    while n * 20 > (13 << k):
        k += 1
    return k


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise FormatError(message)


def _check_normalizer(n: Any) -> bool:
    _need(n is None or n == {"type": "NFC"}, f"the normalizer must be NFC or none, not {n!r}")
    return n is not None


def _check_pre_tokenizer(p: Any) -> None:
    _need(isinstance(p, dict) and p.get("type") == "Sequence" and isinstance(p.get("pretokenizers"), list) and len(p["pretokenizers"]) == 2, "the pre-tokenizer must be a sequence of two")
    split, level = p["pretokenizers"]
    _need(isinstance(split, dict) and split.get("type") == "Split", "the first pre-tokenizer must be Split")
    _need(split.get("pattern") == {"Regex": PROFILE_1}, "the split pattern isn't the one supported")
    _need(split.get("behavior") == "Isolated" and split.get("invert") is False, "the split must isolate, not invert")
    _need(isinstance(level, dict) and level.get("type") == "ByteLevel", "the second pre-tokenizer must be ByteLevel")
    _need(level.get("add_prefix_space") is False and level.get("use_regex") is False, "ByteLevel must add no space and use no pattern")


def _check_model(m: Any) -> None:
    _need(isinstance(m, dict) and m.get("type") == "BPE", "the model must be BPE")
    for key in ("dropout", "unk_token"):
        _need(m.get(key) is None, f"{key} must be null")
    for key in ("continuing_subword_prefix", "end_of_word_suffix"):
        _need(m.get(key) in (None, ""), f"{key} must be empty")
    for key in ("fuse_unk", "byte_fallback", "ignore_merges"):
        _need(m.get(key, False) is False, f"{key} must be false")
    _need(isinstance(m.get("vocab"), dict) and isinstance(m.get("merges"), list), "vocab must be an object, merges a list")


def _added(items: Any) -> list[Added]:
    _need(isinstance(items, list), "added_tokens must be a list")
    out = []
    for a in items:
        _need(isinstance(a, dict) and isinstance(a.get("content"), str) and a["content"] != "", "an added token needs content")
        _need(type(a.get("id")) is int and a["id"] >= 0, "an added token needs an id")
        for key in ("single_word", "lstrip", "rstrip", "normalized"):
            _need(a.get(key, False) is False, f"added token {a['content']!r}: {key} must be false")
        _need(type(a.get("special", False)) is bool, "special must be true or false")
        out.append(Added(a["id"], a["content"].encode(), a.get("special", False)))
    for what, n in (("id", Counter(a.id for a in out)), ("content", Counter(a.content for a in out))):
        _need(all(c == 1 for c in n.values()), f"added tokens repeat an {what}")
    return sorted(out, key=lambda a: a.id)


def _token_bytes(text: str) -> bytes:
    try:
        return bytes(_BYTE_OF[c] for c in text)
    except KeyError as e:
        raise FormatError(f"token {text!r} has {e.args[0]!r}, which stands for no byte") from None


def from_tokenizer_json(raw: bytes, name: str = "") -> Vocab:
    """A vocabulary from the bytes of a tokenizer file; whatever isn't supported is refused."""
    try:
        source = json.loads(raw)
    except ValueError as e:
        raise FormatError(f"not JSON: {e}") from None
    _need(isinstance(source, dict), "not a JSON object")
    nfc = _check_normalizer(source.get("normalizer"))
    _check_pre_tokenizer(source.get("pre_tokenizer"))
    model = source.get("model")
    _check_model(model)
    added = _added(source.get("added_tokens") or [])
    for key in ("decoder", "post_processor"):
        part = source.get(key)
        if part is not None and (not isinstance(part, dict) or part.get("type") != "ByteLevel"):
            warnings.warn(f"{key} isn't ByteLevel and is ignored", stacklevel=2)
    by_id: dict[int, bytes] = {}
    ids: dict[str, int] = {}
    extra = {a.content.decode(): a.id for a in added}
    for text, i in model["vocab"].items():
        _need(type(i) is int and i >= 0, f"token {text!r} has no id")
        if extra.get(text) == i:
            continue  # an added token that the model lists as well
        _need(i not in by_id, f"id {i} is used twice")
        by_id[i], ids[text] = _token_bytes(text), i
    for a in added:
        _need(a.id not in by_id, f"added token {a.content!r} has the id {a.id} of another")
        by_id[a.id] = a.content
    _need(bool(by_id), "the vocabulary is empty")
    tokens = tuple(by_id.get(i, b"") for i in range(max(by_id) + 1))
    byte_ids = []
    for b, c in enumerate(ALPHABET):
        _need(c in ids, f"byte {b:02x} has no token")
        byte_ids.append(ids[c])
    merges, seen = [], set()
    for m in model["merges"]:
        pair = m.split(" ") if isinstance(m, str) else m
        _need(isinstance(pair, list) and len(pair) == 2 and all(isinstance(x, str) and x for x in pair), f"merge {m!r} isn't a pair")
        left, right = pair
        _need(left in ids and right in ids and left + right in ids, f"merge {m!r} has a side or result that isn't a token")
        key = (ids[left], ids[right])
        _need(key not in seen, f"merge {m!r} is there twice")
        seen.add(key)
        merges.append((*key, ids[left + right]))
    return Vocab(tokens, tuple(merges), tuple(byte_ids), tuple(added), nfc, name, fnv1a64(raw))


def tokenizer_json(tokens: dict[str, int], merges: list[list[str]], added: list[dict[str, Any]], nfc: bool = True) -> bytes:
    """A tokenizer file of the supported kind."""
    options = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [options | a for a in added],
            "normalizer": {"type": "NFC"} if nfc else None,
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": PROFILE_1}, "behavior": "Isolated", "invert": False},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
                ],
            },
            "post_processor": None,
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": tokens, "merges": merges},
        },
        ensure_ascii=False,
    ).encode()


def toy_json() -> bytes:
    """264 ids: the bytes, six merges, and two added tokens whose first bytes differ."""
    tokens = {ALPHABET[b]: k for k, b in enumerate(sorted(range(256), key=lambda b: ord(ALPHABET[b])))}
    long_s = ALPHABET[0xC5] + ALPHABET[0xBF]
    merges = [[ALPHABET[0xC5], ALPHABET[0xBF]], [long_s, "x"], ["1", "2"], ["b", "c"], ["a", "b"], ["ab", "c"]]
    for a, b in merges:
        tokens[a + b] = len(tokens)
    return tokenizer_json(tokens, merges, [{"id": 262, "content": "<|end|>", "special": True}, {"id": 263, "content": "[PAD]", "special": True}])


def public_json(path: str = "/opt/tokenizers/byte_bpe_50k.json", merges: int | None = None) -> bytes:
    """The first merges of a public byte-level vocabulary under the supported normalizer and split pattern, with chat tokens added."""
    with open(path, "rb") as f:
        model = json.load(f)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"][:merges]]
    tokens = {c: model["vocab"][c] for c in ALPHABET}
    tokens |= {a + b: model["vocab"][a + b] for a, b in pairs}
    # ids without gaps, in the file's order
    tokens = {t: k for k, t in enumerate(sorted(tokens, key=tokens.__getitem__))}
    names = [("<|im_start|>", True), ("<|im_end|>", True), ("<|endoftext|>", True), ("<think>", False)]
    return tokenizer_json(tokens, pairs, [{"id": len(tokens) + k, "content": c, "special": s} for k, (c, s) in enumerate(names)])
