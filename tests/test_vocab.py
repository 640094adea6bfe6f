import json
import warnings

import pytest

from sparktok.errors import FormatError, InputError, describe
from sparktok.operators.vocab import Vocab, byte_alphabet, fnv1a64, from_tokenizer_json, public_json, slots_log2, toy_json
from sparktok.queries import _BROKEN, FILES, broken_images, changed_json, rules_of
from sparktok.sources import bpv


@pytest.mark.parametrize("name, how, ok", FILES, ids=[n for n, _, _ in FILES])
def test_what_is_not_supported_is_refused(name, how, ok):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        if ok:
            from_tokenizer_json(changed_json(how))
        else:
            with pytest.raises(FormatError):
                from_tokenizer_json(changed_json(how))


def test_what_is_not_json_is_refused():
    for raw in (b"", b"[]", b"{", b"\xff"):
        with pytest.raises(FormatError):
            from_tokenizer_json(raw)


def test_both_forms_of_merges_and_warnings():
    source = json.loads(toy_json())
    source["model"]["merges"] = [" ".join(m) for m in source["model"]["merges"]]
    source["decoder"] = {"type": "Metaspace"}
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        got = from_tokenizer_json(json.dumps(source).encode())
    assert seen and got.merges == from_tokenizer_json(toy_json()).merges


def test_toy():
    v = from_tokenizer_json(toy_json(), "toy")
    assert v.size == 264 and len(v.merges) == 6 and v.topological and v.nfc
    assert v.tokens[256] == "ſ".encode() and v.tokens[261] == b"abc"
    assert [v.tokens[i] for i in v.byte_ids] == [bytes([b]) for b in range(256)]
    assert len(set(byte_alphabet())) == 256
    assert fnv1a64(b"") == 0xCBF29CE484222325 and fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert [slots_log2(n) for n in (0, 10, 11, 20, 21)] == [4, 4, 5, 5, 6]


def test_image_round_trip(tmp_path):
    v = from_tokenizer_json(public_json(merges=3000), "público")
    path = str(tmp_path / "v.bpv")
    assert bpv.save(v, path) == v
    assert bpv.write_image(v) == bpv.write_image(bpv.load(path))
    assert not bpv.violations(bpv.write_image(v), strict=True)
    assert bpv.report(v)["samples"][0][0] == 0 and bpv.report(v)["pair_load"] <= 0.65


def test_broken_images():
    assert sorted((n, r) for n, raw in broken_images() for r in rules_of(raw)) == sorted(_BROKEN)
    for n, raw in broken_images():
        if n != "sound":
            with pytest.raises((FormatError, InputError)):
                bpv.read_image(raw)
    good = broken_images()[0][1]
    with pytest.raises(InputError):
        bpv.read_image(good[:100])
    with pytest.raises(FormatError):
        bpv.read_image(good[:-300])
    padded = bytearray(good)
    padded[140] = 1
    assert bpv.read_image(bytes(padded)) and bpv.violations(bytes(padded), strict=True) == [("reserved", "header")]


def test_full_pair_table_is_refused():
    good = bytearray(bpv.write_image(from_tokenizer_json(toy_json())))
    at, size = bpv.HEADER.unpack_from(good)[12:14]
    for k in range(size // 16):
        good[at + 16 * k : at + 16 * k + 16] = (k << 32 | 1).to_bytes(8, "little") + (1).to_bytes(8, "little")
    assert ("pair_load", f"{size // 16} of {size // 16}") in bpv.violations(bytes(good))


def test_tables_and_sources(spark, tmp_path):
    v = from_tokenizer_json(toy_json(), "toy")
    v.write_parquet(spark, str(tmp_path / "tables"))
    assert Vocab.read_parquet(spark, str(tmp_path / "tables"), "toy") == v
    path = str(tmp_path / "v.bpv")
    bpv.save(v, path)
    spark.dataSource.register(bpv.BpvSource)
    assert spark.read.format("bpv").load(path).count() == 264
    assert spark.read.format("bpv").option("table", "merges").load(path).count() == 6
    assert bpv.violations_df(spark, path).isEmpty()
    (tmp_path / "bad.bpv").write_bytes(b"x")
    assert [r.rule for r in bpv.violations_df(spark, str(tmp_path / "bad.bpv")).collect()] == ["too_short"]
    assert v.header_df(spark).first().vocab_count == 264 and v.byte_tokens_df(spark).count() == 256 and v.added_df(spark).count() == 2


def test_messages():
    assert describe(-2) == "not a valid vocabulary" and describe(-99) == "unknown error"
    assert bpv.sanitized(b"a\x1b[\x7f\xff") == "a\\x1b[\\x7f\\xff"
