import io
import json
import subprocess
import sys
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from sparktok import cli
from sparktok.errors import InputError
from sparktok.functions import sql
from sparktok.functions.bytes_path import encode_binary
from sparktok.operators import census as cen
from sparktok.operators import fingerprint as fp
from sparktok.operators.vocab import from_tokenizer_json, public_json, toy_json
from sparktok.sources import bpv, text
from sparktok.streaming.encoding import encode_stream, token_rate


@pytest.fixture(scope="module")
def toy():
    return from_tokenizer_json(toy_json(), "toy")


def test_census_of_the_toy(spark, toy):
    for deep in (False, True):
        result = cen.census(spark, toy, deep).persist()
        counts = {(r.verdict, r.reason): r.n for r in cen.summary(result).collect()}
        assert counts[("added", "-")] == 2 and counts[("impossible", None)] == 15 and ("unresolved", "-") not in counts
        assert counts[("impossible", "invalid-utf8")] == 13 and counts[("impossible", "pretoken-shape")] == counts[("impossible", "merge-order")] == 1
        assert counts[(None, None)] == 264
        rows = {r.id: r for r in result.collect()}
        dead = {rows[i].hex for i in rows if rows[i].reason == "invalid-utf8"}
        assert dead == {"c0", "c1", *(f"{b:02x}" for b in range(0xF5, 0x100))}
        assert rows[258].reason == "pretoken-shape" and rows[261].reason == "merge-order"
        assert rows[toy.byte_ids[0xA1]].verdict == "context"
        assert cen.verify(spark, toy, result).isEmpty()
        assert cen.census(spark, toy, limit=10).count() == 10
    assert cen.delivery(spark, toy, result).first().n == 2
    assert {r.script for r in cen.by_script(result).collect()} >= {"LATIN", "NONE"}


def test_census_reasons():
    assert cen.prove_impossible(b"'sx") == "contraction" and cen.prove_impossible(b"'s") is None and cen.prove_impossible("'ſx".encode()) == "contraction"
    assert cen.prove_impossible("豈".encode()) == "nfc-excluded"
    assert cen.prove_impossible(b"a1") == cen.prove_impossible("กิ".encode()) == "pretoken-shape"
    assert cen.prove_impossible(b"\xff") == "invalid-utf8" and cen.prove_impossible(b"\x80") is None
    assert cen.prove_impossible(b" !!\n") is None and cen.prove_impossible(b"! a") == "pretoken-shape"


def test_impossible_tokens_never_come_out(toy):
    from .cases import HAND, WHITE, random_texts

    dead = {i for i in range(toy.size) if cen.Census(toy).judge(i)[3] == "impossible"}
    for t in HAND + WHITE + random_texts(300):
        assert not dead & set(encode_binary(toy, t.encode()))


def test_witness(toy):
    row = cen.witness(toy, toy.byte_ids[0xA1])
    assert row["verdict"] == "context" and f"*{toy.byte_ids[0xA1]}" in row["ids"]


def test_fingerprint(spark, toy):
    a = fp.take(spark, toy, quick=True).persist()
    assert fp.nfc_version(a) == ("9.0", True)
    assert a.where("section = 'fold' and key = '017F'").first().value == json.dumps(["'ſ", "x"], ensure_ascii=False).replace(" ", "")
    assert fp.same(a, fp.take(spark, toy, quick=True))
    drift = a.withColumn("value", F.when(F.col("key") == "size", "1").otherwise(F.col("value"))).where("section <> 'fold'")
    assert {(r.section, r.key) for r in fp.diff(a, drift).where("section <> 'fold'").collect()} == {("pipeline", "size")}
    assert fp.diff(a, drift).where("section = 'fold'").count() == a.where("section = 'fold'").count()


def test_class_counts_of_the_pinned_version(spark):
    counts = {r["class"]: r["count"] for r in fp.class_sweep(spark).groupBy("class").count().collect()}
    assert counts["letter"] == 141028 and counts["number"] == 1911 and counts["whitespace"] + counts["blank"] + counts["newline"] == 25


def test_nfc_sweep_agrees_with_an_independent_one(spark):
    tokenizers = pytest.importorskip("tokenizers")
    norm = tokenizers.normalizers.NFC()
    rows = {(r.cp, r.form): bytes.fromhex(r.hex).decode() for r in fp.nfc_sweep(spark).collect()}
    assert len(rows) > 2000
    for cp in range(0x80, 0x30000, 3):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            assert rows.get((cp, "alone"), c) == norm.normalize_str(c), hex(cp)
            assert rows.get((cp, "after"), "a" + c) == norm.normalize_str("a" + c), hex(cp)


def test_documents_are_cut_behind_line_breaks(spark):
    data = b"x" * 8191 + b"\n" + b"y\n" * 5000 + b"z"
    cut = text.cut_documents(data)
    assert b"".join(cut) == data and all(len(d) > 8192 and d.endswith(b"\n") for d in cut[:-1])
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray())], "k long, content binary")
    assert [bytes(r.content) for r in text.split_documents(df, "k").orderBy("k", "doc").collect()] == cut


def test_unicode_files_and_sums(spark, tmp_path):
    (tmp_path / "u.txt").write_text("0041;LATIN CAPITAL LETTER A;Lu;0;L;;;;;N;;;;0061;\n0300;COMBINING GRAVE ACCENT;Mn;230;NSM;;;;;N;;;;;\n")
    assert [tuple(r)[:4] for r in text.unicode_data(spark, str(tmp_path / "u.txt")).collect()] == [(65, "LATIN CAPITAL LETTER A", "Lu", 0), (768, "COMBINING GRAVE ACCENT", "Mn", 230)]
    (tmp_path / "p.txt").write_text("# no\n0340..0341  ; NFC_QC; N # x\n0958 ; Full\n\n")
    assert [(r.first, r["last"], r.fields) for r in text.property_ranges(spark, str(tmp_path / "p.txt")).collect()] == [(0x340, 0x341, ["NFC_QC", "N"]), (0x958, 0x958, ["Full"])]
    good = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in text.read_whole(spark, str(tmp_path)).collect()}
    text.verify_sums(spark, str(tmp_path), good)
    with pytest.raises(InputError, match="u.txt"):
        text.verify_sums(spark, str(tmp_path), {**good, "u.txt": "0"})
    assert text.random_cjk(50) == text.random_cjk(50)


def test_streams(spark, toy, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:00", t) for m, t in ((0, "abc"), (0, "12"), (3, "ab<|end|>"))]
    spark.createDataFrame(rows, "ts string, text string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("encoded", encode_stream(stream, toy), "append"), ("rate", token_rate(stream, toy, "ts"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert {r.text: r.ids for r in spark.table("encoded").collect()} == {t: encode_binary(toy, t.encode()) for _, t in rows}
    assert sorted(r.n_tokens for r in spark.table("rate").collect()) == sorted([len(encode_binary(toy, b"abc")) + 2, len(encode_binary(toy, b"ab<|end|>"))])


def test_sql_functions(spark, toy):
    sql.register(spark, toy)
    row = spark.sql("select tok_encode('ab<|end|>') e, tok_encode_raw('<|end|>') r, tok_count('abc') n, tok_decode(array(262)) d, tok_nfc('é') c").first()
    assert list(row.e) == encode_binary(toy, b"ab<|end|>") and list(row.r) == encode_binary(toy, b"<|end|>", raw=True) and row.d == b"<|end|>" and row.c == "é"
    assert [r.id for r in spark.sql("select * from tok_explode('abc') order by pos").collect()] == encode_binary(toy, b"abc")


def out_of(*args):
    out = io.TextIOWrapper(io.BytesIO(), encoding="utf-8")
    with redirect_stdout(out):
        status = cli.run([str(a) for a in args])
    out.flush()
    return status, out.buffer.getvalue()


def test_command_line(tmp_path, toy):
    v, src, t = tmp_path / "v.bpv", tmp_path / "t.json", tmp_path / "t.txt"
    src.write_bytes(public_json(merges=100))
    assert out_of("convert", src, v)[0] == 0
    vocab = bpv.load(str(v))
    t.write_text("the <|im_end|> x")
    assert out_of("encode", v, t) == (0, ("\n".join(map(str, encode_binary(vocab, b"the <|im_end|> x"))) + "\n").encode())
    assert out_of("count", v, t, "--raw")[1] == f"{len(encode_binary(vocab, b'the <|im_end|> x', True))}\n".encode()
    ids = tmp_path / "ids"
    ids.write_bytes(out_of("encode", v, t)[1])
    assert out_of("decode", v, ids) == (0, b"the <|im_end|> x") and out_of("decode", v, ids, "--skip-special") == (0, b"the  x")
    assert b"size: 360" in out_of("info", v)[1]
    assert b"verdict: self" in out_of("witness", v, 300)[1]
    for bad in ("151669", "4294967295", "4294967296", "99999999999", "1 999999", "-1"):
        ids.write_text(bad)
        assert out_of("decode", v, ids)[0] == 4
    assert out_of()[0] == out_of("nope")[0] == out_of("encode")[0] == out_of("witness", v, "x")[0] == out_of("census", v, "--limit", "x")[0] == 1
    assert out_of("encode", v, tmp_path / "none")[0] == 2 and out_of("encode", t, t)[0] == 3 and out_of("encode", tmp_path / "none", t)[0] == 3
    src.write_text("{}")
    assert out_of("convert", src, v)[0] == 3


def test_command_line_census(spark, tmp_path, toy):
    bpv.save(toy, str(tmp_path / "v.bpv"))
    status, said = out_of("census", tmp_path / "v.bpv", tmp_path / "c.json", "--limit", "30")
    assert status == 0 and b"don't hold: 0" in said and len(json.loads((tmp_path / "c.json").read_text())["tokens"]) == 30


def test_command_line_fingerprints(spark, tmp_path, toy):
    from dataclasses import replace

    bpv.save(toy, str(tmp_path / "a.bpv"))
    bpv.save(replace(toy, name="other"), str(tmp_path / "b.bpv"))
    for n in "ab":
        assert out_of("fingerprint", tmp_path / f"{n}.bpv", tmp_path / f"{n}.json", "--quick")[0] == 0
    assert out_of("diff", tmp_path / "a.json", tmp_path / "a.json") == (0, b"")
    assert out_of("diff", tmp_path / "a.json", tmp_path / "b.json") == (6, b"pipeline name: toy -> other\npipeline: 1 differences\n")
    assert json.loads(out_of("dump", tmp_path / "a.bpv")[1])["merges"] == 6
    assert out_of("diff", tmp_path / "a.bpv", tmp_path / "none")[0] == 2


def test_differences(spark, toy):
    from sparktok.operators.compare import differences, first_difference, shortest_difference

    assert first_difference([1, 2], [1, 2]) is None and first_difference([1, 2], [1, 3]) == 1 and first_difference([1], [1, 2]) == 1
    a, b = (lambda t: encode_binary(toy, t.encode())), (lambda t: encode_binary(toy.with_merges(3), t.encode()))
    assert shortest_difference("xx yy zabcz 12 " * 20, a, b) in ("ab", "bc") and shortest_difference("xyz", a, b) is None
    df = spark.createDataFrame([(1, [1, 2], [1, 2]), (2, [1, 2], [1, 3]), (3, [1], [1, 2]), (4, None, [1]), (5, None, None)], "k int, a array<int>, b array<int>")
    assert {r.k: r["at"] for r in differences(df, "a", "b").where("k < 4").collect()} == {2: 1, 3: 1} and differences(df, "a", "b").count() == 3


def test_unicode_properties():
    from sparktok.functions import unicode_pins as U

    assert [U.nfc_quick_check(c) for c in (0x41, 0xE9, 0x340, 0x300, 0xF900, 0x1161, 0xAC00, 0x898, 0x1D15E, 0x958)] == [1, 1, 0, 2, 0, 2, 1, 1, 0, 0]
    assert U.combining_class(0x300) == 230 and U.combining_class(0x898) == 0 and U.combining_class(0x334) == 1
    assert U.decompose(0x1E69) == [0x73, 0x323, 0x307] and U.decompose(0xAC01) == [0x1100, 0x1161, 0x11A8] and U.decompose(0x41) == [0x41]
    assert U.compose(0x65, 0x301) == 0xE9 and U.compose(0x1100, 0x1161) == 0xAC00 and U.compose(0x41, 0x42) is None
    maybe = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and U.nfc_quick_check(c) != 1]
    assert len([c for c in maybe if U.nfc_quick_check(c) == 0]) > 1000 and 100 < len([c for c in maybe if U.nfc_quick_check(c) == 2]) < 130


def test_evidence_gate(spark, toy):
    from sparktok.errors import FormatError

    a = fp.take(spark, toy, quick=True)
    fp.require_agreement(a, a)
    with pytest.raises(FormatError, match="pipeline"):
        fp.require_agreement(a, a.where("section <> 'pipeline'"))


def test_audit(spark, toy):
    from sparktok.plans.audit import audit, markdown, strategies

    df = spark.createDataFrame([(k, f"abc {k} ab12<|end|>") for k in range(30)], "k int, text string")
    ways = {**strategies(toy, "k"), "wrong": lambda d: d.withColumn("ids", F.array(F.lit(1))), "broken": lambda d: d.select("nothing")}
    result = audit(df, ways, "k", rounds=1)
    rows = {r.strategy: r for r in result.collect()}
    assert all(rows[s].exact and rows[s].mb_per_s > 0 for s in ("arrow", "dedup", "native"))
    assert not rows["wrong"].exact and rows["wrong"].failure is None and "nothing" in rows["broken"].failure
    assert markdown(result).count("\n") == 6


def test_entry_without_the_corpus_part(tmp_path):
    """The entry point imports, and has its other queries, where the corpus part is gone."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "sparktok", tmp_path / "sparktok", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'encode_full_counts' in q and not [x for x in q if x.startswith('op')]; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0
