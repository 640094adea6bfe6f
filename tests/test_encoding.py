import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktok.errors import ArgumentError, RangeError
from sparktok.functions import columns as C
from sparktok.functions.bytes_path import encode_binary, encode_bytes_column, split
from sparktok.functions.unicode_pins import JAVA_LETTERS, JAVA_NUMBERS, MAY_CHANGE, PROFILE_1, SPLIT_JAVA, UNSTABLE, char_class, nested_class, nfc
from sparktok.operators.batch_bpe import PairTable, merge_many
from sparktok.operators.bpe import encode_bytes, merge_long, merge_short
from sparktok.operators.vocab import from_tokenizer_json, public_json, toy_json
from sparktok.plans import dedup
from sparktok.plans.encoding import decode_join, encode, pretokens, token_frequencies

from .cases import HAND, WHITE, random_texts, sweep

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def full():
    raw = public_json()
    return from_tokenizer_json(raw, "public"), tokenizers.Tokenizer.from_str(raw.decode())


@pytest.fixture(scope="module")
def toy():
    raw = toy_json()
    return from_tokenizer_json(raw, "toy"), tokenizers.Tokenizer.from_str(raw.decode())


@pytest.fixture(scope="module")
def texts():
    out = HAND + WHITE + random_texts(600) + sweep(97)
    assert len(out) > 800
    return out


def expected(oracle, texts):
    return [e.ids for e in oracle.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["full", "toy"])
def test_columns_and_bytes_agree_with_an_independent_encoder(spark, which, texts, request):
    vocab, oracle = request.getfixturevalue(which)
    want = expected(oracle, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    got = {r.i: r for r in df.select("i", C.encode("t", vocab).alias("e"), C.token_count("t", vocab).alias("n"), encode_bytes_column(F.encode("t", "utf-8"), vocab).alias("b")).collect()}
    for i, w in enumerate(want):
        assert list(got[i].e) == w, texts[i]
        assert got[i].n == len(w)
        assert list(got[i].b) == w, texts[i]


def test_strategies_agree(spark, toy, texts):
    vocab, _ = toy
    rows = [(i, t) for i, t in enumerate(texts[:400])] + [(9999, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    want = {r.i: (r.ids, r.n_tokens) for r in encode(df, vocab, "t").collect()}
    assert want[9999] == (None, None) and want[0] == ([], 0)
    for strategy in ("dedup", "native"):
        got = {r.i: (r.ids, r.n_tokens) for r in encode(df, vocab, "t", strategy=strategy, key="i").collect()}
        assert got == want, strategy
        counted = {r.i: r.n_tokens for r in encode(df, vocab, "t", strategy=strategy, key="i", ids=False).collect()}
        assert counted == {k: v[1] for k, v in want.items()}
    with pytest.raises(ArgumentError):
        encode(df, vocab, "t", strategy="dedup")


def test_dedup_moves_distinct_pretokens_of_chunks(spark, toy, texts, tmp_path):
    vocab, _ = toy
    spark.createDataFrame([*enumerate(texts[:300]), (9999, None)], "i int, t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    # no row a pretoken, and splitting is in the plan once
    for ids in (True, False):
        plan = encode(df, vocab, "t", strategy="dedup", key="i", ids=ids).drop("t")._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and plan.count("MapInArrow") == 2
    # chunks of any size give the same
    want = {r.i: (r.ids, r.n_tokens) for r in encode(df, vocab, "t").collect()}
    for size in (1, 500):
        assert {r["__key"]: (r.ids, r.n_tokens) for r in dedup.encoded(df, vocab, "t", False, "i", True, size).collect()} == want
    assert dedup.encoded(df.where("i < 0"), vocab, "t", False, "i", True).count() == 0


def test_raw_mode_takes_added_tokens_for_text(spark, full):
    vocab, _ = full
    bare = json.loads(public_json())
    bare["added_tokens"] = []
    oracle = tokenizers.Tokenizer.from_str(json.dumps(bare))
    texts = ["<|im_start|>user", "a<think>b", "<|endoftext|>", "x<|im_end|>\n<|im_end|>", "<think>", "no token"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.e for r in df.select("i", C.encode("t", vocab, raw=True).alias("e")).collect()}
    assert [got[i] for i in range(len(texts))] == expected(oracle, texts)


def test_added_tokens_are_leftmost_then_longest(spark):
    source = json.loads(toy_json())
    option = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
    source["added_tokens"] += [{"id": 264 + k, "content": c, "special": False, **option} for k, c in enumerate(["<a", "<a>", "<a>b", "\\Eq", "a\\"])]
    raw = json.dumps(source).encode()
    vocab, oracle = from_tokenizer_json(raw), tokenizers.Tokenizer.from_str(raw.decode())
    texts = ["<a>bc", "<a>c", "<ac", "<<a>b<a", "x\\Eqy", "a\\Eq", "<a>b\n<|end|>[PAD]", "<a" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.e for r in df.select("i", C.encode("t", vocab).alias("e")).collect()}
    assert [got[i] for i in range(len(texts))] == expected(oracle, texts)


def test_pretokens_partition_and_classes(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(F.array_join(C.pretokenize("t"), "") != F.col("t")).isEmpty()
    labels = {r.p: r.c for r in spark.createDataFrame([(x,) for x in ("'s", " the", "1", "!!\n", "\n", " ")], "p string").select("p", C.split_class("p").alias("c")).collect()}
    assert labels == {"'s": "A1", " the": "A2", "1": "A3", "!!\n": "A4", "\n": "A5", " ": "A6-7"}
    for t in texts:
        assert "".join(split(t)) == t


def test_give_back_is_one_codepoint(spark):
    row = spark.createDataFrame([("x  　　y",)], "t string").select(C.pretokenize("t")).first()[0]
    assert row == ["x", "  　", "　y"]


def test_nfc_is_of_version_9(spark, texts):
    norm = tokenizers.normalizers.NFC()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", C.normalize("t").alias("n")).collect():
        assert r.n == norm.normalize_str(r.t) == nfc(r.t)
        assert nfc(r.n) == r.n
    draw = random.Random(3)
    marks = [0x300, 0x323, 0x334, 0x898, 0x1DF6, 0x1161, 0x11A8, 0xAC00, 0x41, 0x11930, 0x3099, 0x304B]
    for _ in range(3000):
        t = "".join(chr(draw.choice(marks)) for _ in range(draw.randrange(1, 8)))
        assert nfc(t) == norm.normalize_str(t), [hex(ord(c)) for c in t]


def test_classes_compare_a_character_with_few_ranges(spark):
    for pattern in (MAY_CHANGE, SPLIT_JAVA):
        assert max(x.count("\\x{") for x in re.findall(r"\[((?:\\x\{[0-9A-F]+\}-?)+)\]", pattern)) <= 8
    cps = spark.range(1, 0x110000).where("id not between 55296 and 57343").select(F.col("id").cast("int"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    for ranges in (UNSTABLE, JAVA_LETTERS, JAVA_NUMBERS):
        got = {r.id for r in cps.where(F.col("c").rlike(nested_class(ranges))).select("id").collect()}
        assert got == {cp for a, b in ranges for cp in range(a, b + 1)}


def test_classes_agree_with_the_encoder_over_all_codepoints():
    split_ = tokenizers.pre_tokenizers.Split(tokenizers.Regex(PROFILE_1), "isolated")
    for cp in range(1, 0x110000, 7):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        pieces = (len(split_.pre_tokenize_str(f"a{c}a")), len(split_.pre_tokenize_str(f"!{c}!")))
        k = char_class(cp)
        want = {1: (1, 2), 2: (3, 3), 12: (3, 2), 0: (2, 1), 4: (2, 2) if cp == 32 else (2, 3)}[k]
        assert pieces == want, hex(cp)


def test_merging_short_long_and_many_agree(full):
    vocab, _ = full
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdenrst ") for _ in range(draw.randrange(1, 150))).encode() for _ in range(400)] + [b"a" * n for n in (1, 2, 3, 63, 64, 65, 200)]
    ids = [[vocab.byte_ids[b] for b in w] for w in words]
    short = [merge_short(i, vocab.pairs) for i in ids]
    assert [merge_long(i, vocab.pairs) for i in ids] == short
    assert [encode_bytes(w, list(vocab.byte_ids), vocab.pairs) for w in words] == short
    import numpy as np

    data, off = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])
    got, end = merge_many(data, off, np.array(vocab.byte_ids, np.int32), PairTable(vocab.merges), vocab.merge)
    assert [got[end[k] : end[k + 1]].tolist() for k in range(len(words))] == short


def test_decoding(spark, full):
    vocab, oracle = full
    texts = ["a<think>b<|im_end|>c", "héllo wörld", "", "日本語"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.encode("t", vocab).alias("ids"))
    for r in df.select("i", C.decode("ids", vocab).alias("d"), C.decode_text("ids", vocab, True).alias("s")).collect():
        assert r.d == texts[r.i].encode()
        assert r.s == texts[r.i].replace("<|im_end|>", "")
    joined = {r.i: bytes(r.bytes) for r in decode_join(df, vocab, "i").collect()}
    assert joined == {i: t.encode() for i, t in enumerate(texts)}
    skipped = {r.i: bytes(r.bytes) for r in decode_join(df, vocab, "i", skip_special=True).collect()}
    assert skipped[0] == b"a<think>bc"
    for ids in ([vocab.size], [4294967295], [5, -1], [5, vocab.size]):
        with pytest.raises(RangeError):
            vocab.decode(ids)
    odd = spark.createDataFrame([(0, [vocab.size]), (1, [5]), (2, None)], "i int, ids array<int>")
    assert {r.i: r.d for r in odd.select("i", C.decode("ids", vocab, errors="null").alias("d")).collect()} == {0: None, 1: vocab.tokens[5], 2: None}
    with pytest.raises(Exception, match="not below"):
        odd.select(C.decode("ids", vocab)).collect()


def test_unused_ids_are_out_of_range(toy):
    vocab = toy[0].with_merges(2)
    hole = next(i for i, t in enumerate(vocab.tokens) if not t)
    with pytest.raises(RangeError):
        vocab.decode([hole])


def test_bytes_that_are_no_text(full):
    vocab, _ = full
    draw = random.Random(99)
    cases = [b"", b"\xff", b"\xc3", b"\xe4\xb8", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf5\x80\x80\x80", b"\xc5\xff\x80" * 50, "é".encode() + b"\xcc" + "́".encode()]
    cases += [bytes(draw.randrange(256) for _ in range(n)) for n in (1, 2, 7, 100, 4096) for _ in range(10)]
    for data in cases:
        ids = encode_binary(vocab, data)
        assert all(0 <= i < vocab.size for i in ids)
        text = data.decode("utf-8", "surrogateescape")
        if not text.isascii() and nfc("".join(c for c in text if not "\udc80" <= c <= "\udcff")) != "".join(c for c in text if not "\udc80" <= c <= "\udcff"):
            continue
        assert vocab.decode(ids) == data


def test_columns_of_bytes_that_are_no_text(spark, full, toy):
    rng = random.Random(7)
    bad = [b"\xff", b"\xc3", b"\xe2\x82", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\x80\xbf", b"\xf0\x9f"]
    good = [b"it's", b" 12 ", "e\u0301\u0323".encode(), "\u65e5\u672c".encode(), b"\r\n\n", b"<|im_end|>", b"<|end|>", "\u20ac".encode(), b"  ", b"word"]
    own = ["\U0010ff80".encode(), "\U0010ffff".encode(), b"\xf4\x8f\xbe", "\U0010ff7f".encode()]
    rows = [b"", None, *bad, *(b"".join(rng.choices(bad + good, k=rng.randint(1, 12))) for _ in range(300)), *(b"".join(rng.choices(bad + good + own, k=8)) for _ in range(60))]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(rows)], "i int, b binary").repartition(3)
    for vocab, _ in (full, toy):
        for raw in (False, True):
            got = {r.i: r.ids for r in df.select("i", encode_bytes_column("b", vocab, raw).alias("ids")).collect()}
            assert got == {i: None if b is None else encode_binary(vocab, b, raw) for i, b in enumerate(rows)}
    # split in the JVM
    plan = df.select(encode_bytes_column("b", toy[0]).alias("ids"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" in plan


def test_a_filter_on_counts_does_not_encode_twice(spark, toy, tmp_path):
    spark.createDataFrame([(1, "ab 12<|end|>c"), (2, "a")], "k int, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for ids in (False, True):
        over = encode(df, toy[0], ids=ids).where("n_tokens > 2").select("k", "n_tokens")
        plan = over._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 2 and over.count() == 1


def test_decoding_stays_in_the_worker_that_encodes(spark, toy, tmp_path):
    spark.createDataFrame([(1, "ab 12<|end|>c")], "k int, text string").write.parquet(str(tmp_path / "t"))
    coded = spark.read.parquet(str(tmp_path / "t")).select(C.encode("text", toy[0]).alias("ids"))
    back = coded.select(C.decode("ids", toy[0]).alias("b"))
    assert back._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 2
    assert bytes(back.first().b) == b"ab 12<|end|>c"
    assert bytes(spark.sql("select array(1L, null) x, array('1', '2') s").select(C.decode("s", toy[0]).alias("b")).first().b) == b"".join(toy[0].tokens[1:3])


def test_batches_and_what_a_worker_remembers_are_bounded(spark, toy):
    C.encode("text", toy[0], spark=spark)
    assert int(spark.conf.get(C.BATCH).rstrip("b")) <= 8 << 20

    class Shared:
        value = toy[0]

    before = dict(C._WORKER)
    C._WORKER.clear()
    for k in range(5):
        C.Merger(Shared, f"k{k}").ids(pa.array(["ab", "c"]))
    assert list(C._WORKER) == ["k3", "k4"]
    C.Merger(Shared, "k3").ids(pa.array(["ab"]))
    C.Merger(Shared, "k5").ids(pa.array(["ab"]))
    assert list(C._WORKER) == ["k3", "k5"]
    C._WORKER.clear()
    C._WORKER.update(before)


def test_truncation_keeps_the_count(spark, toy):
    row = spark.createDataFrame([("abcabc",)], "t string").select(C.encode("t", toy[0]).alias("e")).select(C.truncate("e", 2).alias("cut"), F.size("e").alias("n")).first()
    assert len(row.cut) == 2 and row.n == len(encode_binary(toy[0], b"abcabc"))


def test_id_lists(spark, toy):
    df = spark.createDataFrame([("1 2,x3\n-1 4294967296 99999999999999999999",)], "t string")
    assert df.select(C.parse_ids("t")).first()[0] == [1, 2, 3, -1, 4294967296, -1]
    assert spark.createDataFrame([([1, 22],)], "i array<int>").select(C.format_ids("i")).first()[0] == "1\n22"
    assert spark.createDataFrame([("a\x01\x7fb\n",)], "t string").select(C.sanitize("t")).first()[0] == "a\\x01\\x7fb\\x0a"


def test_pretoken_rows_and_frequencies(spark, toy):
    df = spark.createDataFrame([(1, "ab 12<|end|>c"), (2, ""), (3, None)], "k int, text string")
    rows = sorted((r.k, r.seg, r.pos, r.pretoken, r.added) for r in pretokens(df, toy[0]).collect())
    assert rows == [(1, 0, 0, "ab", ""), (1, 0, 1, " ", ""), (1, 0, 2, "1", ""), (1, 0, 3, "2", ""), (1, 0, 4, "", "<|end|>"), (1, 1, 0, "c", "")]
    freq = {r.id: r.n for r in token_frequencies(df, toy[0]).collect()}
    assert freq[262] == 1 and sum(freq.values()) == len(encode_binary(toy[0], b"ab 12<|end|>c"))


def test_plans_stay_in_the_jvm_and_read_only_what_they_need(spark, toy, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "ab", "x")], "k int, text string, more string").write.parquet(path)
    df = spark.read.parquet(path)
    plan = encode(df.select("k", "text"), toy[0], ids=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "more" not in plan
    native = encode(df, toy[0], strategy="native", key="k", ids=False).select("k", "n_tokens")
    assert "BatchEvalPython" not in native._jdf.queryExecution().executedPlan().toString()
