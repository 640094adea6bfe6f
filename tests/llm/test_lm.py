import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktok.llm import lm, registry
from sparktok.llm import text as T
from sparktok.llm.lm import DeletedInterpolation, lm_scores

from .conftest import CLASHES, SCHEMA, messy_rows, prose


def cut(text):
    ends = [m.end() for m in re.finditer(T.WORD_RE, text)]
    if len(text) > (ends[-1] if ends else 0):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def brute(rows, held, p):
    """Mean log probability of each text's tokens, over dictionaries. rows: (key, text), keys apart; held: what is learned from."""
    seqs = {k: [""] * p.order + cut((t or "").lower()) + [None] if t else [] for k, t in rows}
    own = {k: [Counter(tuple(s[i - j : i + 1]) for i in range(p.order - 1, len(s))) for j in range(p.order)] for k, s in seqs.items()}
    total = [sum((c[j] for c in own.values()), Counter()) for j in range(p.order)]
    kinds = len(total[0]) - 1
    number = sum(total[0].values()) - total[0][("",)]

    def parts(k, i):
        s, out, c = seqs[k], [1 / kinds], 0
        for j in range(p.order):
            g = tuple(s[i - j : i + 1])
            c = number - (len(s) - p.order) if j == 0 else total[j - 1][g[:-1]] - own[k][j - 1][g[:-1]]
            out.append((total[j][g] - own[k][j][g]) / c if c else 0.0)
        return (0 if c == 0 else min(p.buckets - 1, 1 + int(math.floor(math.log2(c + 0.5))))), out

    places = lambda k: range(p.order, len(seqs[k]))
    w = [[1 / (p.order + 1)] * (p.order + 1) for _ in range(p.buckets)]
    round_ = lambda x: 2.0 ** (-min(round(-8 * math.log2(x)), 510) / 8) if x else 0.0
    events = Counter((b, f[0], *map(round_, f[1:])) for k in held for i in places(k) for b, f in [parts(k, i)])
    for _ in range(p.iterations):
        mass = [[0.0] * (p.order + 1) for _ in w]
        for (b, *f), m in events.items():
            each = [x * y for x, y in zip(w[b], f, strict=True)]
            for k, x in enumerate(each):
                mass[b][k] += m * x / sum(each)
        for b, each in enumerate(mass):
            if sum(each) > 0:
                new = [max(x / sum(each), 1e-6 if k == 0 else 0.0) for k, x in enumerate(each)]
                w[b] = [x / sum(new) for x in new]
    out = {}
    for k, _ in rows:
        logs = [math.log(sum(x * y for x, y in zip(w[b], f, strict=True))) for i in places(k) for b, f in [parts(k, i)]]
        out[k] = (len(logs), sum(logs) / max(len(logs), 1))
    return out


@pytest.mark.parametrize("order, small", [(2, False), (3, False), (3, True), (1, False)])
def test_scores_agree_with_brute_force(spark, order, small):
    rows = [(k, prose(k % 17, 12 + k % 5) + (" é漢 «x» " if k % 9 == 0 else "")) for k in range(60)] + [(60, ""), (61, None), (62, "A"), (63, " ... ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    p = DeletedInterpolation(order=order, folds=3, iterations=3, **({"chunk": 300, "part": 90, "tasks": 7} if small else {}))
    held = {r.doc_id for r in df.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(p.folds)) == 0).collect()}
    assert 5 < len(held) < 40
    want = brute(rows, held, p)
    got = {r.doc_id: r for r in lm_scores(df, p).collect()}
    assert set(got) == set(want)
    for k, (n, mean) in want.items():
        assert got[k].n_tokens == n and abs(got[k].logprob - mean) < 1e-6, k
    assert got[60].bits_per_byte is None and got[61].n_bytes == 0 and got[63].n_bytes == 5
    k = 5
    assert abs(got[k].bits_per_byte + got[k].logprob * got[k].n_tokens / got[k].n_bytes / math.log(2)) < 1e-9


def test_copies_and_the_order_of_words_tell(spark, tmp_path):
    """A document that occurs twice is told from those that occur once, and from one of the same words in another order."""
    rows = [(k, prose(k, 40)) for k in range(60)] + [(100 + k, prose(k, 40)) for k in range(20)] + [(200, " ".join(reversed(prose(3, 40).split())))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.logprob for r in registry.op10_lm_scoring(spark, str(tmp_path)).collect()}
    assert min(got[k] for k in range(20)) > max(got[k] for k in [*range(20, 60), 200]) + 1


def test_what_is_gathered_follows_the_corpus(spark):
    def kinds(n):
        rows = pa.array([prose(k, 50).lower() for k in range(n)])
        return len(lm.Grams(rows, DeletedInterpolation(), 64).key[2])

    assert kinds(80) > 1.8 * kinds(40)


def test_junk_scores_worse(spark):
    draw = random.Random(1)
    rows = [(k, prose(k, 40)) for k in range(80)] + [(100, " ".join("".join(draw.choice("qwxzj#%&") for _ in range(9)) for _ in range(20)))]
    got = {r.doc_id: r.bits_per_byte for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] > max(got[k] for k in range(80))


def test_packing_is_a_round_trip():
    draw = np.random.default_rng(2)
    for v in ([], [0], [0, 0], [2**64 - 1, 0, 5], draw.integers(0, 2**40, 1000), np.ones(5000)):
        v = np.array(v, np.uint64)
        got, at = lm.unpack(b"xx" + lm.pack(v) + b"yy", 2)
        assert got.tolist() == v.tolist() and at == len(lm.pack(v)) + 2
    keys = np.unique(draw.integers(0, 2**48, 500_000).astype(np.uint64))
    assert len(lm.pack(np.diff(keys, prepend=np.uint64(0)))) < 4.2 * len(keys)


def test_distinct_keys_are_those_of_unique():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 1000, 70_000):
        for top in (1, 20, 50, 63):
            key = draw.integers(0, 2**top, n).astype(np.uint64) << np.uint64(63 - top)
            # half differ from the others in the lowest bit at most, which isn't sorted with the places
            key[n // 2 :] = key[: n - n // 2] ^ draw.integers(0, 2, n - n // 2).astype(np.uint64)
            for got, want in zip(lm.distinct(key), np.unique(key, return_inverse=True, return_counts=True), strict=True):
                assert got.tolist() == want.tolist()


def test_n_grams_take_a_few_times_as_long_as_words():
    """What grows with the table is this, twice a text."""
    rows = pa.array([prose(k, 2000).lower() for k in range(150)])

    def least(run):
        took = []
        for _ in range(7):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    words = least(lambda: T.words(*T.buffers(rows)))
    assert least(lambda: lm.Grams(rows, DeletedInterpolation(), 56)) < 4.5 * words


def test_odd_tables(spark, messy, plain, empty):
    key = lambda df: sorted(f"{r.doc_id} {r.n_bytes} {r.n_tokens} {r.logprob:.6f}" for r in df.collect())
    a, b = lm_scores(messy), lm_scores(plain)
    assert a.count() == len(messy_rows()) and key(a) == key(b)
    assert lm_scores(empty).count() == 0
    only = lm_scores(spark.createDataFrame([(5, None), (6, "")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.logprob, r.bits_per_byte) for r in only] == [(0, 0.0, None)] * 2
    assert lm_scores(spark.createDataFrame([(5, "one word")], "doc_id long, text string")).first().logprob < 0
    more = plain.withColumns({c: F.lit("x") for c in ("chunk", "part", "answer", "held", "texts", "cell") if c not in CLASHES})
    assert key(lm_scores(more)) == key(b)
    with pytest.raises(ValueError):
        lm_scores(empty, DeletedInterpolation(order=7))


def test_a_hot_word_and_a_long_text_stay_whole(spark):
    """A third of all tokens is one word, and one text is longer than many chunks."""
    rows = [(k, "hot " * 300 + prose(k, 30)) for k in range(30)] + [(99, prose(99, 20_000))]
    df = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA)
    a = {r.doc_id: round(r.logprob, 9) for r in lm_scores(df).collect()}
    b = {r.doc_id: round(r.logprob, 9) for r in lm_scores(df.repartition(5), DeletedInterpolation(chunk=1000, part=10_000)).collect()}
    assert a == b and len(a) == 31


def test_the_texts_do_not_move_for_their_answers(spark):
    """Scores join answers to the bucketed chunks by one shuffle, that of the answers."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plans = []
    save = lm.Scratch.save

    def spy(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return save(self, df, name)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm.Scratch, "save", spy)
        lm_scores(docs, DeletedInterpolation(chunk=200_000)).count()
    plan = dict(plans)["scores"]
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1
