import base64
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktok.llm import chat, langid, mixing, topk

from .conftest import SCHEMA, messy_rows, prose

# language ID


@pytest.fixture(scope="module")
def vocabulary():
    with open(langid.VOCABULARY, "rb") as f:
        return {base64.b64decode(line.split()[0]) for line in f if line.strip()}


def test_forward_sums_all_segmentations(docs, vocabulary):
    model = langid.train(docs)
    v = langid.pieces(langid.VOCABULARY)

    def number(piece):
        h = sum(int(langid.T._BYTE[b]) * pow(int(langid.T._M), k, 1 << 64) for k, b in enumerate(piece)) % (1 << 64)
        return int(np.searchsorted(v.members.values, np.uint64(h)))

    for word in ["the", "straße", "éclair", "x" * 20, "漢", "a"]:
        data = (" " + word).encode()
        total = [np.ones(len(model.languages))] + [np.zeros(len(model.languages))] * len(data)
        for e in range(1, len(data) + 1):
            total[e] = sum(total[s] * model.probability[number(data[s:e])] for s in range(e) if data[s:e] in vocabulary)
        assert np.allclose(np.log(total[-1]), model.score(pa.array([word]))[0][0], atol=1e-9)


def test_expected_counts_agree_with_enumeration(vocabulary):
    v = langid.pieces(langid.VOCABULARY)
    data, off = np.frombuffer(b" the", np.uint8), np.array([0, 4])
    p = np.full(v.size, 1e-3)
    p[:] = np.random.default_rng(0).uniform(1e-4, 1e-2, v.size)
    edges = v.edges(data, off)
    span = {(int(s), int(e)): int(k) for s, e, k, _ in zip(*edges, strict=True)}

    def ways(at):
        if at == 4:
            yield []
        for e in range(at + 1, 5):
            if (at, e) in span:
                for rest in ways(e):
                    yield [span[at, e], *rest]

    every = list(ways(0))
    weight = [math.prod(p[k] for k in w) for w in every]
    want = np.zeros(v.size)
    for w, x in zip(every, weight, strict=True):
        for k in w:
            want[k] += 3 * x / sum(weight)
    assert len(every) > 2 and np.allclose(langid.expected(edges, off, p, np.array([3.0])), want)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = langid.language_id(test, model=langid.train(train)).withColumnRenamed("lang", "said").join(test, "doc_id")
    assert got.where("said = lang").count() >= 0.99 * got.count()
    assert got.where("accepted").count() >= 0.995 * got.count()


def test_languages_of_odd_tables(spark, messy, plain, empty):
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    a, b = langid.language_id(messy), langid.language_id(plain)
    assert a.count() == len(messy_rows()) and key(a.select("doc_id", "lang", "accepted")) == key(b.select("doc_id", "lang", "accepted"))
    rows = {r.doc_id: r for r in b.where("doc_id in (5, 6, 7, 11)").collect()}
    assert all(r.lang is None and not r.accepted for r in rows.values()) and len(rows) == 4
    kept = langid.keep_known_languages(messy)
    assert kept.columns == messy.columns and not {5, 6, 7, 11} & {r.doc_id for r in kept.collect()}
    assert langid.language_id(empty).count() == 0 and langid.keep_known_languages(empty).count() == 0
    unlabelled = plain.withColumn("lang", F.lit(None).cast("string"))
    assert langid.language_id(unlabelled).where("accepted").count() == 0
    one = plain.withColumn("lang", F.lit("en"))
    assert langid.language_id(one).where("accepted and doc_id = 1").count() == 1


def test_long_words_are_summed_whole(docs, vocabulary, monkeypatch):
    """Words of many stretches, and of letters of two bytes, against a plain sum in logarithms over all pieces that fit."""
    model = langid.train(docs)
    v = langid.pieces(langid.VOCABULARY)
    monkeypatch.setattr(langid, "STRETCH", 50)

    def number(piece):
        h = sum(int(langid.T._BYTE[b]) * pow(int(langid.T._M), k, 1 << 64) for k, b in enumerate(piece)) % (1 << 64)
        return int(np.searchsorted(v.members.values, np.uint64(h)))

    longest = max(map(len, vocabulary))
    for word in ["достопримечательностьдостопримечательность", "x" * 400, "donaudampfschifffahrtsgesellschaftskapitän", "ab" * 16]:
        data = (" " + word).encode()
        total = [np.zeros(len(model.languages))] + [np.full(len(model.languages), -np.inf)] * len(data)
        for e in range(1, len(data) + 1):
            for s in range(max(0, e - longest), e):
                if data[s:e] in vocabulary:
                    total[e] = np.logaddexp(total[e], total[s] + np.log(model.probability[number(data[s:e])]))
        logs, count, size = model.score(pa.array([word, "a b"]))
        assert np.allclose(logs[0], total[-1], rtol=1e-9) and count.tolist() == [1, 2] and size.tolist() == [len(data), 4]
    assert v.longest == longest


def test_words_that_are_kept_score_the_same(docs, monkeypatch):
    """Scores are the same whether a word was seen before, and when the store is full."""
    import pickle

    model = langid.train(docs)
    col = pa.array([(r.text or "").lower() for r in docs.limit(60).collect()])
    want = model.score(col)[0]
    assert len(model.known[0]) > 100 and np.array_equal(model.score(col)[0], want)
    monkeypatch.setattr(langid, "KEPT", 50)
    again = pickle.loads(pickle.dumps(model))
    assert not len(again.known[0])
    for i in range(0, 60, 7):
        # sums start at another text, so their last bits may differ
        assert np.allclose(again.score(col.slice(i, 7))[0], want[i : i + 7], rtol=1e-12)
    assert len(again.known[0]) <= 50


def test_expected_counts_of_long_words_agree_with_those_of_short_ones():
    v = langid.pieces(langid.VOCABULARY)
    p = np.random.default_rng(0).uniform(1e-4, 1e-2, v.size)
    data, off = np.frombuffer(" straßenbahn".encode(), np.uint8), np.array([0, 13])
    want = langid.expected(v.edges(data, off), off, p, np.array([3.0]))
    assert np.allclose(langid.expected_log(v, data, np.log(p), 3.0), want)
    assert np.allclose(langid.whole_log(v, data, np.log(p)[:, None])[0], np.log(langid.forward(v.edges(data, off), off, p[:, None])[1][0, 0]))


@pytest.mark.parametrize("ids", ["null", "same", "copies"])
def test_the_sample_is_bounded_for_any_ids(spark, monkeypatch, ids):
    """Rows without ids, of one id, or of one text: at most ``sample`` texts of a language are trained on."""
    rows = [({"null": None, "same": 7, "copies": k}[ids], f"w{k % 3 if ids == 'copies' else k} x{k % 3 if ids == 'copies' else k}", "en") for k in range(3000)]
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda counts, p: seen.update(counts))
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.LangId(sample=10))
    assert len(seen["en"]) == (6 if ids == "copies" else 20) and (ids != "copies" or set(seen["en"].values()) == {1})


def test_judgement_agrees_with_a_plain_version(spark, docs, vocabulary):
    """Training, margin, floor and rejection again, over dictionaries, with a vocabulary cut to what the words need."""
    p = langid.LangId(sample=12, iterations=2)
    rows = [(r.doc_id, (r.text or "").lower(), r.lang) for r in docs.collect()] + [(9001, "", "en"), (9002, "??", "de"), (9003, "word", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    languages = sorted({x for _, _, x in rows if x})
    counts = {}
    for x in languages:
        first = sorted({(hashes[i], t) for i, t, y in rows if y == x})[: p.sample]
        counts[x] = Counter(w for _, t in first for w in langid.T.word_list(t))
    size = len(vocabulary)

    def ways(word):
        data = (" " + word).encode()
        return data, [(s, e, data[s:e]) for s in range(len(data)) for e in range(s + 1, len(data) + 1) if data[s:e] in vocabulary]

    def chance(word, prob):
        data, edges = ways(word)
        a = [1.0] + [0.0] * len(data)
        for s, e, g in edges:
            a[e] += a[s] * prob.get(g, prob[None])
        return a

    models = {}
    for x in languages:
        prob = {None: 1 / size}
        for _ in range(p.iterations):
            c = Counter()
            for w, n in counts[x].items():
                data, edges = ways(w)
                a, b = chance(w, prob), [0.0] * len(data) + [1.0]
                for s, e, g in sorted(edges, key=lambda z: -z[0]):
                    b[s] += prob.get(g, prob[None]) * b[e]
                for s, e, g in edges:
                    c[g] += n * a[s] * prob.get(g, prob[None]) * b[e] / a[-1]
            total = sum(c.values())
            prob = {None: p.least, **{g: max(v / total, p.least) for g, v in c.items()}}
        models[x] = prob
    got = {r.doc_id: r for r in langid.language_id(df, p).collect()}
    checked = 0
    for i, t, _ in rows:
        words = langid.T.word_list(t)
        if len(words) > 120 or any(len(w.encode()) > 30 for w in words):
            continue
        checked += 1
        if not words:
            assert got[i].lang is None and not got[i].accepted
            continue
        logs = sorted(((sum(math.log(chance(w, models[x])[-1]) for w in words), x) for x in languages), key=lambda z: (-z[0], z[1]))
        margin, per = (logs[0][0] - logs[1][0]) / len(words), logs[0][0] / sum(len(w.encode()) + 1 for w in words)
        assert got[i].lang == logs[0][1] and abs(got[i].margin - margin) < 1e-6 and abs(got[i].score - per) < 1e-6
        assert got[i].accepted == (margin >= p.margin and per >= p.floor)
    assert checked > 20


def test_rare_words_of_the_sample_are_trained_on(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda counts, p: seen.update(counts))
    langid.train(spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(48_000)), "en")], "doc_id long, text string, lang string"))
    assert len(seen["en"]) == 48_000


# top-k


def brute_topk(rows, k):
    out = {}
    for i, x in rows:
        near = sorted((math.dist(x, y), j) for j, y in rows if j != i and len(y) == len(x))[:k]
        out[i] = [(j, round(d, 6)) for d, j in near]
    return out


def found(df, p):
    out = defaultdict(list)
    for r in topk.top_k(df, p).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.neighbor_id, r.distance))
        assert len(out[r.query_id]) == r.rank
    return dict(out)


@pytest.mark.parametrize("p", [topk.TopK(k=5, leaf=8, batch=16, shard_rows=100, sample=150), topk.TopK(k=3, leaf=4, batch=8, block=7, shard_rows=30, every=2), topk.TopK(k=7, every=9)], ids=str)
def test_topk_agrees_with_brute_force(spark, p):
    draw = np.random.default_rng(3)
    x = np.concatenate([draw.normal(size=(250, 6)), draw.normal(size=(100, 6)) * 0.01 + 5, np.repeat(draw.normal(size=(5, 6)), 12, 0), np.zeros((20, 6))])
    x = np.round(x, 3)
    rows = [(int(i), v.tolist()) for i, v in zip(draw.permutation(len(x)) * 3, x, strict=True)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), p), {i: x for i, x in brute_topk(rows, p.k).items() if i % p.every == 0}
    assert got.keys() == want.keys()
    for i in want:
        assert [d for _, d in got[i]] == [d for _, d in want[i]], i
        # of equal distances the smaller id: only sums that differ in the last bit may swap
        assert got[i] == want[i] or sorted(got[i]) == sorted(want[i])


def test_a_third_of_all_vectors_may_be_equal(spark):
    """Equal vectors can't be split by any plane: they are cut by their ids, and ties go to the smallest of these."""
    draw = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(400 + i, draw.normal(size=3).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, np.array(x, np.float32).astype(float).tolist()) for i, x in rows]
    p = topk.TopK(every=40, k=5, leaf=16, shard_rows=60)
    got, want = found(df, p), brute_topk(rows, p.k)
    assert got.keys() == {i for i in range(1200) if i % 40 == 0} and all(got[i] == want[i] for i in got)
    assert got[80] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0), (4, 0.0)]


def test_far_shards_are_not_visited(spark, monkeypatch):
    """Clusters that lie apart: a query looks into its own shard, and into others only as far as the kth distance reaches."""
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(size=(200, 4)) + 1000 * k for k in range(8)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    turns = []
    save = topk.Scratch.save
    monkeypatch.setattr(topk.Scratch, "save", lambda self, df, name: turns.append(name) or save(self, df, name))
    got = found(df, topk.TopK(every=10, k=5, shard_rows=200))
    assert len(got) == 160 and sum(t.startswith("state") for t in turns) <= 4
    want = brute_topk([(i, v.tolist()) for i, v in enumerate(x)], 5)
    assert all([d for _, d in got[i]] == [d for _, d in want[i]] for i in got)


def test_packed_trees_are_the_same_trees():
    draw = np.random.default_rng(7)
    tree = topk.KdTree(draw.normal(size=(500, 5)), np.arange(500), 20)
    again = topk._unpacked(topk._packed(tree))
    q = draw.normal(size=(40, 5))
    for a, b in zip(*(t.search(q, np.full(40, -1), np.full(40, np.inf), 6) for t in (tree, again)), strict=True):
        assert a.tolist() == b.tolist()


def test_topk_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [0.0, 0.0]), (8, [1.0]), (9, [3.0]), (10, [1.0, 2.0, 3.0]), (11, [5.0, 5.0]), (11, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, query string, shard int")
    assert found(df, topk.TopK()) == {1: [(2, 1.0), (11, 1.0)], 2: [(1, 1.0), (11, round(math.sqrt(2), 6))], 11: [(1, 1.0), (2, round(math.sqrt(2), 6))], 8: [(9, 2.0)], 9: [(8, 2.0)]}
    assert topk.top_k(df.where("vec_id < 0")).count() == 0
    assert topk.top_k(df.where("vec_id = 10")).count() == 0


# chat


def test_append_trailer_and_rewrite():
    m = [{"role": r, "content": c} for r, c in (("user", "hi"), ("assistant", "yo"), ("user", "<think>"), ("assistant", ""))]
    whole = chat.chatml(m)
    for k, (status, s, e, again) in enumerate(chat.spans(chat.chatml, m)):
        assert status == "append" and again is None and whole[s:e] == chat.chatml(m[k : k + 1])
    whole = chat.closed(m)
    for k, (status, s, e, again) in enumerate(chat.spans(chat.closed, m)):
        assert status == "trailer" and again is None and whole[s:e] == chat.closed(m[k : k + 1])[3:-4]
    got = chat.spans(chat.reasoning, m)
    assert [x[0] for x in got] == ["append", "append", "rewrite", "append"] and [x[3] for x in got] == [None, 3, None, None]


def test_black_boxes():
    m = [{"role": "user", "content": c} for c in ("a", "b", "c", "d")]

    def strict(x):
        if not x or len(x) == 3:
            raise ValueError
        return "".join(y["content"] for y in x)

    assert chat.spans(strict, m) == [("append", 0, 1, None), ("append", 1, 2, None), ("error", None, None, None), ("append", 2, 4, None)]
    assert [x[3] for x in chat.spans(lambda x: f"{len(x)}:" + "".join(y["content"] for y in x), m)] == [2, 3, 4, None]
    window = chat.spans(lambda x: "".join(y["content"] for y in x[-2:]), m)
    assert [x[0] for x in window] == ["append", "append", "rewrite", "rewrite"]
    assert chat.spans(lambda x: "same", m) == [("append", 4, 4, None)] * 4

    def vandal(x):
        for y in x:
            y["content"] = y["content"].upper()
        return chat.chatml(x)

    chat.spans(vandal, m)
    assert m[0]["content"] == "a"


def test_common_ends_agree_with_brute_force():
    draw = random.Random(1)
    for _ in range(500):
        a, b = ("".join(draw.choice("ab") for _ in range(draw.randrange(12))) for _ in range(2))
        assert chat.common_prefix(a, b) == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert chat.common_suffix(a, b) == chat.common_prefix(a[::-1], b[::-1])


def test_turns_of_odd_tables(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, None, None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "user", "q"), (2, None, "user", "q"), (3, 5, "user", "y" * 200_000), (4, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, conv int, turns string")
    got = chat.turn_spans(df, {"chatml": chat.chatml}).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.position, r.turn, r.role) for r in got] == [(1, 1, 0, "user"), (1, 2, 1, ""), (1, 3, 1, "assistant"), (1, 4, 1, "assistant"), (3, 1, 5, "user"), (4, 1, 0, "assistant")]
    assert got[4].end == 200_000 + 28 and all(r.status == "append" for r in got)
    assert chat.turn_spans(df.where("turn > 99")).count() == 0


# mixing


def newton(rows, targets):
    """The dual by plain Newton steps over documents. rows: (features by constraint, tokens)."""
    names = sorted(targets)
    x = np.array([[t if n in own else 0.0 for n in names] for own, t in rows])
    goal = np.array([targets[n] for n in names])
    scale = x.sum(1).mean()
    x, goal, m = x / scale, goal / scale, np.zeros(len(names))
    for _ in range(200):
        w = np.exp(x @ m)
        step = np.linalg.lstsq((x * w[:, None]).T @ x, goal - x.T @ w, rcond=None)[0]
        m += step * min(1, 1 / max(np.abs(x @ step).max(), 1e-9))
    return np.exp(x @ m)


def sized(seed, n):
    draw = random.Random(seed)
    return [(k, "w " * draw.randrange(1, 200), draw.choice(["en", "de"]), draw.choice(["a"] * 6 + ["b", "c"]), 1) for k in range(n)]


def test_rates_agree_with_plain_newton(spark):
    rows = sized(1, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    tokens = {r[0]: len(r[1].split()) for r in rows}
    total = sum(tokens.values())
    cases = [
        (None, {("source", s): total / 3 for s in "abc"}),
        ({"source": {"a": 0.2, "b": 0.5, "c": 0.3}}, {("source", s): total * v for s, v in (("a", 0.2), ("b", 0.5), ("c", 0.3))}),
        ({"source": {"a": 1, "b": 1, "c": 2}, "lang": {"en": 3, "de": 1}}, {**{("source", s): total * v / 4 for s, v in (("a", 1), ("b", 1), ("c", 2))}, ("lang", "en"): total * 0.75, ("lang", "de"): total * 0.25}),
    ]
    for targets, goals in cases:
        got = {r.doc_id: r for r in mixing.copies(df, targets).collect()}
        want = newton([({("source", r[3]), ("lang", r[2])}, tokens[r[0]]) for r in rows], goals)
        assert np.allclose([got[r[0]].rate for r in rows], want, rtol=1e-4)
        for (column, value), goal in goals.items():
            own = [r for r in rows if r[3 if column == "source" else 2] == value]
            assert abs(sum(got[r[0]].rate * tokens[r[0]] for r in own) - goal) < 1e-5 * total
        assert all(math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1 for r in got.values())


def test_copies_meet_the_targets_on_average(spark):
    rows = sized(2, 3000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.copies(df)
    share = {r.source: r.t for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    total = sum(len(r[1].split()) for r in rows)
    assert all(abs(t / total - 1 / 3) < 0.02 for t in share.values())
    assert mixing.repeat(df).count() == got.agg(F.sum("copies")).first()[0]


def test_too_many_constraints_are_refused(spark):
    df = spark.createDataFrame([(k, "one two", f"s{k}") for k in range(30)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="more than 20"):
        mixing.copies(df, p=mixing.Mixing(most=20)).count()
    got = mixing.copies(df, p=mixing.Mixing(most=30)).collect()
    assert len(got) == 30 and all(abs(r.rate - 1) < 1e-9 for r in got)


def test_mixing_odd_tables(spark, messy, plain, empty):
    key = lambda df: sorted(str((r.doc_id, r.source, r.n_tokens, round(r.rate, 6), r.copies)) for r in df.collect())
    assert key(mixing.copies(messy)) == key(mixing.copies(plain)) and mixing.copies(messy).count() == len(messy_rows())
    rows = {r.doc_id: r for r in mixing.copies(messy).where("doc_id in (4, 5, 6)").collect()}
    assert rows[5].rate == rows[6].rate == 1.0 and rows[4].source is None and rows[4].rate > 1
    out = mixing.repeat(messy)
    assert out.columns == [*messy.columns, "rate_", "copy_"] and mixing.repeat(plain).columns == [*plain.columns, "rate", "copy"]
    assert mixing.copies(empty).count() == 0 and mixing.repeat(empty).count() == 0
    some = {r.source: r.rate for r in mixing.copies(plain.where("doc_id in (1, 2, 13)"), {"source": {"a": 1.0, "zz": 3.0}}).collect()}
    assert some["b"] == some["c"] == 0.0 and some["a"] > 1
    none = mixing.copies(plain.where("doc_id in (5, 6)"))
    assert [r.rate for r in none.collect()] == [1.0, 1.0]
