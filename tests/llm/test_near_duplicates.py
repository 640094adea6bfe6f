import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktok.llm import ngram_join as J
from sparktok.llm import text as T

from .conftest import SCHEMA, messy_rows, prose


def shingles(text, n=3):
    w = T.word_list(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, p=J.JaccardJoin()):
    best = defaultdict(float)
    sets = [(r[0], shingles(r[1], p.n)) for r in rows if r[0] is not None]
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y:
            s = len(x & y) / len(x | y)
            if s >= p.threshold:
                key = (min(a, b), max(a, b))
                best[key] = max(best[key], s)
    return dict(best)


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root if find(x) != x}


def linked(rows, p=J.JaccardJoin()):
    """(class, links) of each id: each different text of an id has links of its own, also to the id's other texts."""
    texts = sorted({(r[0], tuple(T.word_list(r[1]))) for r in rows if r[0] is not None})
    links = Counter()
    sets = [shingles(" ".join(w), p.n) if w else set() for _, w in texts]
    pairs = set()
    for (i, x), (j, y) in combinations(enumerate(sets), 2):
        if x and y and (texts[i][1] == texts[j][1] or len(x & y) / len(x | y) >= p.threshold):
            a, b = texts[i][0], texts[j][0]
            links[a] += 1
            links[b] += 1
            pairs.add((a, b))
    pairs |= {(a, b) for (a, x), (b, y) in combinations(texts, 2) if a == b and x and y}
    root = groups(pairs)
    return {i: (root.get(i, i), links[i]) for i, _ in texts}


def joined(df, p=J.JaccardJoin()):
    rows = J.jaccard_join(df, p).collect()
    out = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert len(out) == len(rows)
    return out


def varied(n, seed=5):
    """Groups of copies, near and exact, among texts of their own."""
    draw, out = random.Random(seed), []
    for g in range(n):
        words = prose(1000 + g, draw.randrange(3, 120)).split()
        for k in range(draw.choice([1, 1, 2, 5, 25])):
            own = [w if draw.random() > 0.03 * (k % 4) else "zu" for w in words]
            out.append((len(out), " ".join(own), "en", "s", 1))
    draw.shuffle(out)
    return out


def test_messy_tables(spark, messy, plain):
    want = linked(messy_rows())
    gone = {i: c for i, (c, _) in want.items() if c != i}
    assert gone and want[13] == (13, 0)
    for df in (messy, plain):
        assert joined(df) == want
    assert {r.node: r.root for r in J.near_duplicates(messy).collect()} == gone
    kept = J.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in messy_rows() if r[0] not in gone)


def test_ids_with_several_texts_connect_what_these_are_similar_to(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, b + " more"), (5, b + " more"), (5, a), (6, prose(3, 60))]
    rows = [(*r, "en", "s", 1) for r in rows]
    want = linked(rows)
    assert {c for c, _ in want.values()} == {1, 6}
    assert joined(spark.createDataFrame(rows, SCHEMA)) == want


def test_empty(spark, empty):
    assert J.jaccard_join(empty).count() == 0 and J.near_duplicates(empty).count() == 0 and J.drop_near_duplicates(empty).count() == 0


def test_recall_and_exactness(spark):
    rows = varied(150)
    df = spark.createDataFrame(rows, SCHEMA)
    want, got = linked(rows), joined(df)
    assert all(got[i][1] <= n for i, (_, n) in want.items())
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values()) and len(brute(rows)) > 1000
    assert sum(got[i][0] == c for i, (c, _) in want.items()) >= 0.99 * len(want)
    nodes = {r.node: r.root for r in J.near_duplicates(df).collect()}
    assert nodes == {i: c for i, (c, _) in got.items() if c != i}


def test_small_tiles_change_nothing(spark):
    rows = varied(60)
    df = spark.createDataFrame(rows, SCHEMA)
    assert joined(df, J.JaccardJoin(tile=200)) == joined(df)
    assert {tuple(r) for r in J.near_duplicates(df, J.JaccardJoin(tile=200)).collect()} == {tuple(r) for r in J.near_duplicates(df).collect()}


def test_a_large_bucket_is_not_listed(spark):
    """Thousands of near copies of one text, each different, and as many exact copies: every link counts, and no row holds a list of them."""
    base = prose(1, 40)
    rows = [(k, f"{base} tail{k}", "en", "s", 1) for k in range(3000)] + [(10_000 + k, base, "en", "s", 1) for k in range(3000)] + [(20_000 + k, prose(100 + k, 40), "en", "s", 1) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    plans = []
    save = J.Scratch.save
    with pytest.MonkeyPatch.context() as m:
        m.setattr(J.Scratch, "save", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, name))
        got = joined(df, J.JaccardJoin(tile=20_000))
    assert all(got[k] == (0, 5999) for k in [*range(0, 3000, 97), *range(10_000, 13_000, 97)]) and sum(n for _, n in got.values()) == 6000 * 5999
    assert all(got[20_000 + k] == (20_000 + k, 0) for k in range(100))
    assert len(plans) > 5 and not any("collect_" in x for x in plans)


def test_on_documents(spark, docs):
    want, got = linked([(r.doc_id, r.text) for r in docs.collect()]), joined(docs)
    assert got.keys() == want.keys() and sum(got[i] == x for i, x in want.items()) >= 0.98 * len(want)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in J.components(edges, J.Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert J.components(edges.where("a < 0"), J.Scratch(spark, "t")).count() == 0


def test_gates_follow_the_posterior():
    p = J.JaccardJoin()
    draw = np.random.default_rng(1)
    for n, least in J.least_equal(p):
        for m in (least - 1, least):
            if m >= 0:
                share = (draw.beta(m + 1, n - m + 1, 400_000) >= p.threshold).mean()
                assert share < p.tolerance * 1.3 if m < least else share > p.tolerance * 0.7
    assert 1 - (1 - p.threshold**p.rows) ** p.bands >= p.recall


def test_minhash_estimates_the_similarity():
    x, y = np.arange(1000, dtype=np.uint64), np.arange(500, 1500, dtype=np.uint64)
    sh = T.mix(np.concatenate([x, y]))
    sig = J.minhash(sh, np.array([0, 1000, 1000, 2000]), 2000)
    assert abs((sig[0] == sig[2]).mean() - 1 / 3) < 0.04


def test_only_what_is_needed_is_read(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame(messy_rows(), SCHEMA).write.parquet(path)
    plan = J.texts(spark.read.parquet(path), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["jaccard", "s", "a", "b"])
def test_clashing_names(spark, plain, name):
    df = plain.withColumn(name, F.lit(1))
    assert joined(df) == joined(plain)
