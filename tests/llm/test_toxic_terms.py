"""Learned terms against a plain version over dictionaries, and their recall on held-out documents."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparktok.llm import registry
from sparktok.llm import toxic_terms as L
from sparktok.llm import toxicity as X

from .conftest import SCHEMA, messy_rows, prose


def terms(text, p=L.Learning()):
    out = Counter()
    for w in re.findall(r"[^\W_]+", text.lower()):
        w = "".join(X._DIGITS.get(c, c) for c in w).replace("l", "i")
        if re.fullmatch("[a-z]+", w):
            if p.shortest <= len(w) <= p.longest:
                out[w + "$"] += 1
            for k in range(p.shortest, min(len(w), p.longest) + 1):
                out[w[:k]] += 1
    return out


def g2(a, b, p, n):
    if a * n <= b * p:
        return 0.0
    out = 0.0
    for x, e in ((a, (a + b) * p / (p + n)), (b, (a + b) * n / (p + n)), (p - a, (p + n - a - b) * p / (p + n)), (n - b, (p + n - a - b) * n / (p + n))):
        out += x * math.log(x / e) if x else 0
    return round(2 * out, 6)


def brute(rows, threshold, p=L.Learning()):
    """rows: (text, toxic), texts apart."""
    have = [terms(t, p) for t, _ in rows]
    words = [len(re.findall(r"[^\W_]+", t)) for t, _ in rows]
    bad = {i for i, (_, x) in enumerate(rows) if x}
    good = set(range(len(rows))) - bad
    of = defaultdict(set)
    for i, c in enumerate(have):
        for t in c:
            of[t].add(i)
    pool = [t for t in of if len(of[t] & bad) >= p.least and g2(len(of[t] & bad), len(of[t] & good), len(bad), len(good)) >= p.gain]
    live, out = set(bad), {}
    while pool:
        scored = [(-g2(len(of[t] & live), len(of[t] & good), len(live), len(good)), -len(t), t) for t in pool if len(of[t] & live) >= p.least]
        best = min(scored, default=(0, 0, ""))
        if -best[0] < p.gain:
            break
        t = best[2]
        live -= of[t]
        high, low = (1000 * sum(have[i][t] for i in of[t] & s) / max(sum(words[i] for i in of[t] & s), 1) for s in (bad, good))
        low = low or 500 / sum(words[i] for i in good)
        if high > low:
            out[t] = round(min(threshold * math.log(high / low) / (high - low), p.most), 3)
    return out


def labelled(n, seed=3):
    """Documents of which a quarter is toxic, by words of a kind that clean ones hardly have."""
    draw, out = random.Random(seed), []
    for k in range(n):
        words = prose(k, draw.randrange(20, 150)).split()
        toxic = k % 4 == 0
        for _ in range(draw.randrange(2, 6) if toxic else draw.random() < 0.01):
            words[draw.randrange(len(words))] = "zwickel" + draw.choice(["", "en", "ung"]) if k % 8 == 0 else draw.choice(["grolbo", "Gr0lbo"])
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_learned_terms_agree_with_brute_force(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int")
    got, want = L.learn(docs, labels, 2.5), brute([(t, x) for _, t, x in rows], 2.5)
    assert got == want and "groibo$" in got and "zwickei" in got


def test_the_query_agrees_with_brute_force(spark, tmp_path):
    rows = labelled(240, 8) + [(900, "You idiot " + prose(900, 30), 0), (901, "", 1), (902, None, 1), (903, "a trash can", 0)]
    spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    learned = brute([(t, x) for _, t, x in rows if t is not None], 2.5)
    want = {}
    for k, t, _ in rows:
        weight = n = 0
        words = re.findall(r"[^\W_]+", (t or "").lower())
        for i, w in enumerate(words):
            code = "".join(X._DIGITS.get(c, c) for c in w).replace("l", "i")
            own = [x for y, x in learned.items() if (code + "$" == y if y[-1] == "$" else code.startswith(y))]
            if w in X.LEXICON and words[i : i + 2] != ["trash", "can"]:
                own.append(X.LEXICON[w])
            weight, n = weight + max(own, default=0), n + bool(own)
        score = 1000 * weight / max(len(words), 20)
        if score > 2.5:
            want[k] = (n, round(weight, 6), round(score, 6))
    got = {r.doc_id: (r.n_terms, r.weight, r.score) for r in registry.op2_toxicity(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 50


def test_held_out_recall_by_language(spark):
    """Learned on one half, scored on the other, without documents that share a third of their passages with the first."""
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{n}.parquet") for n in ("documents", "labels"))
    half = F.col("doc_id") % 2 == 0
    learned = L.learn(docs, labels.where(half), X.Toxicity().threshold)
    rows = X.toxicity(docs, learned=learned).join(labels, "doc_id").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()

    def passages(t):
        w = t.lower().split()
        return {hash(tuple(w[i : i + 6])) for i in range(len(w) - 5)}

    seen = set().union(*(passages(r.text) for r in rows if r.doc_id % 2 == 0))
    held = [r for r in rows if r.doc_id % 2 and len(passages(r.text) & seen) <= 0.3 * len(passages(r.text))]
    assert len(held) > 1000
    for lang, least in (("en", 0.85), ("de", 0.8), ("fr", 0.8), ("es", 0.7)):
        toxic = [r.score > X.Toxicity().threshold for r in held if r.lang == lang and r.toxic]
        clean = [r.score > X.Toxicity().threshold for r in held if r.lang == lang and not r.toxic]
        assert len(toxic) >= 5 and sum(toxic) >= least * len(toxic), (lang, sum(toxic), len(toxic))
        assert sum(clean) <= 0.04 * len(clean), (lang, sum(clean), len(clean))


def test_the_sample_is_bounded_and_odd_labels_are_left_out(spark):
    rows = labelled(200)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    odd = [(None, 1)] * 3000 + [(k, None) for k in range(50)] + [(k, x) for k, _, x in rows] * 3
    labels = spark.createDataFrame(odd, "doc_id long, toxic int").withColumn("text", F.lit("x"))
    assert L.learn(docs, labels, 2.5) == brute([(t, x) for _, t, x in rows], 2.5)
    drawn = []
    save = L.Scratch.save

    def spy(self, df, name):
        out = save(self, df, name)
        drawn.append((name, out.count()))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(L.Scratch, "save", spy)
        L.learn(docs, labels, 2.5, L.Learning(sample=10))
    assert dict(drawn)["labels"] == 10 and dict(drawn)["sample"] <= 10


def test_odd_tables(spark, messy, plain, empty):
    labels = spark.createDataFrame([(r[0], int(r[0] is not None and r[0] % 2)) for r in messy_rows()], "doc_id long, toxic int")
    assert L.learn(messy, labels, 2.5) == L.learn(plain, labels, 2.5) == {}
    assert L.learn(empty, labels, 2.5) == {} and L.learn(plain, labels.where("toxic > 5"), 2.5) == {}
    assert L.learn(plain, labels.where("toxic = 1"), 2.5) == {}
    copies = spark.createDataFrame([(k, prose(1, 40), "en", "a", 1) for k in range(50)] + [(100 + k, prose(k + 2, 40), "en", "a", 1) for k in range(50)], SCHEMA)
    assert L.learn(copies, spark.createDataFrame([(k, int(k < 50)) for k in range(150)], "doc_id long, toxic int"), 2.5) == {}


def test_stems_exceptions_and_the_heaviest_term():
    import pyarrow as pa

    m = X.Matcher({"idiot": 1.0, "trash": 1.0}, ["trash can"], {"idio": 3.0, "trash$": 5.0, "vequ": 2.0})
    weight, count, _ = m.weigh(pa.array(["idiot idiocy vequal vequ xvequ trash trash can", "1d10t"]))
    assert weight.tolist() == [3 + 3 + 2 + 2 + 5, 3] and count.tolist() == [5, 1]
