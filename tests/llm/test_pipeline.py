from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sparktok.llm import decontam, langid, mixing, registry, secrets
from sparktok.llm import text as T

from .test_near_duplicates import brute, groups
from .test_scans import brute_contamination, brute_spans

SF = "/root/testdata/sf0.001"


def test_stages_are_the_ones_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near duplicates", "benchmark decontamination", "secret scans", "source mixing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(registry.QUERIES) and len(registry.QUERIES) == 10


def test_run_agrees_with_brute_force(spark):
    """Each stage again, over rows in the driver's hand."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in documents.collect()]
    model = langid.train(documents)
    import pyarrow as pa

    keep = model.judge(pa.array([(r[1] or "").lower() for r in rows]))[3]
    rows = [r for r, ok in zip(rows, keep, strict=True) if ok]
    assert len(rows) >= 0.98 * documents.count()
    gone = set(groups(brute(rows)))
    rows = [r for r in rows if r[0] not in gone]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    held = {i for i, _ in brute_contamination([r[1] for r in rows if len(r[1]) < 20_000], items)}
    short = [r for r in rows if len(r[1]) < 20_000]
    dirty = {short[i][0] for i in held}
    index = decontam.Index(list(enumerate(items)), decontam.Decontam())
    dirty |= {rows[r][0] for r, *_ in index.scan(pa.array([x[1].lower() if len(x[1]) >= 20_000 else "" for x in rows]))}
    rows = [r for r in rows if r[0] not in dirty]
    clean = {}
    for r in rows:
        text = r[1]
        if any(w in text.lower() for w in ("token", "secret", "password", "key", "pwd", "akia", "ghp_")):
            at = 0
            lines = []
            for line in text.split("\n"):
                found = [(s, e, k) for k, s, e in brute_spans(line, secrets.RULES)] if len(line) < 3000 and "=" in line or "key" in line else []
                new, at = "", 0
                for s, e, k in sorted(found):
                    new += line[at:s] + f"[{secrets.RULES[k][0]}]"
                    at = e
                lines.append(new + line[at:])
            text = "\n".join(lines)
        clean[r[0]] = (text, r[2], r[3], len(text))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= set(clean)
    for r in got:
        assert (r.text, r.lang, r.source, r.n_chars) == clean[r.doc_id]
    rates = {r.doc_id: r.rate for r in mixing.copies(spark.createDataFrame([(k, *v) for k, v in clean.items()], documents.schema)).collect()}
    assert all(np.isclose(r.rate, rates[r.doc_id]) for r in got)
    times = Counter(r.doc_id for r in got)
    assert all(int(rates[k]) <= times[k] <= int(rates[k]) + 1 for k in clean)
    assert sorted(r.copy for r in got if r.doc_id == got[0].doc_id) == list(range(1, times[got[0].doc_id] + 1))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=lambda x: x if isinstance(x, str) else "")
def test_stages_on_odd_tables(spark, messy, empty, tmp_path, name, stage):
    out = stage(spark, messy, SF)
    # the table has columns of these names already
    more = ["rate_", "copy_"] if name == "source mixing" else []
    assert out.columns == messy.columns + more
    if more:
        assert {r[0] for r in out.select("rate").distinct().collect()} <= {"x", None} and out.where("rate_ is null or copy_ < 1").isEmpty()
        out.write.mode("overwrite").parquet(str(tmp_path / "out"))
    assert out.count() > 0
    assert stage(spark, empty, SF).count() == 0


def test_words_survive_the_pipeline(spark):
    """Clean documents are not changed by any stage but the last, and none is lost but to its group."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    redacted = corpus_pipeline.secret_scan(spark, kept, SF)
    assert redacted.count() == kept.count()
    same = redacted.join(docs.withColumnRenamed("text", "before").select("doc_id", "before"), "doc_id").where("text <> before")
    assert same.count() == secrets.secrets(kept).select("doc_id").distinct().count()
    assert T.word_list("A b") == ["a", "b"]
