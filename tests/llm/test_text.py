import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparktok.llm import text as T

ALPHABET = "ab1_ ,.'éß ’　中文字ひ漢한글\U0001f600-\n"


def words_of(texts):
    data, off = T.buffers(pa.array(texts, pa.string()))
    w = T.words(data, off)
    return [[bytes(data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.off[:-1], w.off[1:], strict=True)], w


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30) | st.none(), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got, w = words_of(texts)
    assert got == [T.word_list(t) for t in texts]
    by = {}
    for own, a, b in zip(got, w.off[:-1], w.off[1:], strict=True):
        for x, h in zip(own, w.hash[a:b].tolist(), strict=True):
            assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_long_texts_are_cut_between_words():
    texts = ["x" * 10 + " word " * 200_000, "ab " * 100_000, "q" * 600_000 + " z", ""]
    _, w = words_of(texts)
    assert np.diff(w.off).tolist() == [200_001, 100_000, 2, 0]
    assert len(np.unique(w.hash[1:200_001])) == 1


def test_shingles():
    texts = ["a b c d", "a b c", "b c", "c", "", "x a b c"]
    _, sh, off = T.hash_texts(texts, 3)
    own = [sh[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert [len(x) for x in own] == [2, 1, 1, 1, 0, 2]
    assert own[0][0] == own[1][0] == own[5][1] and len({*own[0], *own[2], *own[3], *own[5]}) == 5


def test_blocks_cover_all_rows():
    off = np.array([0, 10, 10, 500, 510, 520])
    assert list(T.rows(off, 100)) == [(0, 2), (2, 3), (3, 5)]
    assert list(T.rows(np.array([0]), 100)) == []


def test_mix_is_a_bijection_on_a_sample():
    x = np.array([random.Random(1).getrandbits(64) for _ in range(10_000)], np.uint64)
    assert len(np.unique(T.mix(x))) == len(np.unique(x))


def test_scratch_tables_can_be_cleaned(spark):
    from pathlib import Path

    from sparktok.llm.common import Scratch, clean

    at = Scratch(spark, "t")
    assert at.save(spark.range(5), "x").count() == 5
    at.save(spark.range(2), "y")
    folder = Path(at.at.removeprefix("file://"))
    at.drop("x")
    assert not (folder / "x").exists() and (folder / "y").exists()
    clean(spark)
    assert not folder.exists()
