import random

import pytest

#: Names that operators use inside.
CLASHES = ["id", "k1", "cid", "band", "tile", "jaccard", "root", "node", "score", "held", "g", "n", "row", "c0", "shard", "query", "similarity", "tok_text", "t", "ids", "rate", "copy", "__tokens", "links", "part", "__value0"]
LONG = "word " * 60_000 + "x" * 30_000


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    syllables = "ka lo mi ne su ta ri vo pe du an er in".split()
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randrange(1, 5))) for _ in range(n)).capitalize() + "."


def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, other scripts."""
    base = prose(1, 60)
    near = base.replace(base.split()[10], "other").replace(base.split()[30], "more")
    return [
        (1, base, "en", "a", 10),
        (2, base, "en", "b", 10),
        (3, near, "en", "a", None),
        (3, near, "en", "a", None),
        (4, prose(2, 50), "en", None, 1),
        (5, None, "en", "a", 1),
        (6, "", "en", "a", 1),
        (7, "   \n\t ", None, "a", 1),
        (None, prose(3, 40), "en", "a", 1),
        (None, base, "en", "a", 1),
        (8, LONG, "en", "b", 1),
        (9, "word", "en", "b", 1),
        (10, "word", "de", "b", 1),
        (11, "!!! ... ???", "en", "b", 1),
        (12, "日本語の文章です。漢字かな交じり文。", "ja", "c", 1),
        (13, prose(4, 50), "en", "c", 1),
        (13, prose(5, 50), "en", "c", 1),
        (14, "a\x00b ퟿ ￿ \U0010ffff " + prose(6, 20), "en", "c", 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(*r, *[None if k % 2 else "x"] * len(CLASHES)) for k, r in enumerate(messy_rows())]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def plain(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
