"""Other inputs and outputs: whole files, documents cut from a long text, id lists, Unicode data files, checksums."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError

DOCUMENT = 8192


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, content (bytes), sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def verify_sums(spark: SparkSession, path: str, sums: dict[str, str]) -> None:
    """Refuses files whose checksum isn't the one given for their name, and missing ones."""
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in read_whole(spark, path).select("path", "sha256").collect()}
    wrong = sorted(n for n, s in sums.items() if found.get(n) != s)
    if wrong:
        raise InputError("missing or changed: " + ", ".join(wrong))


def cut_documents(data: bytes, least: int = DOCUMENT) -> list[bytes]:
    """A long text in documents: each ends behind the first line break that is ``least`` bytes or more from its start; the last with the text."""
    out, start = [], 0
    while start < len(data):
        at = data.find(b"\n", start + least)
        end = len(data) if at < 0 else at + 1
        out.append(data[start:end])
        start = end
    return out


def split_documents(df: DataFrame, key: str, data_col: str = "content", least: int = DOCUMENT) -> DataFrame:
    """key, doc, content: the documents that each row's text (a string or binary) is cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, d) for k, data in zip(b.column("k").to_pylist(), b.column("data").to_pylist(), strict=True) for i, d in enumerate(cut_documents(data or b"", least))]
            if rows:
                k, i, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, b.schema.field("k").type), pa.array(i, pa.int32()), pa.array(d, pa.binary())], ["k", "doc", "content"])

    kind = dict(df.dtypes)[key]
    own = df.select(F.col(key).alias("k"), F.col(data_col).cast("binary").alias("data"))
    return own.mapInArrow(run, f"k {kind}, doc int, content binary").withColumnRenamed("k", key)


def write_ids(df: DataFrame, path: str, ids_col: str = "ids") -> None:
    """One id a line, as text files."""
    df.select(F.explode(ids_col).cast("string").alias("value")).write.mode("overwrite").text(path)


def unicode_data(spark: SparkSession, path: str) -> DataFrame:
    """cp, name, category, ccc, decomposition of a UnicodeData file, ranges by their first and last rows."""
    names = ["cp", "name", "category", "ccc", "bidi", "decomposition"]
    raw = spark.read.text(path).select(F.split("value", ";").alias("x"))
    picked = raw.select(*(F.col("x")[i].alias(n) for i, n in enumerate(names)))
    return picked.select(F.conv("cp", 16, 10).cast("int").alias("cp"), "name", "category", F.col("ccc").cast("int").alias("ccc"), "decomposition")


def property_ranges(spark: SparkSession, path: str) -> DataFrame:
    """first, last, fields of a Unicode property file: comments and empty lines left out."""
    raw = spark.read.text(path).select(F.split(F.regexp_replace("value", "\\s*#.*", ""), "\\s*;\\s*").alias("x")).where("x[0] <> ''")
    ends = F.split(F.col("x")[0], "\\.\\.")
    number = lambda c: F.conv(F.trim(c), 16, 10).cast("int")
    return raw.select(number(ends[0]).alias("first"), number(F.element_at(ends, -1)).alias("last"), F.slice("x", 2, F.size("x")).alias("fields"))


def random_cjk(words: int = 20_000, seed: int = 7) -> str:
    """A text that no cache helps with: words of 2 to 12 random Han characters."""
    draw = random.Random(seed)
    return "".join("".join(chr(draw.randint(0x4E00, 0x9FA4)) for _ in range(draw.randint(2, 12))) + draw.choice(["，", "。", "\n", " "]) for _ in range(words))
