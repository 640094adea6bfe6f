"""A corpus pipeline: language ID, near duplicates, decontamination, secrets, source mixing.

Each stage is (name, function of (spark, docs, sf_dir)); run() writes each one's result as Parquet in the shared folder
and reads it back as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparktok.llm.common import Scratch
from sparktok.llm.decontam import drop_contaminated
from sparktok.llm.langid import keep_known_languages
from sparktok.llm.mixing import repeat
from sparktok.llm.ngram_join import drop_near_duplicates
from sparktok.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without words, and those that no language explains, go."""
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similar pairs connect, the document with the smallest id."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in them replaced by its rule's name, and n_chars set anew."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of tokens asks for, with its rate and the copy's number."""
    return repeat(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("source mixing", mixing),
]

#: SQL can't express the stages' trained model and iterations; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = at.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            at.drop(f"stage{k - 1}")
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
