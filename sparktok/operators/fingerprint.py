"""What a tokenizer pipeline does, found by feeding it probes, as rows (section, key, value); and the difference of two."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FormatError
from ..functions.columns import encode, format_ids, normalize, pretokenize
from .vocab import Vocab

#: Pieces of a{X}a and of !{X}! by what X is.
CLASSES = {(1, 2): "letter", (3, 3): "number", (2, 2): "blank", (2, 3): "whitespace", (3, 2): "newline", (2, 1): "other"}
#: Combining marks by the Unicode version that brought them: reordered before U+0334 only by a table that knows them.
LADDER = [(0x8D4, "9.0"), (0x1DFB, "9.0"), (0x1E000, "9.0"), (0xD3B, "10.0"), (0x1DF6, "10.0"), (0x8D3, "11.0"), (0x9FE, "11.0"), (0x10D24, "11.0"), (0xEBA, "12.0"), (0x1E130, "12.0"), (0x1ABF, "13.0"), (0x10EAB, "13.0"), (0x898, "14.0"), (0x10F82, "14.0"), (0x10EFD, "15.0"), (0x1E4EC, "15.0")]
NORMS = ["é", "한", "q̣̇", "Å", "豈", "ﬁ", "①", "\U0001d15e", "क़", "̀"]
GOLDEN = ["Hello, world!", "it's 'ſx IT'S", " 5 apples  and\n\nmore ", "日本語と한국어", "x\t\ty \r\n z", "π≈3.14159", "👩‍🚀 emoji"]


def character(cp: str = "id") -> Column:
    """The character of a codepoint column."""
    # with a byte order mark before it, or U+FEFF itself would be taken for one
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(cp), 8, "0"))), "UTF-32")


def class_sweep(spark: SparkSession, partitions: int | None = None) -> DataFrame:
    """cp, class: of every codepoint but surrogates, by the pattern's own pieces."""
    cps = spark.range(0, 0x110000, 1, partitions or spark.sparkContext.defaultParallelism).where("id not between 55296 and 57343")
    c = character()
    pieces = cps.select(F.col("id").cast("int").alias("cp"), F.size(pretokenize(F.concat(F.lit("a"), c, F.lit("a")))).alias("a"), F.size(pretokenize(F.concat(F.lit("!"), c, F.lit("!")))).alias("b"))
    kind = F.lit("?")
    for (a, b), name in CLASSES.items():
        kind = F.when((F.col("a") == a) & (F.col("b") == b), name).otherwise(kind)
    return pieces.select("cp", kind.alias("class"))


def class_ranges(sweep: DataFrame) -> DataFrame:
    """class, first, last: runs of neighbours of one class but "other"."""
    own = sweep.where("class <> 'other'")
    # within 4096 codepoints a run is found apart from all others; a run over an edge is two rows
    w = Window.partitionBy("class", F.shiftright("cp", 12)).orderBy("cp")
    run = own.withColumn("__run", F.col("cp") - F.row_number().over(w))
    return run.groupBy("class", F.shiftright("cp", 12).alias("block"), "__run").agg(F.min("cp").alias("first"), F.max("cp").alias("last")).select("class", "first", "last")


def nfc_sweep(spark: SparkSession) -> DataFrame:
    """cp, form, hex: what NFC makes of each character alone, after a letter, and before and after a mark; only where it changes the text."""
    c = character()
    forms = F.array(*(F.struct(F.lit(n).alias("form"), t.alias("t")) for n, t in (("alone", c), ("after", F.concat(F.lit("a"), c)), ("before", F.concat(c, F.lit("́"))), ("mark", F.concat(F.lit("ạ̴"), c)))))
    rows = spark.range(0, 0x110000).where("id not between 55296 and 57343").select(F.col("id").cast("int").alias("cp"), F.explode(forms).alias("x")).select("cp", "x.form", "x.t")
    return rows.withColumn("n", normalize("t")).where("n <> t").select("cp", "form", F.hex(F.encode("n", "utf-8")).alias("hex"))


def take(spark: SparkSession, vocab: Vocab | None = None, quick: bool = False) -> DataFrame:
    """The fingerprint: section, key, value. quick: without the sweep over all codepoints."""
    rows = [("pipeline", "version", "1")]
    if vocab:
        rows += [("pipeline", k, str(v)) for k, v in vocab.info().items() if k != "version"]
    out = spark.createDataFrame(rows, "section string, key string, value string")
    probe = lambda section, items: spark.createDataFrame([(section, k, t) for k, t in items], "section string, key string, t string")
    ladder = probe("nfc", [(f"{v}:{cp:04X}", chr(cp) + "̴") for cp, v in LADDER]).select("section", "key", (normalize("t") != F.col("t")).cast("string").alias("value"))
    fold = probe("fold", [(f"{c:04X}", f"'{chr(c)}x") for c in (0x53, 0x73, 0x17F, 0x1E9E, 0xDF, 0xFF33, 0x54, 0x4D, 0x44)]).select("section", "key", F.to_json(pretokenize("t")).alias("value"))
    norms = probe("norms", [("+".join(f"{ord(c):04X}" for c in t), t) for t in (*NORMS, *(unicodedata.normalize("NFD", x) for x in NORMS[:4]))]).dropDuplicates(["key"]).select("section", "key", F.hex(F.encode(normalize("t"), "utf-8")).alias("value"))
    out = out.unionByName(ladder).unionByName(fold).unionByName(norms)
    if vocab:
        out = out.unionByName(probe("golden", [(t, t) for t in GOLDEN]).select("section", F.hex(F.encode("key", "utf-8")).alias("key"), F.replace(format_ids(encode("t", vocab, spark=spark)), F.lit("\n"), F.lit(" ")).alias("value")))
    if not quick:
        ranges = class_ranges(class_sweep(spark))
        out = out.unionByName(ranges.select(F.lit("classes").alias("section"), F.format_string("%06X-%06X", "first", "last").alias("key"), F.col("class").alias("value")))
    return out


def nfc_version(fingerprint: DataFrame) -> tuple[str, bool]:
    """The newest version of which a mark is known, and whether all older ones are as well."""
    rows = {r.key: r.value == "true" for r in fingerprint.where("section = 'nfc'").collect()}
    known = [float(k.split(":")[0]) for k, v in rows.items() if v]
    top = max(known, default=0.0)
    return f"{top:.1f}", all(v == (float(k.split(":")[0]) <= top) for k, v in rows.items())


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """section, key, left, right of all that differs; null is absent."""
    x, y = a.withColumnRenamed("value", "left"), b.withColumnRenamed("value", "right")
    return x.join(y, ["section", "key"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))).select("section", "key", "left", "right")


def same(a: DataFrame, b: DataFrame) -> bool:
    return diff(a, b).isEmpty()


def require_agreement(a: DataFrame, b: DataFrame, limit: int = 200) -> None:
    """Two probes' rows must be the same; else an error that names the first differences, of ``limit`` looked at."""
    found = diff(a, b).limit(limit).collect()
    if found:
        raise FormatError(f"{len(found)} or more differences: " + ", ".join(f"{r.section} {r.key}: {r.left} and {r.right}" for r in found[:5]))
