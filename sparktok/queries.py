"""The registered queries over the engine's own operators, and the SQL that gives the same rows.

The SQL side has the split pattern in RE2's terms, and merges as nested replacements, so vocabularies are small there:
the bytes and the first merges of a public vocabulary, or the toy one.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FormatError, InputError
from .functions import columns as C
from .functions.bytes_path import encode_bytes_column
from .functions.unicode_pins import BARRIERS
from .operators import census as cen
from .operators import fingerprint as fp
from .operators.vocab import Vocab, from_tokenizer_json, public_json, toy_json
from .plans.encoding import decode_join, encode, token_frequencies
from .sources import bpv
from .sources.text import split_documents

Query = Callable[[SparkSession, str], DataFrame]
MERGES = 64
BUDGET = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def small() -> Vocab:
    return from_tokenizer_json(public_json(merges=MERGES), "public-small")


@cache
def full() -> Vocab:
    return from_tokenizer_json(public_json(), "public")


@cache
def bare() -> Vocab:
    return from_tokenizer_json(public_json(merges=0), "bytes")


@cache
def toy() -> Vocab:
    return from_tokenizer_json(toy_json(), "toy")


# SQL building blocks

_W = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WN = r"\x{09}\x{0B}\x{0C}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PATTERN = rf"(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{{L}}\p{{N}}\x{{F8FF}}]?\p{{L}}+|\p{{N}}| ?[^{_W}\p{{L}}\p{{N}}\x{{F8FF}}]+[\r\n]*|[{_W}]*[\r\n]+|[{_W}]+"


def sql_split(s: str) -> str:
    """A list of pretokens. RE2 can't look ahead: a mark goes in before the last white space that the next word takes."""
    return rf"regexp_extract_all(regexp_replace({s}, '([{_WN}])([{_WN}])([^{_W}])', '\1' || chr(63743) || '\2\3', 'g'), '{_PATTERN}')"


def _names(vocab: Vocab) -> dict[int, str]:
    name = {i: f"<{b:02X}>" for b, i in enumerate(vocab.byte_ids)}
    for rank, (_, _, m) in enumerate(vocab.merges):
        name[m] = f"<m{rank}>"
    return name


def sql_symbols(p: str, vocab: Vocab) -> str:
    """A pretoken's tokens as symbols in brackets."""
    out, name = rf"regexp_replace(hex(encode({p})), '(..)', '<\1>', 'g')", _names(vocab)
    for a, b, m in vocab.merges:
        out = f"replace({out}, '{name[a]}{name[b]}', '{name[m]}')"
    return out


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS {names}"


def _tokens_sql(vocab: Vocab) -> str:
    """v(sym, id, hex): the vocabulary of the symbols."""
    return _values([(s, i, vocab.tokens[i].hex()) for i, s in _names(vocab).items()], "v(sym, id, hex)")


def _bpe_sql(vocab: Vocab) -> str:
    """done(p, s): the symbols of each pretoken in w(p), by merging, in rounds, all pairs of the lowest rank that each one has. It must stand in WITH RECURSIVE."""
    name = _names(vocab)
    ranks = _values([(name[a] + name[b], rank) for rank, (a, b, _) in enumerate(vocab.merges)], "v(pair, r)")
    return rf"""merges AS MATERIALIZED (SELECT * FROM {ranks}),
bpe AS (
  SELECT p, regexp_replace(hex(encode(p)), '(..)', '<\1>', 'g') AS s, 0 AS k FROM w
  UNION ALL
  SELECT p, replace(s, best.pair, '<m' || best.r || '>'), k + 1 FROM (
    SELECT p, s, k, min(struct_pack(r := m.r, pair := m.pair)) AS best FROM (
      SELECT p, s, k, unnest(list_transform(range(1, len(x)), lambda i: x[i] || x[i + 1])) AS pair FROM (SELECT p, s, k, regexp_extract_all(s, '<[^>]*>') AS x FROM bpe)) q
    JOIN merges m ON m.pair = q.pair GROUP BY p, s, k)),
done AS (SELECT p, arg_max(s, k) AS s FROM bpe GROUP BY p)"""


def _counts_sql(source: str, key: str) -> str:
    """p(key, pretoken), and n(key, n_tokens)."""
    return f"""p AS (SELECT {key} AS k, unnest({sql_split("text")}) AS p FROM {source}),
n AS (SELECT k, sum(len({sql_symbols("p", small())}) - len(replace({sql_symbols("p", small())}, '<', '')))::BIGINT AS n_tokens FROM p GROUP BY k)"""


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql() if callable(sql) else sql
        return f

    return add


# splitting


@query(f"""WITH p AS (SELECT lang, unnest({sql_split("text")}) AS p FROM documents)
SELECT lang, count(*) AS pretokens, count(DISTINCT p) AS distinct_pretokens FROM p GROUP BY lang""")
def split_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("lang", F.explode(C.pretokenize("text")).alias("p"))
    # two levels: the shuffle is on pretokens, which no language's size skews
    return p.groupBy("lang", "p").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("pretokens"), F.count("*").alias("distinct_pretokens"))


@query(f"""WITH p AS (SELECT unnest({sql_split("text")}) AS p FROM documents)
SELECT p AS pretoken, count(*) AS n FROM p GROUP BY p ORDER BY n DESC, pretoken LIMIT 50""")
def split_distinct_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select(F.explode(C.pretokenize("text")).alias("pretoken"))
    return p.groupBy("pretoken").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pretoken").limit(50)


def _class_sql() -> str:
    full_ = lambda p: f"regexp_full_match(p, '{p}')"
    return f"""WITH d AS (SELECT text || ' it''s 5 x!! ' || chr(10) || chr(9) AS text FROM documents), p AS (SELECT unnest({sql_split("text")}) AS p FROM d)
SELECT CASE WHEN {full_("(?i:''s|''t|''re|''ve|''m|''ll|''d)")} THEN 'A1' WHEN {full_(f"[{_W}]*[" + chr(92) + "r" + chr(92) + "n]+")} THEN 'A5' WHEN {full_(f"[{_W}]+")} THEN 'A6-7'
WHEN {full_(chr(92) + "p{N}")} THEN 'A3' WHEN {full_(r"[^\r\n\p{L}\p{N}]?\p{L}+")} THEN 'A2' ELSE 'A4' END AS class, count(*) AS n FROM p GROUP BY 1"""


@query(_class_sql)
def split_class_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" it's 5 x!! \n\t"))
    p = table(spark, sf_dir, "documents").select(F.explode(C.pretokenize(text)).alias("p"))
    return p.groupBy(C.split_class("p").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS texts, 0::BIGINT AS broken FROM documents")
def split_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.array_join(C.pretokenize("text"), "") == F.col("text")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("texts"), F.sum((~whole).cast("long")).alias("broken"))


@query("SELECT doc_id, md5(nfc_normalize(replace(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)), 'ñ', 'n' || chr(771)))) AS digest FROM documents")
def nfc_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    for a, b in (("é", "e\u0301"), ("ü", "u\u0308"), ("ñ", "n\u0303")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(C.normalize(t), "utf-8")).alias("digest"))


# encoding


@query("SELECT doc_id, strlen(text)::BIGINT AS n_tokens FROM documents")
def byte_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without merges, a token is a byte."""
    return table(spark, sf_dir, "documents").select("doc_id", C.token_count("text", bare(), spark=spark).alias("n_tokens"))


#: From p(doc_id, i, s), the symbols of each document's pretokens.
_DIGESTS = """t AS (SELECT doc_id, i, unnest(range(1, len(y) + 1)) AS j, y FROM (SELECT doc_id, i, regexp_extract_all(s, '<[^>]*>') AS y FROM p)),
d AS (SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY i, j) AS ids, count(*) AS n_tokens FROM t JOIN {tokens} ON v.sym = y[j] GROUP BY doc_id)
SELECT documents.doc_id, md5(coalesce(ids, '')) AS digest, coalesce(n_tokens, 0)::BIGINT AS n_tokens FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id"""


def _ids_sql() -> str:
    return f"""WITH p AS (SELECT doc_id, i, {sql_symbols("x[i]", small())} AS s FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, {sql_split("text")} AS x FROM documents))),
{_DIGESTS.format(tokens=_tokens_sql(small()))}"""


def _digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.md5(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "utf-8")).alias("digest"), "n_tokens")


@query(_ids_sql)
def encode_ids_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(encode(table(spark, sf_dir, "documents"), small()))


@query(_ids_sql)
def encode_ids_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by merging each distinct pretoken once and joining it back."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), small(), strategy="dedup", key="doc_id")
    return _digests(coded)


@query(lambda: f"""WITH RECURSIVE x AS (SELECT doc_id, {sql_split("text")} AS x FROM documents), q AS (SELECT doc_id, i, x[i] AS p FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM x)),
w AS (SELECT DISTINCT p FROM q), {_bpe_sql(full())},
p AS (SELECT doc_id, i, s FROM q JOIN done ON done.p = q.p), {_DIGESTS.format(tokens=_tokens_sql(full()))}""")
def encode_ids_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by the whole public vocabulary."""
    return _digests(encode(table(spark, sf_dir, "documents"), full()))


@query(lambda: f"""WITH {_counts_sql("documents", "doc_id")}
SELECT source, count(*) AS docs, sum(n_tokens)::BIGINT AS n_tokens FROM documents JOIN n ON k = doc_id GROUP BY source""")
def count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("source", C.token_count("text", small(), spark=spark).alias("n"))
    return counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("n_tokens"))


@query(lambda: f"""WITH {_counts_sql("documents", "doc_id")}
SELECT lang, sum(strlen(text))::DOUBLE / sum(n_tokens)::DOUBLE AS bytes_per_token FROM documents JOIN n ON k = doc_id GROUP BY lang""")
def bytes_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("b"), C.token_count("text", small(), spark=spark).alias("n"))
    return counted.groupBy("lang").agg((F.sum("b") / F.sum("n")).alias("bytes_per_token"))


@query(lambda: f"""WITH {_counts_sql("documents", "doc_id")}
SELECT CASE WHEN grouping(lang) = 1 THEN '(all)' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN '(all)' ELSE source END AS source, sum(n_tokens)::BIGINT AS n_tokens FROM documents JOIN n ON k = doc_id GROUP BY ROLLUP(lang, source)""")
def lang_source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("lang", "source", C.token_count("text", small(), spark=spark).alias("n"))
    # one row per pair before the rollup multiplies them
    pairs = counted.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    rolled = pairs.rollup("lang", "source").agg(F.sum("n").alias("n_tokens"), F.grouping("lang").alias("gl"), F.grouping("source").alias("gs"))
    return rolled.select(F.when(F.col("gl") == 1, "(all)").otherwise(F.col("lang")).alias("lang"), F.when(F.col("gs") == 1, "(all)").otherwise(F.col("source")).alias("source"), "n_tokens")


@query(lambda: f"""WITH p AS (SELECT unnest({sql_split("text")}) AS p FROM documents), c AS (SELECT p, count(*) AS n FROM p GROUP BY p),
t AS (SELECT unnest(regexp_extract_all({sql_symbols("p", small())}, '<[^>]*>')) AS sym, n FROM c)
SELECT v.id::INT AS id, v.hex, sum(n)::BIGINT AS n FROM t JOIN {_tokens_sql(small())} ON v.sym = t.sym GROUP BY v.id, v.hex ORDER BY n DESC, id LIMIT 100""")
def token_freq_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq = token_frequencies(table(spark, sf_dir, "documents"), small())
    top = freq.orderBy(F.desc("n"), "id").limit(100)
    names = small().tokens_df(spark).select("id", F.lower(F.hex("bytes")).alias("hex"))
    return top.join(F.broadcast(names), "id").select("id", "hex", "n")


# added tokens


def _chat() -> str:
    return "'<|im_start|>' || role || chr(10) || text || '<think><|im_end|>' || chr(10)"


def _chat_sql(raw: bool) -> str:
    names = [] if raw else [a.content.decode() for a in small().added]
    cut = f"string_split_regex(s, '{'|'.join(n.replace('|', chr(92) + '|') for n in names)}')" if names else "[s]"
    return f"""WITH c AS (SELECT conv_id, turn, {_chat()} AS s FROM conversations), g AS (SELECT conv_id, turn, unnest({cut}) AS text FROM c),
p AS (SELECT conv_id, turn, unnest({sql_split("text")}) AS p FROM g),
n AS (SELECT conv_id, sum(len({sql_symbols("p", small())}) - len(replace({sql_symbols("p", small())}, '<', '')))::BIGINT AS n FROM p GROUP BY conv_id),
a AS (SELECT conv_id, {0 if raw else 3} * count(*) AS a FROM c GROUP BY conv_id)
SELECT n.conv_id, (n + a)::BIGINT AS n_tokens FROM n JOIN a ON a.conv_id = n.conv_id"""


def _chat_count(spark: SparkSession, sf_dir: str, raw: bool) -> DataFrame:
    text = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<think><|im_end|>\n"))
    counted = table(spark, sf_dir, "conversations").select("conv_id", C.token_count(text, small(), raw, spark).alias("n"))
    return counted.groupBy("conv_id").agg(F.sum("n").alias("n_tokens"))


@query(lambda: _chat_sql(False))
def chat_encode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat_count(spark, sf_dir, False)


@query(lambda: _chat_sql(True))
def chat_encode_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat_count(spark, sf_dir, True)


# decoding


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decode_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding with the full vocabulary gives the text back."""
    coded = table(spark, sf_dir, "documents").select("doc_id", C.encode("text", full(), spark=spark).alias("ids"))
    return coded.select("doc_id", F.md5(C.decode("ids", full(), spark=spark)).alias("digest"))


@query("SELECT conv_id, turn, md5(role || chr(10) || text || '<think>' || chr(10)) AS digest FROM conversations")
def decode_skip_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special added tokens are left out, the other added one stays."""
    text = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<think><|im_end|>\n"))
    coded = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.encode(text, full(), spark=spark).alias("ids"))
    return coded.select("conv_id", "turn", F.md5(C.decode("ids", full(), True, spark=spark)).alias("digest"))


@query("SELECT item_id, md5(text) AS digest FROM benchmark")
def decode_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "benchmark"), full()).select("item_id", "ids")
    return decode_join(coded, full(), "item_id").select("item_id", F.md5("bytes").alias("digest"))


# budgets


@query(lambda: f"""WITH {_counts_sql("documents", "doc_id")}
SELECT doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, least(coalesce(n_tokens, 0), {BUDGET})::BIGINT AS kept FROM documents LEFT JOIN n ON k = doc_id""")
def truncate_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), small())
    return coded.select("doc_id", "n_tokens", F.size(C.truncate("ids", BUDGET)).cast("long").alias("kept"))


@query(lambda: f"""WITH {_counts_sql("documents", "doc_id")}
SELECT doc_id, (n_tokens - {BUDGET})::BIGINT AS over_by FROM documents JOIN n ON k = doc_id WHERE n_tokens > {BUDGET}""")
def over_budget_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), small(), ids=False)
    return counted.where(F.col("n_tokens") > BUDGET).select("doc_id", (F.col("n_tokens") - BUDGET).alias("over_by"))


# sources, vocabularies, analytics


@query("""WITH RECURSIVE l AS (SELECT doc_id, i, x[i] || CASE WHEN i < len(x) THEN chr(10) ELSE '' END AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
c AS (SELECT doc_id, i, line, ends_with(line, chr(10)) AS whole, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY i) AS cum, sum(strlen(line)) OVER (PARTITION BY doc_id) AS total FROM l WHERE line <> ''),
r AS (SELECT doc_id, -1 AS doc, 0::BIGINT AS s, 0::BIGINT AS e, max(total)::BIGINT AS total FROM c GROUP BY doc_id
  UNION ALL SELECT r.doc_id, r.doc + 1, r.e, coalesce(min(c.cum) FILTER (c.whole AND c.cum > r.e + 8192), r.total)::BIGINT, r.total FROM r JOIN c ON c.doc_id = r.doc_id WHERE r.e < r.total GROUP BY r.doc_id, r.doc, r.e, r.total)
SELECT r.doc_id, r.doc::INT AS doc, (r.e - r.s)::INT AS n_bytes, md5(string_agg(c.line, '' ORDER BY c.i)) AS digest FROM r JOIN c ON c.doc_id = r.doc_id AND c.cum > r.s AND c.cum <= r.e WHERE r.doc >= 0 GROUP BY r.doc_id, r.doc, r.s, r.e""")
def doc_split_8192(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that long texts are cut into: doc, bytes, digest, by source text."""
    cut = split_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    return cut.select("doc_id", "doc", F.length("content").alias("n_bytes"), F.md5("content").alias("digest"))


@query("SELECT conv_id, turn, CASE WHEN strpos(text, 'x') > 0 THEN 1 ELSE 0 END AS has, (turn * 3 + 1)::BIGINT AS total FROM conversations")
def parse_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id lists in text: numbers found among all else."""
    t = table(spark, sf_dir, "conversations")
    listed = F.concat(F.col("turn").cast("string"), F.lit(" x"), (F.col("turn") + 1).cast("string"), F.lit("\n,"), F.col("turn").cast("string"))
    return t.select("conv_id", "turn", F.when(F.contains(F.col("text"), F.lit("x")), 1).otherwise(0).alias("has"), F.aggregate(C.parse_ids(listed), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(lambda: "SELECT * FROM " + _values([(i, t.hex()) for i, t in enumerate(toy().tokens)], "t(id, hex)"))
def vocab_tokens_toy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as an image, read back, listed."""
    return bpv.read_image(bpv.write_image(toy()), strict=True).tokens_df(spark).select("id", F.lower(F.hex("bytes")).alias("hex"))


def broken_images() -> list[tuple[str, bytes]]:
    """A sound image, and images each broken in one way."""
    good = bpv.write_image(toy())
    head = bpv.HEADER.unpack_from(good)
    at = dict(zip(bpv.SECTIONS, head[8:20:2], strict=True))

    def patch(place: int, value: int, size: int = 4) -> bytes:
        out = bytearray(good)
        out[place : place + size] = value.to_bytes(size, "little")
        return bytes(out)

    def full_table() -> bytes:
        out = bytearray(good)
        for k in range(head[13] // 16):
            out[head[12] + 16 * k : head[12] + 16 * k + 16] = (k << 32 | 1).to_bytes(8, "little") + (1).to_bytes(8, "little")
        return bytes(out)

    added = good[at["added"] : at["added"] + 32]
    swapped = good[: at["added"]] + added[16:] + added[:16] + good[at["added"] + 32 :]
    slot = next(k for k in range(0, head[12 + 1], 16) if good[at["pair_table"] + k : at["pair_table"] + k + 8] != b"\xff" * 8) + at["pair_table"]
    return [
        ("sound", good),
        ("magic", patch(0, 1)),
        ("version", patch(4, 2)),
        ("profile", patch(12, 7)),
        ("no_tokens", patch(16, 0)),
        ("many_tokens", patch(16, 1 << 22)),
        ("many_added", patch(20, 65)),
        ("slots", patch(24, 33)),
        ("unaligned", patch(32, at["token_offsets"] + 4, 8)),
        ("outside", patch(48, 1 << 40, 8)),
        ("overlap", patch(32 + 16 * 5, at["added"], 8)),
        ("offsets", patch(at["token_offsets"] + 8, 1 << 20)),
        ("byte_range", patch(at["byte_to_id"] + 40, 1 << 20)),
        ("byte_token", patch(at["byte_to_id"] + 40, toy().byte_ids[11])),
        ("added_range", patch(at["added"], 1 << 20)),
        ("added_length", patch(at["added"] + 8, 0)),
        ("added_span", patch(at["added"] + 8, 3)),
        ("pair_key", patch(slot, 1 << 20)),
        ("pair_value", patch(slot + 8, 1 << 20)),
        ("empty", b""),
        ("head_only", good[:100]),
        ("cut_short", good[:-300]),
        ("profile_zero", patch(12, 0)),
        ("section_huge", patch(40, (1 << 64) - 64, 8)),
        ("section_far", patch(32, 1 << 63, 8)),
        ("unaligned_meta", patch(32 + 16 * 5, at["meta"] + 4, 8)),
        ("added_moved", patch(at["added"] + 4, 0)),
        ("added_order", swapped),
        ("meta", patch(at["meta"], 1 << 20)),
        ("meta_gone", patch(40 + 16 * 5, 0, 8)),
        ("pair_full", full_table()),
        ("no_slots", patch(24, 0)),
    ]


def rules_of(image: bytes) -> list[str]:
    """The rules that an image breaks."""
    try:
        return sorted({r for r, _ in bpv.violations(image)})
    except InputError:
        return ["too_short"]


def changed_json(how: dict[str, object]) -> bytes:
    """The toy's tokenizer file with some values changed, by their paths."""
    source = json.loads(toy_json())
    for path, value in how.items():
        place, keys = source, path.split("__")
        for k in keys[:-1]:
            place = place[int(k) if k.isdigit() else k]
        place[keys[-1]] = value
    return json.dumps(source).encode()


#: Changes to a tokenizer file, and whether it still is one of the supported kind.
FILES: list[tuple[str, dict[str, object], bool]] = [
    ("as it is", {}, True), ("no normalizer", {"normalizer": None}, True), ("another decoder", {"decoder": {"type": "Metaspace"}}, True), ("merges as strings", {"model__merges": ["a b", "b c"]}, True),
    ("compatibility forms", {"normalizer": {"type": "NFKC"}}, False), ("an option of the normalizer", {"normalizer": {"type": "NFC", "x": 1}}, False), ("no splitting", {"pre_tokenizer": None}, False),
    ("removed separators", {"pre_tokenizer__pretokenizers__0__behavior": "Removed"}, False), ("inverted", {"pre_tokenizer__pretokenizers__0__invert": True}, False), ("another pattern", {"pre_tokenizer__pretokenizers__0__pattern": {"Regex": "x"}}, False),
    ("a blank before", {"pre_tokenizer__pretokenizers__1__add_prefix_space": True}, False), ("its own pattern", {"pre_tokenizer__pretokenizers__1__use_regex": True}, False), ("dropout", {"model__dropout": 0.1}, False), ("unknown token", {"model__unk_token": "x"}, False),
    ("prefix of pieces", {"model__continuing_subword_prefix": "##"}, False), ("fused unknowns", {"model__fuse_unk": True}, False), ("byte fallback", {"model__byte_fallback": True}, False), ("merges ignored", {"model__ignore_merges": True}, False),
    ("a number for false", {"model__ignore_merges": 0}, False), ("another model", {"model__type": "Unigram"}, False), ("added token that takes blanks", {"added_tokens__0__lstrip": True}, False), ("empty added token", {"added_tokens__0__content": ""}, False),
    ("id as text", {"added_tokens__0__id": "1"}, False), ("id of another added token", {"added_tokens__0__id": 263}, False), ("id of a token", {"added_tokens__0__id": 3}, False), ("added token twice", {"added_tokens__0__content": "[PAD]"}, False),
    ("merge twice", {"model__merges": [["a", "b"], ["a", "b"]]}, False), ("merge of three", {"model__merges": ["a b c"]}, False), ("side that is no token", {"model__merges": [["a", "q"]]}, False), ("bytes without tokens", {"model__vocab": {"a": 0}}, False),
    ("characters that stand for no byte", {"model__vocab": {"漢": 0}}, False), ("id twice", {"model__vocab__zz": 5}, False),
]


_BROKEN = [
    ("magic", "magic"), ("version", "version"), ("profile", "profile"), ("no_tokens", "section_size"), ("no_tokens", "vocab_count"), ("many_tokens", "section_size"), ("many_tokens", "vocab_count"),
    ("many_added", "added_count"), ("many_added", "section_size"), ("slots", "pair_slots_log2"), ("slots", "section_size"), ("unaligned", "section_alignment"), ("outside", "section_bounds"),
    ("overlap", "section_overlap"), ("offsets", "byte_token"), ("offsets", "offsets_bounds"), ("offsets", "offsets_order"), ("byte_range", "byte_range"), ("byte_token", "byte_token"), ("added_range", "added_range"), ("added_length", "added_length"), ("added_length", "added_span"),
    ("added_span", "added_span"), ("pair_key", "pair_range"), ("pair_value", "pair_range"),
    ("empty", "too_short"), ("head_only", "too_short"), ("cut_short", "section_bounds"), ("profile_zero", "profile"), ("section_huge", "section_bounds"), ("section_huge", "section_overlap"), ("section_huge", "section_size"), ("section_far", "section_bounds"),
    ("unaligned_meta", "section_alignment"), ("added_moved", "added_span"), ("added_order", "added_order"), ("meta", "meta"), ("meta_gone", "meta"), ("pair_full", "pair_load"), ("no_slots", "section_size"),
]


@query(lambda: "SELECT * FROM " + _values(_BROKEN, "t(image, rule)"))
def vocab_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = spark.createDataFrame([(n, bytearray(x)) for n, x in broken_images()], "image string, content binary")
    # a few hundred bytes each: the size of the data isn't theirs
    rules = F.udf(lambda x: rules_of(bytes(x)), "array<string>")
    return images.select("image", F.explode(rules("content")).alias("rule"))


@query(lambda: "SELECT * FROM " + _values([(n, ok) for n, _, ok in FILES], "t(file, accepted)"))
def converter_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokenizer files are taken: every rule of the converter broken once."""

    def accepted(raw: bytes) -> bool:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                from_tokenizer_json(bytes(raw))
        except FormatError:
            return False
        return True

    files = spark.createDataFrame([(n, bytearray(changed_json(how))) for n, how, _ in FILES], "file string, content binary")
    return files.select("file", F.udf(accepted, "boolean")("content").alias("accepted"))


@query("SELECT doc_id, md5(unhex('FF') || encode(text) || unhex('C3')) AS digest, 2 + strlen(text)::BIGINT AS n_bytes FROM documents")
def binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no text, a stray one before each document and a broken character behind it, encoded and decoded."""
    data = F.concat(F.unhex(F.lit("FF")), F.encode("text", "utf-8"), F.unhex(F.lit("C3")))
    coded = table(spark, sf_dir, "documents").select("doc_id", encode_bytes_column(data, small(), spark=spark).alias("ids"))
    back = C.decode("ids", small(), spark=spark)
    return coded.select("doc_id", back.alias("b")).select("doc_id", F.md5("b").alias("digest"), F.length("b").cast("long").alias("n_bytes"))


def _barriers() -> str:
    return " AND ".join(["cp NOT BETWEEN 55296 AND 57343", "cp > 0", *(f"cp NOT BETWEEN {a} AND {b}" for a, b in BARRIERS)])


@query(lambda: f"""WITH c AS (SELECT cp, chr(cp::INT) AS c FROM (SELECT unnest(range(0, 1114112)) AS cp) WHERE {_barriers()}),
f AS (SELECT cp, 'alone' AS form, c AS t FROM c UNION ALL SELECT cp, 'after', 'a' || c FROM c UNION ALL SELECT cp, 'before', c || chr(769) FROM c UNION ALL SELECT cp, 'mark', 'a' || chr(803) || chr(820) || c FROM c)
SELECT cp::INT AS cp, form, hex(encode(nfc_normalize(t))) AS hex FROM f WHERE nfc_normalize(t) <> t""")
def nfc_sweep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What NFC makes of every character but those of later versions: alone, after a letter, before and after marks."""
    return fp.nfc_sweep(spark).where(_barriers())


@query("SELECT * FROM (VALUES ('added', '-', 2::BIGINT), ('self', '-', 132), ('context', '-', 115), ('impossible', 'invalid-utf8', 13), ('impossible', 'pretoken-shape', 1), ('impossible', 'merge-order', 1)) AS t(verdict, reason, n)")
def census_summary_toy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cen.summary(cen.census(spark, toy(), deep=True)).where("verdict is not null and reason is not null")


@query("SELECT 0::BIGINT AS failed")
def census_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every witness of the small vocabulary, encoded again, has its token."""
    return cen.verify(spark, small(), cen.census(spark, small())).agg(F.count("*").alias("failed"))


@query()
def census_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability of the whole public vocabulary by script."""
    return cen.by_script(cen.census(spark, full()))


@query("SELECT * FROM (VALUES ('letter', 141028::BIGINT), ('number', 1911), ('whitespace', 22), ('blank', 1), ('newline', 2), ('other', 969100)) AS t(class, n)")
def class_sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.class_sweep(spark).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT 'pipeline' AS section, 'name' AS key, 'toy' AS \"left\", 'other' AS \"right\" UNION ALL SELECT 'pipeline', 'added', '2', '1' UNION ALL SELECT 'pipeline', 'size', '264', '263'")
def fingerprint_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vocabularies that differ in their name and one added token."""
    from dataclasses import replace

    other = replace(toy(), name="other", added=toy().added[:1], tokens=toy().tokens[:263])
    return fp.diff(fp.take(spark, toy(), quick=True), fp.take(spark, other, quick=True))


def count_tokens(text: Column | str, spark: SparkSession) -> Column:
    return C.token_count(text, full(), spark=spark)


@query(lambda: f"""WITH RECURSIVE q AS (SELECT lang, p, count(*) AS n FROM (SELECT lang, unnest({sql_split("text")}) AS p FROM documents) GROUP BY lang, p), w AS (SELECT DISTINCT p FROM q), {_bpe_sql(full())},
c AS (SELECT lang, sum(n * (len(s) - len(replace(s, '<', ''))))::BIGINT AS n_tokens FROM q JOIN done ON done.p = q.p GROUP BY lang)
SELECT d.lang, d.docs, c.n_tokens FROM (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) d LEFT JOIN c ON c.lang = d.lang""")
def encode_full_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per language with the whole public vocabulary."""
    counted = table(spark, sf_dir, "documents").select("lang", count_tokens("text", spark).alias("n"))
    return counted.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("n_tokens"))
