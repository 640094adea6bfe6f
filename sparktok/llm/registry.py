"""One query for each corpus operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets as S
from . import text as T
from .chat import turn_spans
from .decontam import contamination
from .langid import language_id
from .license_scan import license_scan
from .licenses import TEMPLATES
from .lm import lm_scores
from .mixing import copies
from .ngram_join import jaccard_join
from .secrets import secrets
from .topk import TopK, top_k
from .toxic_terms import Learning, learn
from .toxicity import EXCEPTIONS, LEXICON, Toxicity, toxic_documents

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every one whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), TopK(every=50))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's place in its conversation's rendering by three templates."""
    return turn_spans(table(spark, sf_dir, "conversations"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rate and copies such that all sources have the same share of tokens."""
    return copies(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of links, other documents whose word trigram sets have a Jaccard similarity of 0.5 or more with its own, and the class that links connect it to."""
    return jaccard_join(table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that each document holds the wording of."""
    return license_scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose score is over the threshold, with their scores; the lexicon has what a sample of labelled documents teaches."""
    docs = table(spark, sf_dir, "documents")
    found = toxic_documents(docs, learned=learn(docs, table(spark, sf_dir, "labels"), Toxicity().threshold))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "score")})


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in each document."""
    return secrets(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 9))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model trained on a sample of the labelled ones."""
    return language_id(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under an interpolated word n-gram model of all others."""
    return lm_scores(table(spark, sf_dir, "documents"))


_SHINGLES = f"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '{T.WORD_RE2}') AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id)"""

SQL6 = f"""
WITH RECURSIVE {_SHINGLES},
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pair AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c)::DOUBLE >= 0.5),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM documents WHERE doc_id IS NOT NULL UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM link WHERE link.a = reach.a) AS n_links FROM reach GROUP BY a
"""

_BIGRAMS = "CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL1 = f"""
WITH tpl AS (SELECT name, regexp_extract_all(lower(wording), '{T.WORD_RE2}') AS w FROM (VALUES {", ".join(f"({_quoted(n)}, {_quoted(x)})" for n, x in TEMPLATES)}) AS v(name, wording)),
t AS (SELECT name, {_BIGRAMS} AS sh FROM tpl),
u AS (SELECT name, list_distinct(sh) AS own, len(sh) AS m, greatest(len(sh), ceil(len(sh) * 1.25))::BIGINT AS win FROM t),
x AS (SELECT doc_id, regexp_extract_all(lower(text), '{T.WORD_RE2}') AS w FROM documents),
d AS (SELECT doc_id, {_BIGRAMS} AS sh FROM x),
c AS (SELECT doc_id, sh, name, own, least(win, len(sh)) AS size, greatest(1, (win - m) // 2) AS stride FROM d JOIN u ON len(list_intersect(list_distinct(sh), own)) >= 0.8 * len(own) - 1e-9),
a AS (SELECT *, unnest(list_distinct(list_concat(range(0, len(sh) - size + 1, stride), [len(sh) - size]))) AS pos FROM c),
s AS (SELECT doc_id, name, pos, size, len(list_intersect(list_distinct(sh[pos + 1 : pos + size]), own))::DOUBLE / len(own)::DOUBLE AS share FROM a),
b AS (SELECT * FROM s WHERE share >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY share DESC, pos, size) = 1)
SELECT doc_id, name AS license, share AS containment, pos::BIGINT AS start_word, (size + 1)::BIGINT AS n_words FROM b
WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.pos < b.pos + b.size + 1 AND b.pos < o.pos + o.size + 1 AND o.share > b.share)
"""


_FOLDED = {"a": "[a4@]", "b": "[b8]", "e": "[e3]", "g": "[g9]", "i": "[i1!|]", "l": "[l1!|]", "o": "[o0]", "s": "[s5$]", "t": "[t7+]", " ": "  "}


def _spelt(term: str) -> str:
    return "".join(_FOLDED.get(c, c) for c in term)


def _any_of(terms: list[str]) -> str:
    """One of some terms as whole words, in a text that has two blanks between words and around."""
    return _quoted(" (?:" + "|".join(_spelt(t) for t in sorted(terms, key=len, reverse=True)) + ") ")


def _gain(a: str, b: str, p: str, n: str) -> str:
    """G² of toxic_terms.gain()."""
    k = f"({a} + {b})"
    part = lambda x, e: f"(CASE WHEN {x} > 0 THEN {x} * ln({x} / ({e})) ELSE 0 END)"
    rest, all_ = f"({p} + {n} - {k})", f"({p} + {n})::DOUBLE"
    return f"CASE WHEN {a} * {n} > {b} * {p} THEN round(2 * ({part(a, f'{k} * {p} / {all_}')} + {part(b, f'{k} * {n} / {all_}')} + {part(f'({p} - {a})', f'{rest} * {p} / {all_}')} + {part(f'({n} - {b})', f'{rest} * {n} / {all_}')}), 6) ELSE 0 END"


_LEARN = Learning()
_PHRASES = [t for t in LEXICON if " " in t]
#: Accents and digits are folded as the operator does; look-alikes of other scripts, which no table has, are not. All labelled
#: documents are learned from, which is what the operator does up to its bound. No automaton, and terms are chosen over lists.
SQL2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(strip_accents(lower(text)), '[$]?[\\p{{L}}\\p{{N}}]+(?:[@$!|+][\\p{{L}}\\p{{N}}]+)*') AS w FROM documents),
lab AS (SELECT doc_id, max((toxic > 0)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
one AS (SELECT doc_id, min(text) AS text, max(toxic) AS toxic FROM w JOIN lab USING (doc_id) WHERE text IS NOT NULL GROUP BY doc_id),
d AS (SELECT lower(text) AS text, max(toxic) AS toxic, min(doc_id) AS doc FROM one GROUP BY lower(text)),
dw AS (SELECT d.doc, d.toxic, len(any_value(w.w)) AS words, any_value(w.w) AS w FROM d JOIN w ON lower(w.text) = d.text GROUP BY d.doc, d.toxic),
word AS (SELECT doc, w, count(*) AS n FROM (SELECT doc, translate(unnest(w), '0134578 9@$!|+l', 'oieastb gasiiti') AS w FROM dw) GROUP BY doc, w),
spelt AS (SELECT * FROM word WHERE regexp_full_match(w, '[a-z]{{{_LEARN.shortest},}}')),
term AS (SELECT doc, t, sum(n) AS n FROM (SELECT doc, n, w || '$' AS t FROM spelt WHERE len(w) <= {_LEARN.longest} UNION ALL SELECT doc, n, w[1 : unnest(range({_LEARN.shortest}, least(len(w), {_LEARN.longest}) + 1))] FROM spelt) GROUP BY doc, t),
n AS (SELECT sum(toxic) AS p, sum(1 - toxic) AS n, sum(words) FILTER (toxic = 0) AS clean FROM dw),
c AS (SELECT t, list(doc) FILTER (toxic = 1) AS docs, count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic = 0) AS b FROM term JOIN dw USING (doc) GROUP BY t HAVING count(*) FILTER (toxic = 1) >= {_LEARN.least}),
likely AS (SELECT c.*, n.n FROM c, n WHERE {_gain("a", "b", "p", "n")} >= {_LEARN.gain}),
pick AS (
  SELECT 0 AS k, ''::VARCHAR AS t, 1e9::DOUBLE AS g, (SELECT list(doc) FROM dw WHERE toxic = 1) AS live
  UNION ALL
  SELECT k + 1, best.t, best.g, list_filter(live, lambda x: NOT list_contains(best.docs, x)) FROM (
    SELECT k, live, first(struct_pack(t, g, docs) ORDER BY g DESC, len(t) DESC, t) AS best FROM (
      SELECT k, live, t, docs, {_gain("a", "b", "p", "n")} AS g FROM (SELECT pick.k, pick.live, likely.t, docs, b, n, len(list_intersect(docs, live)) AS a, len(live) AS p FROM pick, likely WHERE pick.g >= {_LEARN.gain}) WHERE a >= {_LEARN.least})
    GROUP BY k, live)),
rate AS (SELECT term.t, 1000 * sum(term.n) FILTER (toxic = 1) / sum(words) FILTER (toxic = 1) AS high, coalesce(1000 * sum(term.n) FILTER (toxic = 0) / sum(words) FILTER (toxic = 0), 500.0 / any_value(n.clean)) AS low
  FROM (SELECT DISTINCT t FROM pick WHERE g >= {_LEARN.gain} AND k > 0) JOIN term USING (t) JOIN dw USING (doc), n GROUP BY term.t),
learned AS (SELECT t, round(least({_LEARN.most}, 2.5 * ln(high / low) / (high - low)), 3) AS x FROM rate WHERE high > low),
base AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(t.replace('l', 'i'))}, {_quoted(_spelt(t))}, {x}::DOUBLE)" for t, x in LEXICON.items() if " " not in t)}) AS v(c, spelling, x)),
t AS (SELECT doc_id, row_number() OVER () AS r, len(w)::BIGINT AS n, regexp_replace('  ' || array_to_string(w, '  ') || '  ', {_any_of(EXCEPTIONS)}, ' * ', 'g') AS t FROM w),
u AS (SELECT r, w, translate(w, '0134578 9@$!|+l', 'oieastb gasiiti') AS c, count(*) AS m FROM (SELECT r, unnest(string_split(t, ' ')) AS w FROM t) WHERE w NOT IN ('', '*') GROUP BY r, w),
hit AS (SELECT r, w, m, x FROM u JOIN base ON base.c = u.c AND regexp_full_match(u.w, base.spelling)
  UNION ALL SELECT r, w, m, x FROM u JOIN learned ON learned.t = u.c || '$' UNION ALL SELECT r, w, m, x FROM u JOIN learned ON starts_with(u.c, learned.t)),
h AS (SELECT r, sum(m) AS terms, sum(m * x) AS weight FROM (SELECT r, w, m, max(x) AS x FROM hit GROUP BY r, w, m) GROUP BY r),
s AS (SELECT doc_id, n AS n_words, (coalesce(terms, 0){"".join(f" + len(regexp_extract_all(t, {_any_of([x])}))" for x in _PHRASES)})::BIGINT AS n_terms, (coalesce(weight, 0){"".join(f" + {LEXICON[x]} * len(regexp_extract_all(t, {_any_of([x])}))" for x in _PHRASES)})::DOUBLE AS weight FROM t LEFT JOIN h ON h.r = t.r)
SELECT doc_id, n_words, n_terms, round(weight, 6) AS weight, round(1000::DOUBLE * weight / greatest(n_words, 20)::DOUBLE, 6) AS score FROM s WHERE 1000::DOUBLE * weight / greatest(n_words, 20)::DOUBLE > 2.5
"""


def _trigrams(table_: str, key: str) -> str:
    return f"SELECT {key}, w, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM (SELECT {key}, regexp_extract_all(lower(text), '{T.WORD_RE2}') AS w FROM {table_})"


#: Every window of an item's size, for items of whose weight the document has enough at all; no fingerprints.
SQL8 = f"""
WITH d AS ({_trigrams("documents", "doc_id")}), b AS (SELECT * FROM ({_trigrams("benchmark", "item_id")}) WHERE len(sh) > 0 AND item_id IS NOT NULL),
i AS (SELECT item_id, s, count(*) AS n FROM (SELECT item_id, unnest(sh) AS s FROM b) GROUP BY item_id, s),
f AS (SELECT s, ln(1 + (SELECT count(*) FROM b)::DOUBLE / count(*)) AS w FROM i GROUP BY s),
iw AS (SELECT i.item_id, i.s, i.n, f.w FROM i JOIN f ON f.s = i.s), tot AS (SELECT item_id, sum(n * w) AS w FROM iw GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(sh) AS s FROM d)),
c AS (SELECT ds.doc_id, iw.item_id FROM ds JOIN iw ON iw.s = ds.s JOIN tot ON tot.item_id = iw.item_id GROUP BY ds.doc_id, iw.item_id, tot.w HAVING sum(iw.n * iw.w) >= 0.6 * tot.w - 1e-9),
x AS (SELECT c.doc_id, c.item_id, len(b.w) AS words, d.sh, least(len(d.sh), len(b.sh)) AS size, unnest(range(0, len(d.sh) - least(len(d.sh), len(b.sh)) + 1)) AS pos FROM c JOIN d ON d.doc_id = c.doc_id JOIN b ON b.item_id = c.item_id),
y AS (SELECT doc_id, item_id, words, pos, s, count(*) AS n FROM (SELECT doc_id, item_id, words, pos, unnest(sh[pos + 1 : pos + size]) AS s FROM x) GROUP BY ALL),
z AS (SELECT y.doc_id, y.item_id, y.words, y.pos, sum(y.n * coalesce(f.w, ln(1 + (SELECT count(*) FROM b)::DOUBLE))) AS own, sum(least(y.n, coalesce(iw.n, 0)) * coalesce(iw.w, 0)) AS shared
  FROM y LEFT JOIN f ON f.s = y.s LEFT JOIN iw ON iw.s = y.s AND iw.item_id = y.item_id GROUP BY ALL),
r AS (SELECT z.doc_id, z.item_id, words, pos, round(shared / (own + tot.w - shared), 9) AS similarity FROM z JOIN tot ON tot.item_id = z.item_id)
SELECT doc_id, item_id, similarity, pos::BIGINT AS start_word, words::BIGINT AS n_words FROM r WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, pos) = 1
"""


def _rule_sql(name: str, rule: str) -> str:
    """Matches of one rule with the signs around them, and what lies between: places are sums of lengths. Two matches with one sign between them would be one here; no table has such."""
    body = rule.removeprefix("(?i)")
    for a in ("(AKIA", "([A-Z]", "(live", "(access", "(token"):
        body = body.replace(a, "(?:" + a[1:])
    flag = "(?i)" if rule.startswith("(?i)") else ""
    pattern = _quoted(f"{flag}(?:^|[^0-9A-Za-z_\\-])({body})(?:[^0-9A-Za-z_\\-]|$)")
    return f"""SELECT doc_id, '{name}' AS rule, text, string_split_regex(text, {pattern}) AS gap, regexp_extract_all(text, {pattern}, 0) AS hit, regexp_extract_all(text, {pattern}, 1) AS own
FROM documents WHERE regexp_matches(text, {pattern})"""


SQL7 = f"""
WITH m AS ({" UNION ALL ".join(_rule_sql(n, r) for n, r in S.RULES)}),
k AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m)
SELECT doc_id, rule, (coalesce(list_sum(list_transform(gap[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hit[1 : i - 1], lambda h: length(h))), 0) + strpos(hit[i], own[i]) - 1)::BIGINT AS start, length(own[i])::BIGINT AS n_chars FROM k
"""

SQL3 = """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.id AS q, b.id AS n, list_distance(a.v, b.v) AS d FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, n) AS r FROM d)
SELECT q AS query_id, r::BIGINT AS rank, n AS neighbor_id, round(d, 6) AS distance FROM r WHERE r <= 10
"""

SQL4 = """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER w AS position, length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)) AS n,
  length('[' || role || '] ' || text || ' [/' || role || ']') AS c
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cbefore,
  lag(n) OVER w AS n1, lag(role) OVER w AS role1, lead(role) OVER w AS role2 FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY position))
SELECT 'chatml' AS template, conv_id, position, turn, role, 'append' AS status, before::BIGINT AS start, (before + n)::BIGINT AS "end", NULL::BIGINT AS rewritten_at FROM s
UNION ALL
SELECT 'closed', conv_id, position, turn, role, 'trailer', (3 + cbefore)::BIGINT, (3 + cbefore + c)::BIGINT, NULL FROM s
UNION ALL
SELECT 'reasoning', conv_id, position, turn, role, CASE WHEN role1 = 'assistant' THEN 'rewrite' ELSE 'append' END,
  (CASE WHEN role1 = 'assistant' THEN before - n1 + 22 ELSE before END)::BIGINT, (before + n + CASE WHEN role = 'assistant' THEN 19 ELSE 0 END)::BIGINT,
  CASE WHEN role = 'assistant' AND role2 IS NOT NULL THEN position + 1 END FROM s
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_license_scan, op2_toxicity, op3_exact_topk, op4_chat_formatting, op5_source_mixing, op6_ngram_jaccard_join, op7_secret_scan, op8_benchmark_decontamination, op9_language_id, op10_lm_scoring)}
SQL: dict[str, str] = {"op1_license_scan": SQL1, "op2_toxicity": SQL2, "op3_exact_topk": SQL3, "op4_chat_formatting": SQL4, "op6_ngram_jaccard_join": SQL6, "op7_secret_scan": SQL7, "op8_benchmark_decontamination": SQL8}
