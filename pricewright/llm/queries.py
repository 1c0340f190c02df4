"""The registered queries of this subpackage, and their results in SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import load
from . import edit_counts, personal_data, quality_rules, source_audit, spelling_forms, url_filter
from .fm_dedup import remove_repeated_words
from .line_dedup import dedup_lines
from .mixing import KEYS, mix_sources
from .parity_join import jaccard_components
from .piece_codec import encode_documents
from .suffix_dedup import remove_repeated_bytes
from .tile_search import nearest

TOKENIZERS = os.path.dirname(public_tokenizers.path("piece_bpe_32k.model"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small labelled table is a bounded sample of the URLs that a rule judges."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    labelled = url_filter.with_rule(pages).withColumnRenamed("rule_verdict", "verdict")
    model = url_filter.train(labelled)
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"t.{k}")) for k in KEYS]
    return mix.documents.alias("d").join(mix.taken().hint("merge").alias("t"), same, "left").select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    out = encode_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0")).withColumnRenamed("id", "vec_id")


def op10_token_counts(spark: SparkSession, sf_dir: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Token counts of every text before and after three edits drawn from the row itself."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    trees = edit_counts.build_trees(docs, ranks).withColumns(
        {"n_before": F.col("n_tokens"), "edits": edit_counts.drawn_edits(F.col("text"), F.col("doc_id"))}
    )
    after = edit_counts.apply_edits(trees, ranks)
    return after.select("doc_id", "n_before", "n_tokens", "n_matched", F.sha2("text", 256).alias("text_sha256"))


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms.group_spellings(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = personal_data.find_personal_data(docs, personal_data.train(docs))
    counts = [f"n_{kind}" for kind in personal_data.KINDS]
    return out.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(load(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_line_dedup,
    op2_suffix_array_dedup,
    op3_url_filter,
    op4_ngram_jaccard_join,
    op5_quality_rules,
    op6_source_mixing,
    op7_substring_dedup,
    op8_sentencepiece,
    op9_nearest_neighbours,
    op10_token_counts,
    op11_spelling_forms,
    op12_personal_data,
    op13_source_audit,
)
QUERIES = {operator.__name__: operator for operator in _OPERATORS}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT doc_id, pos, line, coalesce(owner < doc_id, false) AS gone FROM keyed LEFT JOIN owners USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _rule_sql(rule: quality_rules.Rule) -> str:
    per = f"{rule.per}::DOUBLE" if rule.per else "1.0::DOUBLE"
    tests = [f"{rule.measure} < {per} * {rule.low}::DOUBLE"] if rule.low is not None else []
    tests += [f"{rule.measure} > {per} * {rule.high}::DOUBLE"] if rule.high is not None else []
    return f"(({' OR '.join(tests)}) AND {per} > 0)"


QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS l FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams),
covered AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM counted WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))})))::BIGINT AS n_stop_words
  FROM d LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, {' OR '.join(map(_rule_sql, quality_rules.BASE_RULES))} AS base_failed, {' OR '.join(map(_rule_sql, quality_rules.RULES))} AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT broken AS kept FROM judged"""

BYTE_DEDUP_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, base, substring(h, 2 * base + 1, 2 * (512 + 49)) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 512)) AS base FROM b)),
w AS (SELECT doc_id, base + i AS i, substring(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, base, h, unnest(range(0, least(512, len(h) // 2 - 49))) AS i FROM q)),
o AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM w JOIN o USING (k) WHERE m < doc_id),
n AS (SELECT doc_id, i, count(*) FILTER (step IS NULL OR step > 50) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM n GROUP BY doc_id, run),
p AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM r),
k AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS tail,
        string_agg(substring(h, (2 * prev + 1)::BIGINT, (2 * (s - prev))::BIGINT), '' ORDER BY s) AS head FROM p JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substring(h, (2 * tail + 1)::BIGINT) END)) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)"""

WORD_DEDUP_SQL = f"""
WITH b AS (SELECT doc_id, {_WORDS} AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i:i + 49], ' ') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS i FROM b)),
o AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
g AS (SELECT doc_id, i FROM w JOIN o USING (k) WHERE m < doc_id),
c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM g) GROUP BY doc_id),
x AS (SELECT doc_id, j, l[j] AS word FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS j FROM b)),
d AS (SELECT doc_id, unnest(gone) AS j FROM c),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN d USING (doc_id, j) GROUP BY doc_id)
SELECT b.doc_id, len(l)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM b LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

JACCARD_SQL = f"""
WITH RECURSIVE b AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 3 THEN [array_to_string(l, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], ' ')))) END AS sh FROM b),
c AS (SELECT sh, min(doc_id) AS id, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT id, n, unnest(sh) AS g FROM c),
i AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS sizes, count(*) AS common FROM t x JOIN t y ON x.g = y.g AND x.id < y.id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL),
e AS (SELECT a, b FROM i WHERE 100 * common >= 90 * (sizes - common)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, far) AS (SELECT id, id FROM c UNION SELECT reach.id, sym.b FROM reach JOIN sym ON reach.far = sym.a),
least_id AS (SELECT id, min(far) AS component FROM reach GROUP BY id)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(component, s.doc_id) AS component_id
FROM s LEFT JOIN c USING (sh) LEFT JOIN least_id ON c.id = least_id.id"""

SOURCE_AUDIT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
v AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT row) >= {source_audit.MIN_DOCS}),
s AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM d JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT s.lang, s.source, v.term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY s.lang, s.source) AS total,
        count(*) OVER (PARTITION BY s.lang, s.source) AS terms FROM s JOIN v ON s.lang = v.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = v.term),
p AS (SELECT lang, source, term, n, 1 + {source_audit.BILLION}::HUGEINT * (n + 1) // (total + terms) AS p FROM g),
w AS (SELECT lang, term, 1 + {source_audit.BILLION}::HUGEINT * (sum(n) + 1) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM g GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN w USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= {source_audit.TOP}"""

SPELLING_SQL = f"""
WITH RECURSIVE t AS (
  SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {spelling_forms.CRC_POLYNOMIAL}) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
o AS (SELECT doc_id, run, count(*) AS m FROM (
        SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
      WHERE length(run) >= {spelling_forms.MIN_LETTERS} GROUP BY ALL),
k AS (SELECT row_number() OVER () AS id, doc_id, run, m, hex(encode(doc_id || ':' || run)) AS h FROM o),
r AS (SELECT id, h, 0 AS pos, 4294967295 AS c FROM k
      UNION ALL SELECT id, h, pos + 1, xor(c >> 8, v) FROM r JOIN t ON t.i = xor(c & 255, ('0x' || substring(h, 2 * pos + 1, 2))::BIGINT) WHERE 2 * pos < length(h)),
c AS (SELECT id, xor(c, 4294967295) AS c FROM r WHERE 2 * pos = length(h)),
w AS (SELECT CASE WHEN c % {spelling_forms.DELETED} = 0 THEN substring(run, 1, c % length(run)) || substring(run, c % length(run) + 2) ELSE run END AS word, m FROM k JOIN c USING (id)),
v AS (SELECT word, sum(m)::BIGINT AS n FROM w WHERE length(word) >= {spelling_forms.MIN_LETTERS} GROUP BY word HAVING sum(m) >= {spelling_forms.MIN_COUNT}),
d AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS left_over FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.left_over = b.left_over AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.left_over = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.left_over = v.word),
f AS (SELECT v.word, v.n, count(near) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM v LEFT JOIN e ON v.word = e.word GROUP BY v.word, v.n),
g AS (SELECT word, n, n_near, CASE WHEN near_n >= {spelling_forms.TIMES} * n THEN near END AS form, CASE WHEN near_n >= {spelling_forms.TIMES} * n THEN near_n END AS form_n FROM f),
z AS (SELECT word, word AS far FROM g UNION ALL SELECT z.word, g.form FROM z JOIN g ON z.far = g.word WHERE g.form IS NOT NULL)
SELECT g.word, g.form, z.far AS root, g.n, g.n_near, g.form_n FROM g JOIN z ON g.word = z.word JOIN g last ON z.far = last.word AND last.form IS NULL"""

ORACLE = {
    "op11_spelling_forms": SPELLING_SQL,
    "op13_source_audit": SOURCE_AUDIT_SQL,
    "op2_suffix_array_dedup": BYTE_DEDUP_SQL,
    "op4_ngram_jaccard_join": JACCARD_SQL,
    "op7_substring_dedup": WORD_DEDUP_SQL,
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op5_quality_rules": QUALITY_SQL,
}
