"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, mixing, ngram_lm, packing, pii, quality_classifier, quality_rules, simhash, url_filter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


#: (verdict, host, path)
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


#: The session's secret, and what stands for it where none is set, as in tests.
KEY_SETTING, TEST_KEY = "spark.veridelta.pseudonym.key", "not a secret"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, TEST_KEY))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", F.col("mix_copy").cast("long").alias("mix_copy"), "text")


_OP3 = """
WITH p AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
u AS (SELECT page_id, r, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(v, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT r, v, rh || rp AS rule, row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
      FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON u.r = m.r AND k = 1
"""

_OP7 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri WHERE g IS NOT NULL) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY r),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        length(t) - length(replace(t, '!', '')) AS n_exclamations,
        len(list_filter(ws, lambda x: NOT regexp_matches(x, '[\p{L}\p{N}]'))) AS n_bare_marks,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_cut_lines
      FROM w LEFT JOIN cov ON w.r = cov.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_symbols * 2 > n_words OR n_dup_lines * 10 > n_lines * 6
            OR n_bare_marks * 10 > n_words * 3 OR n_exclamations * 10 > n_words * 3 OR n_cut_lines * 10 > n_lines * 3) AS kept
FROM m
"""

_OP10 = """
WITH m AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS mass FROM documents GROUP BY source),
r AS (SELECT source, sqrt(mass) / (SELECT sum(sqrt(mass)) FROM m) * (SELECT sum(mass) FROM m) / mass AS rate FROM m),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(generate_series(0, 1100)) AS k) WHERE k <= rate + 12 * sqrt(rate) + 30),
u AS (SELECT doc_id, source, lang, text, ('0x' || substring(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')), 1, 12))::BIGINT::DOUBLE
        / 281474976710656.0 AS u FROM documents),
n AS (SELECT doc_id, u.source, lang, text, (SELECT count(*) FROM p WHERE p.source IS NOT DISTINCT FROM u.source AND p.cdf <= u.u) AS n FROM u)
SELECT doc_id, source, lang, unnest(generate_series(1, n)) AS mix_copy, text FROM n WHERE n > 0
"""


QUERIES = (
    op1_simhash,
    op2_ngram_lm,
    op3_url_filter,
    op4_html_text,
    op5_best_fit_packing,
    op6_quality_crf,
    op7_exact_dedup,
    op8_pii,
    op9_quality_rules,
    op10_source_mixing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _OP3, "op7_exact_dedup": _OP7, "op9_quality_rules": _OP9, "op10_source_mixing": _OP10}
