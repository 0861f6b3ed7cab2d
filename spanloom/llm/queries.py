"""The queries of this subpackage, each over its whole tables, and the SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import chat, decontam, fim, langid, license, packing, pii, quality, repair, simhash, suffix_dedup, topk, toxicity
from spanloom.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.op1(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op3(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.op5(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op8(table(spark, sf_dir, "documents"))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op9(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op10(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op11(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.op12(table(spark, sf_dir, "documents"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op13(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quality_rules, op3_chat_format, op4_toxicity, op5_packing, op6_decontamination, op7_simhash, op8_pii, op9_language_mixture, op10_suffix_dedup,
        op11_conversation_repair, op12_fill_in_middle, op13_exact_top_k,
    )
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_license_scan"] = license.oracle_sql()
ORACLE_SQL["op11_conversation_repair"] = repair.oracle_sql()
ORACLE_SQL["op12_fill_in_middle"] = fim.ORACLE_SQL
ORACLE_SQL["op13_exact_top_k"] = topk.ORACLE_SQL

ORACLE_SQL["op3_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(role, '') AS r, text AS raw, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', 'user', '\### Assistant: </turn> ok', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', 'assistant', '\### Assistant: </turn> ok', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(t, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ')) + 15
    + length(replace(replace(replace(replace(replace(r, '%', '%25'), ':', '%3A'), '<', '%3C'), '#', '%23'), chr(10), '%0A')) - 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, raw NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, raw NULLS FIRST) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE_SQL["op2_quality_rules"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
p AS (SELECT r, count(*) AS n_repeat FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM g WHERE c > 1) GROUP BY r),
f AS (
  SELECT t.r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals
  FROM t LEFT JOIN p USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS (
  SELECT r, doc_id, stratum, rule, value FROM (
    SELECT r, doc_id, stratum,
      unnest([{'rule': 'symbols', 'value': CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END},
        {'rule': 'dup_lines', 'value': CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END},
        {'rule': 'repeats', 'value': CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END},
        {'rule': 'capitals', 'value': CASE WHEN word_chars > 0 THEN 1000 * n_capitals // word_chars ELSE 0 END}], recursive := true)
    FROM m WHERE NOT base_failed)),
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lv AS (SELECT stratum, rule, value, quality FROM v JOIN q USING (doc_id)),
n AS (SELECT stratum, rule, count(*) FILTER (quality >= 1) AS n FROM lv GROUP BY ALL),
grid AS (
  SELECT 'symbols' AS rule, unnest(range(500, 19, -20)) AS cutoff UNION ALL SELECT 'dup_lines', unnest(range(950, 49, -50))
  UNION ALL SELECT 'repeats', unnest(range(500, 49, -50)) UNION ALL SELECT 'capitals', unnest(range(950, 49, -50))),
tried AS (
  SELECT n.stratum, n.rule, cutoff, n, count(lv.value) FILTER (quality >= 1) AS good, count(lv.value) FILTER (quality < 1) AS bad
  FROM n JOIN grid ON n.rule = grid.rule LEFT JOIN lv ON lv.stratum = n.stratum AND lv.rule = n.rule AND lv.value > cutoff GROUP BY ALL),
pv AS (
  SELECT *, CASE WHEN good >= n * 0.01 THEN 1.0 ELSE list_sum(list_transform(range(0, good + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(CAST(0.01 AS DOUBLE)) + (n - j) * ln(CAST(0.99 AS DOUBLE))))) END AS p FROM tried),
so AS (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS worst FROM pv),
best AS (
  SELECT stratum, rule, arg_max(cutoff, 10000 * (bad - 3 * good) + cutoff) AS cutoff
  FROM so WHERE worst <= CAST(0.05 AS DOUBLE) / (SELECT count(*) FROM n) GROUP BY ALL),
bad AS (SELECT DISTINCT r FROM v JOIN best ON v.stratum = best.stratum AND v.rule = best.rule AND value > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept
FROM m LEFT JOIN bad ON m.r = bad.r
"""

ORACLE_SQL["op6_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents),
i AS (
  SELECT item_id IS NULL AS none, coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT none, item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT none, item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT r, k, dw.n, none, item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, none, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN f USING (r)
"""
