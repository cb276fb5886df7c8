"""The queries op1 to op10, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import line_crf, toxicity
from .common import table
from .decontaminate import contamination
from .licenses import COPYRIGHT_LINE, LOWER, NOTICE_HINT, SPELLINGS, UPPER, known_licenses, license_scan
from .packing import pack
from .quality_rules import STOP_WORDS, quality_rules
from .secrets import scan_secrets
from .simhash import simhash_components
from .token_counts import token_counts
from .warc import warc_round_trip


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed_rule")


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g3 AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    strlen(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letter_bytes, strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS n_word_bytes,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
    len(list_distinct(list_filter(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda x: x IN ({_STOP_SQL})))) AS n_stop
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 6 * n_lines OR 10 * n_upper > 4 * n_letter_bytes OR 10 * n_letter_bytes < 6 * n_word_bytes
    OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines OR n_stop < 2) AS kept
FROM c
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    t = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '\\1', 'g')"
    t = f"' ' || trim(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, ' {a}', ' {b}')"
    return f"trim({t})"


_KNOWN_SQL = ", ".join(f"('{d}', '{k}')" for d, k in known_licenses().items())
OP3_SQL = f"""
WITH known(digest, license) AS (VALUES {_KNOWN_SQL}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOTICE_HINT}'))) AS line FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN known ON sha256({_canonical_sql("line")}) = digest GROUP BY doc_id),
h AS (SELECT doc_id, sha256({_canonical_sql("t")}) AS text_digest FROM d)
SELECT h.doc_id, text_digest, license, coalesce(notices, '') AS notices
FROM h LEFT JOIN known ON text_digest = digest LEFT JOIN n ON h.doc_id = n.doc_id
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.line_quality(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least_words=1)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(payload) AS n, max(page_id) OVER (PARTITION BY h) AS top,
    list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_licenses": op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_line_crf": op6_line_crf,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
}
ORACLES: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op3_licenses": OP3_SQL, "op9_warc": OP9_SQL}
