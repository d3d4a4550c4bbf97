"""The queries op1_ to op10_ over the tables of a folder, with production parameters, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import decontamination
from .fingerprints import fingerprints
from .html_extraction import html_extraction
from .language_id import fit, held_out, language_id
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .packing import packed_documents
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .url_filters import ListRule, url_filters

URL_RULES = [ListRule("net", "/", "block"), ListRule("example.net", "/en/", "allow"), ListRule("example.com", "/de/", "block"), ListRule("org", "/fr/", "allow")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id")))
    return language_id(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "mined_rule", "verdict")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_language_id, op3_substring_dedup, op4_line_dedup, op5_packing, op6_url_filters, op7_decontamination, op8_fingerprints, op9_html_extraction, op10_near_dedup)
}

OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
numbered AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM lines),
solid AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS t FROM numbered
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
windows AS (
  SELECT doc_id, pos AS first, lead(pos, 2) OVER w AS last, t AS t1, lead(t) OVER w AS t2, lead(t, 2) OVER w AS t3
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, first, last FROM windows WHERE last IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, first) > 1),
cut AS (
  SELECT DISTINCT n.doc_id, n.pos FROM numbered n JOIN later w ON n.doc_id = w.doc_id AND n.pos BETWEEN w.first AND w.last),
rebuilt AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (c.pos IS NULL) AS text, count(*) AS n_lines, count(c.pos) AS n_removed
  FROM numbered n LEFT JOIN cut c ON n.doc_id = c.doc_id AND n.pos = c.pos GROUP BY n.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
       CAST(coalesce(r.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
items AS (
  SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM items),
sizes AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
found AS (
  SELECT p.doc_id, p.i, p.k, x.item_id FROM places p JOIN windows x ON p.k = x.k AND array_to_string(p.w[p.i : p.i + p.k - 1], ' ') = x.g),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op7_decontamination": OP7_SQL}
