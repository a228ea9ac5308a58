"""Registered queries of the subpackage: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegate.llm.common import table
from tidegate.llm import bpe, decontamination, html_extraction, infilling, language_id, line_dedup, near_dedup
from tidegate.llm import quality_classifier, quality_rules, resampling, sharding, substring_dedup, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


WORDS_SQL = r"""
words AS (SELECT doc_id, ws, len(ws) AS n FROM (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents))"""

OP3_SQL = f"""WITH {WORDS_SQL},
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM words, unnest(range(1, n - 48)) AS t(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, j FROM windows JOIN firsts USING (s), unnest(range(i, i + 50)) AS t(j) WHERE first < doc_id),
each AS (SELECT doc_id, j, ws[j] AS word FROM words, unnest(range(1, n + 1)) AS t(j)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS text
         FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, n AS n_words, n - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""

OP8_SQL = f"""WITH RECURSIVE {WORDS_SQL},
shingles AS (SELECT doc_id, s, count(*) AS c FROM (
  SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, CASE WHEN n >= 5 THEN n - 3 WHEN n > 0 THEN 2 ELSE 1 END)) AS t(i)) GROUP BY ALL),
sizes AS (SELECT doc_id, sum(c) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o
             FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * o >= 4 * (x.n + y.n)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents
                        UNION SELECT ends.b, reach.root FROM reach JOIN ends ON ends.a = reach.doc_id)
SELECT doc_id, min(root) AS class_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

OP12_SQL = r"""WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line,
                 translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM texts, unnest(range(1, len(ls) + 1)) AS t(i)),
common AS (SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, coalesce(doc_id < top, false) AS gone FROM lines LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP13_SQL = r"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
lines AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u FROM texts),
draws AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                 CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM lines),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                     THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""


@query("op1_html_extraction")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extraction.extracted(table(spark, sf_dir, "pages"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and verdict of every document."""
    return quality_classifier.classified(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that stay when 50-word windows of documents with smaller ids are taken out."""
    return substring_dedup.removal(table(spark, sf_dir, "documents"), 50)


@query("op4_quality_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the line labelling."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_token_ids")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as the written store holds them."""
    return token_store.stored(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in eight shuffled shards, as read back from them."""
    return sharding.digest(table(spark, sf_dir, "documents"), 8)


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the score of the alignment."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_near_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again."""
    return bpe.digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return language_id.predicted(table(spark, sf_dir, "documents"))


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the distribution of the benchmark's texts."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_line_dedup", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that stay when lines of many documents are kept in the last of them alone."""
    return line_dedup.digests(table(spark, sf_dir, "documents"))


@query("op13_infilling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document and the text rebuilt from it."""
    return infilling.digests(table(spark, sf_dir, "documents"))
