"""Queries of the corpus problems, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from ..sources import tables
from . import boilerplate, bpe, langid, leakage, pii, spam, vectors


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table, dealt out over all cores where it lies in fewer parts."""
    return spread(tables.read(spark, folder, table))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.repeated_lines(read(spark, folder, "pages")).distinct()


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.without_repeated_lines(read(spark, folder, "pages"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.similar_pairs(read(spark, folder, "pages"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(read(spark, folder, "pages"), read(spark, folder, "links")).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    return langid.wrong_or_mixed(pages, spam.spam_pages(pages, read(spark, folder, "links"))).distinct()


def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of every good page: ``id, start, stop, lang, confidence``."""
    pages = read(spark, folder, "pages")
    parts = langid.segments(langid.labelled_pages(pages), langid.fit(pages.where("ok")))
    return parts.selectExpr("id", "inline(parts)")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(read(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items")).distinct()


def _names(spark: SparkSession, folder: str) -> pii.Names:
    return pii.widen(pii.learn_names(read(spark, folder, "name_hints")), read(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.entities(read(spark, folder, "documents"), _names(spark, folder)).select("doc_id", "kind", "hit").distinct()


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with each item replaced by ``<kind:surrogate>``. The key of the surrogates is a parameter; this one is for tests."""
    return pii.redact(read(spark, folder, "documents"), _names(spark, folder), secret="meshloom")


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p5_found": p5_found, "p6_found": p6_found, "p6_segments": p6_segments, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_redacted": p9_redacted}

_LINES = r"""
WITH rows AS (
  SELECT id, coalesce(nullif(trim(node_hash), ''), split_part(url, ':', 1)) AS source, string_split(content, chr(10)) AS parts
  FROM pages WHERE content <> ''
), lines AS (
  SELECT id, source, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM rows
), keyed AS (
  SELECT id, source, line_no, regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\p{L}]', '', 'g') AS k FROM lines
), total AS (SELECT source, count(*) AS total FROM rows GROUP BY source),
often AS (
  SELECT source, k FROM (SELECT source, k, count(DISTINCT id) AS n FROM keyed WHERE k <> '' GROUP BY ALL) JOIN total USING (source)
  WHERE n >= 5 AND n >= 0.1 * total
), found AS (SELECT DISTINCT id, line_no FROM keyed JOIN often USING (source, k))
"""

ORACLE = {
    "p1_found": _LINES + "SELECT id, line_no FROM found",
    "p1_clean": _LINES
    + """
SELECT p.id, CASE WHEN p.content IS NULL OR p.content = '' THEN p.content ELSE coalesce(x.kept, '') END AS content
FROM pages p LEFT JOIN (
  SELECT l.id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS kept FROM lines l ANTI JOIN found f USING (id, line_no) GROUP BY l.id
) x ON p.id = x.id
""",
}
