"""Queries of the general data-processing problems, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.references import orphan_references, orphan_report
from ..operators.sessions import sessions
from ..sources.tables import read


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(read(spark, folder, "links"), read(spark, folder, "pages"), read(spark, folder, "nodes"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(read(spark, folder, "links"), read(spark, folder, "pages"), read(spark, folder, "nodes"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(read(spark, folder, "page_events"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found}

_REFERENCES = r"""
WITH periods AS (
  SELECT url, strftime(max(fetched_at) AT TIME ZONE 'UTC', '%Y-%m') AS last_month,
         strftime(min(CASE WHEN ok THEN coalesce(first_seen, fetched_at) END) AT TIME ZONE 'UTC', '%Y-%m') AS born
  FROM pages WHERE url IS NOT NULL GROUP BY url
), bare AS (
  SELECT DISTINCT from_url, to_url, regexp_replace(split_part(regexp_replace(to_url, '^\s+|\s+$', '', 'g'), '#', 1), '\s+$', '') AS u,
         nullif(lower(regexp_replace(to_node_hash, '^\s+|\s+$', '', 'g')), '') AS h
  FROM links
), refs AS (
  SELECT DISTINCT 'to_url' AS ref_field, last_month AS month_key, from_url, to_url,
         CASE WHEN strpos(u, ':') > 0 THEN lower(split_part(u, ':', 1)) || substr(u, strpos(u, ':')) ELSE u END AS k
  FROM bare LEFT JOIN periods ON from_url = url WHERE u <> ''
  UNION ALL
  SELECT DISTINCT 'to_node_hash', last_month, from_url, to_url, h FROM bare LEFT JOIN periods ON from_url = url WHERE h IS NOT NULL
), parents AS (
  SELECT 'to_url' AS ref_field, url AS k, born FROM periods WHERE born IS NOT NULL
  UNION ALL
  SELECT 'to_node_hash', lower(trim(dest_hash)), min(strftime(first_seen AT TIME ZONE 'UTC', '%Y-%m')) FROM nodes WHERE first_seen IS NOT NULL GROUP BY 2
), bad AS (
  SELECT r.* FROM refs r LEFT JOIN parents p ON r.ref_field = p.ref_field AND r.k = p.k
  WHERE p.born IS NULL OR r.month_key < p.born
)
"""

ORACLE = {
    "p3_found": _REFERENCES + "SELECT DISTINCT ref_field, month_key, from_url, to_url FROM bad",
    "p3_report": _REFERENCES + "SELECT ref_field, month_key, count(DISTINCT k) AS n_keys, count(*) AS n_refs FROM bad GROUP BY 1, 2",
    "p4_found": """
WITH views AS (
  SELECT DISTINCT vid, epoch_us(ts) AS at_us, node, path FROM page_events WHERE vid IS NOT NULL AND trim(vid) <> '' AND ts IS NOT NULL
), flagged AS (
  SELECT vid, at_us, CASE WHEN at_us - lag(at_us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS opens FROM views WINDOW w AS (PARTITION BY vid ORDER BY at_us)
), numbered AS (
  SELECT vid, at_us, sum(opens) OVER (PARTITION BY vid ORDER BY at_us RANGE UNBOUNDED PRECEDING) AS session FROM flagged
)
SELECT vid, min(at_us) // 1000 AS start_ms, max(at_us) // 1000 AS end_ms, count(*) AS n_events FROM numbered GROUP BY vid, session
""",
}
