"""References between tables whose target is missing, gone or came later.

Parents and children are brought into one long form ``(field, key, ...)`` and grouped by field and
key, so a reference and its target meet in one hash aggregation instead of a join per field. Children
enter that group as one partial count per key and period, never as rows, so a key that a third of all
rows refer to costs one row per period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that may stand around a written reference.
_OUTER = r"^[\s ]+|[\s ]+$"


def month_key(ts: Column) -> Column:
    """``YYYY-MM`` of a timestamp, in the session's time zone (UTC)."""
    return F.date_format(ts, "yyyy-MM")


def target_url(to_url: Column) -> Column:
    """The url a link means: without outer white space and fragment, its hash in lower case. Null stays null, blank gives null."""
    bare = F.regexp_replace(F.substring_index(F.regexp_replace(to_url, _OUTER, ""), "#", 1), _OUTER, "")
    # regexp_extract keeps what follows the hash as it is; a url without a colon has no hash
    host = F.regexp_extract(bare, r"^([^:]*):", 1)
    return F.nullif(F.concat(F.lower(host), F.substr(bare, F.length(host) + 1)), F.lit(""))


def target_node(to_node_hash: Column) -> Column:
    """The node a link means: without outer white space, in lower case. Null and blank give null."""
    return F.nullif(F.lower(F.regexp_replace(to_node_hash, _OUTER, "")), F.lit(""))


def page_periods(pages: DataFrame) -> DataFrame:
    """Per url: ``last_month`` (of the latest fetch, whatever its outcome) and ``born_month`` (first seen among good rows)."""
    seen = F.coalesce("first_seen", "fetched_at")
    return pages.where(F.col("url").isNotNull()).groupBy("url").agg(
        month_key(F.max("fetched_at")).alias("last_month"), month_key(F.min(F.when(F.col("ok"), seen))).alias("born_month")
    )


def references(links: DataFrame, periods: DataFrame) -> DataFrame:
    """Long form of the distinct links: ``ref_field, key, month_key, from_url, to_url``, one row per field that refers to something."""
    written = links.select("from_url", "to_url", "to_node_hash").distinct()
    dated = written.join(periods.select(F.col("url").alias("from_url"), F.col("last_month").alias("month_key")), "from_url", "left")
    fields = F.array(
        F.struct(F.lit("to_url").alias("ref_field"), target_url(F.col("to_url")).alias("key")),
        F.struct(F.lit("to_node_hash").alias("ref_field"), target_node(F.col("to_node_hash")).alias("key")),
    )
    long = dated.select("from_url", "to_url", "month_key", F.inline(fields))
    return long.where(F.col("key").isNotNull()).select("ref_field", "key", "month_key", "from_url", "to_url").distinct()


def orphan_keys(refs: DataFrame, periods: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ref_field, key, month_key, n_refs`` of the keys without a parent in that month or before.

    A reference without a month (its page isn't known) is an orphan only if its target never existed.
    """
    child = refs.groupBy("ref_field", "key", "month_key").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None)
    parents = periods.where(F.col("born_month").isNotNull()).select(F.lit("to_url").alias("ref_field"), F.col("url").alias("key"), F.col("born_month").alias("born"))
    node_rows = nodes.select(F.lit("to_node_hash").alias("ref_field"), target_node(F.col("dest_hash")).alias("key"), month_key(F.col("first_seen")).alias("born"))
    parents = parents.unionByName(node_rows.where(F.col("key").isNotNull() & F.col("born").isNotNull()))
    tagged = child.select("ref_field", "key", F.struct(F.col("month_key").alias("month"), F.col("n")).alias("child"), none.cast("string").alias("born")).unionByName(
        parents.select("ref_field", "key", none.cast("struct<month:string,n:bigint>").alias("child"), "born")
    )
    grouped = tagged.groupBy("ref_field", "key").agg(F.min("born").alias("born"), F.collect_list("child").alias("children"))
    lone = grouped.where(F.size("children") > 0).select("ref_field", "key", "born", F.inline("children"))
    gone = F.col("born").isNull() | F.coalesce(F.col("month") < F.col("born"), F.lit(False))
    return lone.where(gone).select("ref_field", "key", F.col("month").alias("month_key"), F.col("n").alias("n_refs"))


def orphan_references(links: DataFrame, pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ref_field, month_key, from_url, to_url`` of every distinct reference whose target is missing.

    ``ref_field`` is ``to_url`` or ``to_node_hash``; ``month_key`` is the month of the latest fetch of
    the referring page. A target counts as present if it was first seen (``first_seen``, or else
    ``fetched_at``) in that month or before; failed fetches don't make a page present. Null or blank
    references are none. Repeated links count once. Empty inputs give an empty result; more columns in
    the inputs are ignored. A referring page without any row has a null ``month_key`` and is reported
    if its target never existed.
    """
    periods = page_periods(pages)
    refs = references(links, periods)
    bad = orphan_keys(refs, periods, nodes)
    same = refs["ref_field"].eqNullSafe(bad["ref_field"]) & (refs["key"] == bad["key"]) & F.coalesce(refs["month_key"], F.lit("")).eqNullSafe(F.coalesce(bad["month_key"], F.lit("")))
    return refs.join(bad, same, "left_semi").select("ref_field", "month_key", "from_url", "to_url").distinct()


def orphan_report(links: DataFrame, pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ref_field, month_key, n_keys, n_refs``: missing keys and the distinct references to them, by field and month."""
    periods = page_periods(pages)
    bad = orphan_keys(references(links, periods), periods, nodes)
    return bad.groupBy("ref_field", "month_key").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs"))
