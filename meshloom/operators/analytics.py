"""Counts and rollups of the registry, of traffic, of clicks and of searches.

Every "last N" is a comparison with ``as_of``, never with the clock. Top lists end with their keys as tie-breaks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at(as_of: datetime) -> Column:
    return F.lit(as_of).cast("timestamp")


def since(as_of: datetime, interval: str) -> Column:
    return at(as_of) - F.expr(f"INTERVAL {interval}")


def stats(nodes: DataFrame, pages: DataFrame, links: DataFrame, queue: DataFrame, as_of: datetime) -> DataFrame:
    """One row of nine counts. Each table is read once; its counts are a row of their own columns, and the rows are folded into one."""
    day = since(as_of, "24 HOURS")
    n = nodes.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if("reachable").alias("reachable"),
        F.count_if(~F.coalesce("reachable", F.lit(True))).alias("unreachable"),  # null was never tried
    )
    p = pages.agg(F.count_if("ok").alias("pages"), F.count_if("md_declared").alias("md_declared"), F.count_if(F.col("fetched_at") > day).alias("fetched_24h"))
    k = links.agg(F.count(F.lit(1)).alias("links"))
    q = queue.agg(F.count_if(F.col("next_attempt") <= at(as_of)).alias("queue_due"), F.count(F.lit(1)).alias("queue_total"))
    rows = n
    for one in (p, k, q):
        rows = rows.unionByName(one, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def categories(pages: DataFrame) -> DataFrame:
    """``type, n`` of the good pages, the most frequent first."""
    return pages.where("ok").groupBy(F.coalesce("type", F.lit("(none)")).alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def recent_pages(pages: DataFrame, limit: int = 25) -> DataFrame:
    shown = pages.where("ok").select("url", F.coalesce("title", F.lit("(untitled)")).alias("title"), F.coalesce("type", F.lit("?")).alias("type"), "node_hash", "fetched_at", "id")
    return shown.orderBy(F.desc("fetched_at"), "id").limit(limit)


def top_nodes(nodes: DataFrame, limit: int = 15) -> DataFrame:
    shown = nodes.select("dest_hash", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("announce_count", F.lit(0)).alias("announce_count"), "last_seen")
    return shown.orderBy(F.desc("announce_count"), F.desc_nulls_last("last_seen"), "dest_hash").limit(limit)


def rum_stats(events: DataFrame, as_of: datetime) -> DataFrame:
    """Views, distinct visitors, and views of the last day."""
    return events.agg(F.count(F.lit(1)).alias("views"), F.count_distinct("vid").alias("visitors"), F.count_if(F.col("ts") > since(as_of, "24 HOURS")).alias("views_24h"))


def views_by(events: DataFrame, keys: list[str]) -> DataFrame:
    """Views and distinct visitors by key. Counting distinct visitors in two steps keeps a key with many views from one task."""
    pairs = events.groupBy(*keys, "vid").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(*keys).agg(F.sum("n").alias("views"), F.count("vid").alias("visitors"))


def rum_by_node(events: DataFrame, limit: int = 20) -> DataFrame:
    return views_by(events, ["node"]).orderBy(F.desc("views"), "node").limit(limit)


def rum_top_pages(events: DataFrame, limit: int = 20) -> DataFrame:
    return views_by(events, ["node", "path"]).orderBy(F.desc("views"), "node", "path").limit(limit)


def rum_by_day(events: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """Views and visitors by UTC day, oldest first; the span is N times 24 hours, so its first day is a part of one."""
    recent = events.where(F.col("ts") > since(as_of, f"{days} DAYS")).withColumn("day", F.to_date("ts"))
    return views_by(recent, ["day"]).orderBy("day")


def embedding_backlog(pages: DataFrame) -> DataFrame:
    good = pages.where("ok")
    return good.agg(F.count_if(F.col("embedding").isNull()).alias("missing"), F.count("embedding").alias("present"))


def pages_needing_embedding(pages: DataFrame, limit: int = 20) -> DataFrame:
    return pages.where(F.col("ok") & F.col("embedding").isNull()).select("id", "url", "title").orderBy("id").limit(limit)


def click_event_stats(clicks: DataFrame, as_of: datetime) -> DataFrame:
    return clicks.agg(F.count(F.lit(1)).alias("clicks"), F.count_if(F.col("ts") > since(as_of, "24 HOURS")).alias("clicks_24h"), F.count_distinct("url").alias("urls"))


def top_clicked(clicks: DataFrame, limit: int = 15) -> DataFrame:
    return clicks.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).orderBy(F.desc("n"), F.desc("last"), "url").limit(limit)


def search_stats(searches: DataFrame, as_of: datetime) -> DataFrame:
    return searches.agg(F.count(F.lit(1)).alias("searches"), F.count_if(F.col("ts") > since(as_of, "24 HOURS")).alias("searches_24h"), F.count_if(F.col("results") == 0).alias("zero_results"))


def top_searches(searches: DataFrame, limit: int = 15) -> DataFrame:
    by = searches.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("results").alias("results"), F.max("ts").alias("last"))
    return by.orderBy(F.desc("n"), F.desc("last"), "q").limit(limit).select("q", "n", "results")


def zero_result_searches(searches: DataFrame, limit: int = 15) -> DataFrame:
    by = searches.where(F.col("results") == 0).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return by.orderBy(F.desc("n"), F.desc("last"), "q").limit(limit).select("q", "n")


def scaled(rows: DataFrame, value: str, width: int, least: int = 1) -> DataFrame:
    """Adds ``px``: the value's share of the largest, as whole pixels of ``width``, at least ``least``."""
    top = rows.agg(F.max(value)).scalar()
    px = F.greatest(F.floor(F.col(value) * F.lit(width) / F.nullif(top, F.lit(0))).cast("int"), F.lit(least))
    return rows.withColumn("px", F.coalesce(px, F.lit(least)))


def dashboard(events: DataFrame, clicks: DataFrame, searches: DataFrame, as_of: datetime) -> dict[str, DataFrame]:
    """Every panel of the analytics page as a lazy result."""
    return {
        "rum_stats": rum_stats(events, as_of),
        "rum_by_node": scaled(rum_by_node(events), "views", 120, 3),
        "rum_top_pages": rum_top_pages(events),
        "rum_by_day": scaled(rum_by_day(events, as_of), "views", 220),
        "click_stats": click_event_stats(clicks, as_of),
        "top_clicked": top_clicked(clicks),
        "search_stats": search_stats(searches, as_of),
        "top_searches": top_searches(searches),
        "zero_results": zero_result_searches(searches),
    }
