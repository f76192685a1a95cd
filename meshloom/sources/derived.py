"""Logical tables that the snapshot doesn't hold, derived from those it does."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash16, normalize_query
from .tables import read


def click_events(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks of the event stream on the page whose id is the user's number: ``ts, query_hash, url``."""
    clicks = read(spark, folder, "events").where(F.col("event_type") == "click")
    pages = read(spark, folder, "pages").select(F.col("id").alias("user_id"), "url")
    return clicks.join(pages, "user_id").select("ts", hash16(F.col("props")).alias("query_hash"), "url")


def clicks(events: DataFrame) -> DataFrame:
    """``url, clicks, last_clicked``: click events folded by url."""
    return events.groupBy("url").agg(F.count(F.lit(1)).alias("clicks"), F.max("ts").alias("last_clicked"))


def searches(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of documents as the queries that were asked, each with a number of results: ``id, ts, q, results, suggested, shown_urls``."""
    docs = read(spark, folder, "documents").where(F.col("title").isNotNull())
    asked = docs.select(F.col("doc_id").alias("id"), F.col("fetched_at").alias("ts"), normalize_query(F.col("title")).alias("q"), F.pmod("doc_id", F.lit(4)).cast("int").alias("results"))
    return asked.where("q <> ''").select("id", "ts", "q", "results", (F.col("results") < 3).alias("suggested"), F.array(F.col("q")).alias("shown_urls"))


def latest_pages(pages: DataFrame) -> DataFrame:
    """One row a url: the latest fetch, the largest id where two share the time.

    Which rows are older is worked out on three narrow columns; the wide ones are read once, pruned to
    what the caller uses, and meet only the ids of the older rows.
    """
    narrow = pages.where(F.col("url").isNotNull()).select("url", F.struct("fetched_at", "id").alias("at"))
    newest = narrow.groupBy("url").agg(F.max("at").alias("newest"))
    older = narrow.join(newest, "url").where(F.col("at") != F.col("newest")).select(F.col("at.id").alias("id"))
    return pages.where(F.col("url").isNotNull()).join(older, "id", "left_anti")


def crawl_queue(spark: SparkSession, folder: str, as_of: datetime) -> DataFrame:
    """Targets of links to pages never fetched, as they'd wait in the queue: ``url, node_hash, path, enqueued_at, attempts, next_attempt, priority``."""
    links = read(spark, folder, "links").where(F.col("to_url").rlike("^[0-9a-f]{16,64}:/page/"))
    known = read(spark, folder, "pages").select("url").distinct()
    target = links.groupBy("to_url").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("to_url", "url").join(known, "url", "left_anti")
    now = F.lit(as_of).cast("timestamp")
    attempts = F.least(F.col("n") - 1, F.lit(4)).cast("int")
    return target.select(
        "url", F.substring_index("url", ":", 1).alias("node_hash"), F.regexp_extract("url", "^[^:]*:(.*)$", 1).alias("path"), (now - F.expr("INTERVAL 2 HOURS")).alias("enqueued_at"),
        attempts.alias("attempts"), (now + F.make_interval(hours=attempts - 1)).alias("next_attempt"), F.when(F.endswith("url", F.lit("/page/index.mu")), 3).otherwise(6).alias("priority"),
    )


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as fetched markup: ``url, node_hash, path, raw, fetched_at``."""
    docs = read(spark, folder, "documents")
    node = hash16(F.col("source"))
    path = F.concat(F.lit("/page/"), F.col("doc_id"), F.lit(".mu"))
    return docs.select(F.concat(node, F.lit(":"), path).alias("url"), node.alias("node_hash"), path.alias("path"), F.col("text").alias("raw"), "fetched_at", "doc_id")
