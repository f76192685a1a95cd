"""Changes of state as new snapshots: what an upsert, a delete or a lease leaves, computed from the old snapshot and a batch.

A batch may name a key many times; it is first folded to one row a key by the order of its events, as if
they had been applied one by one. Applying the same fold twice is the caller's concern where counts grow.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analytics import at, since


def upsert_nodes(nodes: DataFrame, announces: DataFrame) -> DataFrame:
    """Registry after announces ``dest_hash, name, ts``: the last name that isn't null, at most 200 characters of it, last seen, and counts. New nodes were never crawled."""
    named = F.when(F.col("name").isNotNull(), F.struct("ts", "name"))
    batch = announces.where(F.col("dest_hash").isNotNull()).groupBy("dest_hash").agg(
        F.max(named)["name"].alias("b_name"), F.min("ts").alias("b_first"), F.max("ts").alias("b_last"), F.count(F.lit(1)).alias("b_n")
    )
    both = nodes.join(batch, "dest_hash", "full_outer")
    return both.select(
        "dest_hash", F.coalesce(F.left("b_name", F.lit(200)), "name").alias("name"), F.coalesce("first_seen", "b_first").alias("first_seen"),
        F.coalesce("b_last", "last_seen").alias("last_seen"), (F.coalesce("announce_count", F.lit(0)) + F.coalesce("b_n", F.lit(0))).cast("int").alias("announce_count"),
        "last_crawled", "reachable",
    )


def enqueue(queue: DataFrame, batch: DataFrame, pages: DataFrame, as_of: datetime, fresh_hours: int | None = None) -> DataFrame:
    """The rows that a batch ``node_hash, path, priority`` adds: neither queued yet nor, with ``fresh_hours``, fetched well since then."""
    now = at(as_of)
    new = batch.withColumn("url", F.concat_ws(":", "node_hash", "path")).groupBy("url").agg(F.min_by(F.struct("node_hash", "path", "priority"), F.coalesce("priority", F.lit(5))).alias("x"))
    new = new.join(queue.select("url"), "url", "left_anti")
    if fresh_hours:
        fresh = pages.where(F.col("ok") & (F.col("fetched_at") > since(as_of, f"{fresh_hours} HOURS"))).select("url").distinct()
        new = new.join(fresh, "url", "left_anti")
    return new.select("url", "x.node_hash", "x.path", now.alias("enqueued_at"), F.lit(0).alias("attempts"), now.alias("next_attempt"), F.coalesce("x.priority", F.lit(5)).alias("priority"))


def upsert_clicks(clicks: DataFrame, events: DataFrame) -> DataFrame:
    """Counts after click events ``url, ts``."""
    batch = events.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    both = clicks.join(batch, "url", "full_outer")
    return both.select("url", (F.coalesce("clicks", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("clicks"), F.greatest("last_clicked", "last").alias("last_clicked"))


def record_pages(pages: DataFrame, batch: DataFrame, as_of: datetime) -> DataFrame:
    """Pages (one row a url) after a batch of fetches with the same columns.

    The new fetch wins, but an embedding is kept where the new one is null, ``first_seen`` stays, and
    ``last_changed`` moves only if the content's hash did. Node, path and anchors of a known page stay.
    """
    kept = ["node_hash", "path", "anchors", "first_seen", "id"]
    own = [c for c in pages.columns if c != "url"]
    old = pages.select("url", F.struct(*own).alias("o"))
    new = batch.groupBy("url").agg(F.max_by(F.struct(*own), "fetched_at").alias("n"))
    both = old.join(new, "url", "full_outer")
    changed = ~F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))

    def column(c: str):
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        fresh = F.col("o").isNull()
        if c in kept:
            value = F.when(fresh, F.coalesce(n, at(as_of)) if c == "first_seen" else n).otherwise(o)
        elif c == "embedding":
            value = F.coalesce(n, o)
        elif c == "last_changed":
            value = F.when(fresh | (F.col("n").isNotNull() & changed), at(as_of)).otherwise(o)
        else:
            value = F.when(F.col("n").isNotNull(), n).otherwise(o)
        return value.alias(c)

    return both.select("url", *[column(c) for c in own])


def record_links(links: DataFrame, batch: DataFrame) -> DataFrame:
    """Links (one row a pair of urls) after a batch: a label stays where the new one is null or empty, the target's node and path always; links are never dropped.

    Of several labels in one batch the greatest is taken, as rows of a snapshot have no order.
    """
    label = F.nullif("label", F.lit(""))
    both = links.select("from_url", "to_url", "to_node_hash", "to_path", label.alias("label"), F.lit(0).alias("order")).unionByName(
        batch.select("from_url", "to_url", "to_node_hash", "to_path", label.alias("label"), F.lit(1).alias("order"))
    )
    folded = both.groupBy("from_url", "to_url").agg(
        F.min_by(F.struct("to_node_hash", "to_path"), F.struct("order", "to_node_hash", "to_path")).alias("x"),
        F.max(F.when(F.col("label").isNotNull(), F.struct("order", "label")))["label"].alias("label"),
    )
    return folded.select("from_url", "to_url", "x.to_node_hash", "x.to_path", "label")


def refresh_anchors(pages: DataFrame, anchors: DataFrame) -> DataFrame:
    """``url, anchors, changed``: pages that links name get their labels, others keep what they had."""
    both = pages.select("url", F.col("anchors").alias("old")).join(anchors.select(F.col("to_url").alias("url"), F.col("anchors").alias("new")), "url", "left")
    return both.select("url", F.coalesce("new", "old").alias("anchors"), (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


def mark_crawled(nodes: DataFrame, crawled: DataFrame, as_of: datetime) -> DataFrame:
    """Nodes after attempts ``dest_hash, reachable``, also failed ones."""
    both = nodes.join(crawled.select("dest_hash", F.col("reachable").alias("now")), "dest_hash", "left")
    tried = F.col("now").isNotNull()
    others = [c for c in nodes.columns if c not in ("dest_hash", "last_crawled", "reachable")]
    return both.select("dest_hash", *others, F.when(tried, at(as_of)).otherwise(F.col("last_crawled")).alias("last_crawled"), F.coalesce("now", "reachable").alias("reachable"))


def enqueue_recrawl(nodes: DataFrame, queue: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """The index page of each node never crawled or not since then, unless queued."""
    stale = nodes.where(F.col("last_crawled").isNull() | (F.col("last_crawled") < since(as_of, f"{hours} HOURS")))
    index = stale.select(F.concat(F.lower("dest_hash"), F.lit(":/page/index.mu")).alias("url"), F.col("dest_hash").alias("node_hash"), F.lit("/page/index.mu").alias("path"), F.lit(7).alias("priority"))
    return index.join(queue.select("url"), "url", "left_anti")


def reschedule(queue: DataFrame, failed: DataFrame, as_of: datetime, max_attempts: int = 4) -> DataFrame:
    """The queue after failures ``url``: one attempt more and a later turn, or dropped after ``max_attempts``."""
    both = queue.join(failed.select("url").distinct().withColumn("failed", F.lit(True)), "url", "left")
    n, bad = F.coalesce("attempts", F.lit(0)), F.coalesce("failed", F.lit(False))
    live = both.where(~(bad & (n >= max_attempts)))
    later = at(as_of) + F.make_interval(secs=F.lit(3600) * (n + 1))
    return live.withColumns({"next_attempt": F.when(bad, later).otherwise(F.col("next_attempt")), "attempts": F.when(bad, n + 1).otherwise(n)}).drop("failed")


def drop_queue(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("url"), "url", "left_anti")


def claim_due(queue: DataFrame, as_of: datetime, limit: int = 1) -> DataFrame:
    """The due items next in turn; all of a batch are claimed at once, where workers would claim one each."""
    due = queue.where(F.col("next_attempt") <= at(as_of))
    return due.orderBy("priority", "next_attempt", "url").limit(limit)


def lease(queue: DataFrame, claimed: DataFrame, as_of: datetime, seconds: int = 75) -> DataFrame:
    """The queue with the claimed items out of turn until the lease ends."""
    both = queue.join(claimed.select("url").withColumn("held", F.lit(True)), "url", "left")
    until = at(as_of) + F.make_interval(secs=F.lit(seconds))
    return both.withColumn("next_attempt", F.when(F.col("held"), until).otherwise(F.col("next_attempt"))).drop("held")


def set_embeddings(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pages with the embeddings of ``id, embedding`` put in."""
    both = pages.join(vectors.select("id", F.col("embedding").alias("new")), "id", "left")
    return both.withColumn("embedding", F.coalesce("new", "embedding")).drop("new").select(*pages.columns)


def upsert_lexicon(lexicon: DataFrame, fresh: DataFrame) -> DataFrame:
    """Frequencies after a refresh; words that no longer occur stay."""
    both = lexicon.select("word", F.col("df").alias("old")).join(fresh.select("word", "df"), "word", "full_outer")
    return both.select("word", F.coalesce("df", "old").alias("df"))


def record_events(batch: DataFrame) -> DataFrame:
    """View events ``ts, node, path, vid``, and ``id`` where they have one, as stored: node and path cut, an empty visitor null; rows without node or path are dropped."""
    node, path = F.nullif("node", F.lit("")), F.nullif("path", F.lit(""))
    own = [c for c in ("id", "ts") if c in batch.columns]
    return batch.where(node.isNotNull() & path.isNotNull()).select(*own, F.left("node", F.lit(64)).alias("node"), F.left("path", F.lit(200)).alias("path"), F.nullif("vid", F.lit("")).alias("vid"))


def record_searches(batch: DataFrame, shown: int = 20) -> DataFrame:
    """Searches as logged: normalised, empty ones dropped, the first urls shown kept or null."""
    from ..functions.text import normalize_query

    q = normalize_query(F.col("q"))
    urls = F.slice("shown_urls", 1, shown)
    return batch.select("ts", q.alias("q"), F.col("results").cast("int").alias("results"), "suggested", F.when(F.size(urls) > 0, urls).alias("shown_urls")).where(F.col("q") != "")
