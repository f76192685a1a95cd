"""Streams: announces into the registry, views into rollups, and a token bucket for each link."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, EngineConfig
from ..functions.text import visitor_id
from ..operators import upserts
from ..operators.upserts import record_events, upsert_nodes
from ..sources import tables


def announces_to_registry(announces: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Folds each micro-batch of announces ``dest_hash, name, ts`` into a new version of the registry under ``folder``.

    A version is named by its batch, so a batch that is run again writes the same version from the one before it.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables.write_snapshot(upsert_nodes(_version(spark, folder, "nodes", number), batch), folder, "nodes", number)

    return announces.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def announces_to_queue(announces: DataFrame, folder: str, checkpoint: str, pages: DataFrame, config: EngineConfig = DEFAULT) -> StreamingQuery:
    """Queues the index page of each announced node of a stream ``dest_hash, ts``, those of seed nodes first, unless it is queued or was fetched well of late.

    Versions are named by their batches, as those of the registry. A batch is taken to be worked at the time of its last announce.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _version(spark, folder, "crawl_queue", number)
        last = batch.agg(F.max("ts")).first()[0]
        if last is not None:
            node = F.lower("dest_hash")
            first = F.when(node.isin(*sorted(config.seed_nodes)), 1).otherwise(3) if config.seed_nodes else F.lit(3)
            wanted = batch.where("dest_hash IS NOT NULL").select(node.alias("node_hash"), F.lit("/page/index.mu").alias("path"), first.alias("priority"))
            old = old.unionByName(upserts.enqueue(old, wanted, pages, last, config.recrawl_hours))
        tables.write_snapshot(old, folder, "crawl_queue", number)

    return announces.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def leases(requests: DataFrame, folder: str, checkpoint: str, config: EngineConfig = DEFAULT) -> StreamingQuery:
    """Gives each request ``worker, ts`` of a stream an item of the queue that is due, as long as there are any: the claims ``worker, url,
    node_hash, path, attempts`` and the queue without them until their lease ends are written as versions under ``folder``.

    The queue's first version is the one before the first batch (``v=0``), so batch n reads version n and writes version n + 1; a batch
    run again gives the same claims. All requests of a batch are answered at the time of the last one.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        queue = spark.read.schema(tables.CRAWL_QUEUE).parquet(f"{folder}/crawl_queue/v={number:012d}")
        asking = batch.agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).first()
        claims = spark.createDataFrame([], "worker string, url string, node_hash string, path string, attempts int")
        if asking["n"]:
            due = upserts.claim_due(queue, asking["last"], asking["n"])
            # requests and items are at most one row a worker, and meet by their place in line
            line = lambda df, *by: df.withColumn("place", F.row_number().over(Window.orderBy(*by)))
            claims = line(batch, "ts", "worker").join(line(due, "priority", "next_attempt", "url"), "place").select("worker", "url", "node_hash", "path", "attempts")
            queue = upserts.lease(queue, due, asking["last"], config.lease_seconds)
        tables.write_snapshot(claims, folder, "claims", number)
        tables.write_snapshot(queue, folder, "crawl_queue", number + 1)

    return requests.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _version(spark: SparkSession, folder: str, table: str, number: int) -> DataFrame:
    """The version that the batch before wrote, empty before the first."""
    schema = tables.SCHEMAS[table]
    return spark.createDataFrame([], schema) if number == 0 else spark.read.schema(schema).parquet(f"{folder}/{table}/v={number - 1:012d}")


def ingest_views(bodies: DataFrame) -> DataFrame:
    """Request bodies ``ts, body`` as view rows; the visitor's id is hashed at once. Malformed bodies and those without node or path are dropped."""
    seen = bodies.select("ts", F.from_json("body", "node string, path string, rid string, link string").alias("b"))
    rows = seen.select("ts", "b.node", "b.path", visitor_id(F.coalesce("b.rid", "b.link")).alias("vid"))
    return record_events(rows)


def views_by_day(views: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily views and approximate visitors of a stream of views. Days older than ``late`` against the newest view are closed."""
    day = F.window("ts", "1 day")
    counted = views.withWatermark("ts", late).groupBy(day.alias("w")).agg(F.count(F.lit(1)).alias("views"), F.approx_count_distinct("vid", 0.02).alias("visitors"))
    return counted.select(F.to_date("w.start").alias("day"), "views", "visitors")


def token_bucket(requests: DataFrame, rate: float = DEFAULT.rate_per_second, burst: float = DEFAULT.rate_burst, idle: int = DEFAULT.idle_seconds) -> DataFrame:
    """``link, ts, allowed`` of a stream of requests ``link, ts``: each takes a token of its link, which refills at ``rate`` up to ``burst``. Idle links are forgotten."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        for batch in batches:
            batch = batch.sort_values("ts")
            allowed = []
            for ts in batch["ts"]:
                now = ts.timestamp()
                tokens = min(burst, tokens + (max(0.0, now - last) * rate if last is not None else 0.0))
                last = now if last is None else max(last, now)
                allowed.append(tokens >= 1)
                tokens -= 1 if tokens >= 1 else 0
            yield pd.DataFrame({"link": key[0], "ts": batch["ts"].values, "allowed": allowed})
        state.update((float(tokens), float(last)))
        state.setTimeoutDuration(idle * 1000)

    return requests.groupBy("link").applyInPandasWithState(run, "link string, ts timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)
