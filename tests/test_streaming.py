"""Streams against their batch twins."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from meshloom.operators import analytics, upserts
from meshloom.config import EngineConfig
from meshloom.sources import tables
from meshloom.streaming import jobs

UTC = timezone.utc


def test_views_by_day_equals_the_batch(spark, tmp_path):
    events = tables.read(spark, "/root/testdata/sf0.001", "page_events")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.views_by_day(jobs.stream_of(spark, str(tmp_path / "in"), events.schema), "40 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("by_day").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["day"]: r["views"] for r in spark.sql("SELECT * FROM by_day").collect()}
    want = {r["day"]: r["views"] for r in analytics.views_by(events.withColumn("day", F.to_date("ts")), ["day"]).collect()}
    assert got == want


def test_registry_from_announces(spark, tmp_path):
    at = datetime(2025, 1, 1, tzinfo=UTC)
    rows = [("a", "A", at), ("a", None, at + timedelta(1)), ("b", "B", at)]
    news = spark.createDataFrame(rows, "dest_hash string, name string, ts timestamp")
    news.write.parquet(str(tmp_path / "in"))
    q = jobs.announces_to_registry(jobs.stream_of(spark, str(tmp_path / "in"), news.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.dest_hash: (r.name, r.announce_count) for r in spark.read.parquet(str(tmp_path / "out/nodes/v=000000000000")).collect()}
    want = {r.dest_hash: (r.name, r.announce_count) for r in upserts.upsert_nodes(spark.createDataFrame([], tables.NODES), news).collect()}
    assert got == want == {"a": ("A", 2), "b": ("B", 1)}


def test_queue_from_announces(spark, tmp_path):
    at = datetime(2025, 1, 2, tzinfo=UTC)
    announced = spark.createDataFrame([(h, None, at) for h in ("a", "a", "b", "seed", None)], "dest_hash string, name string, ts timestamp")
    announced.write.parquet(str(tmp_path / "in"))
    row = dict.fromkeys(tables.PAGES.names) | {"url": "b:/page/index.mu", "ok": True, "fetched_at": at - timedelta(hours=3)}
    pages = spark.createDataFrame([tuple(row.values())], tables.PAGES)
    q = jobs.announces_to_queue(jobs.stream_of(spark, str(tmp_path / "in"), announced.schema), str(tmp_path / "out"), str(tmp_path / "cp"), pages, EngineConfig(seed_nodes=frozenset(["seed"])))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/crawl_queue/v=000000000000")).collect()
    assert {(r.url, r.priority) for r in got} == {("a:/page/index.mu", 3), ("seed:/page/index.mu", 1)}


def test_leases(spark, tmp_path):
    at = datetime(2025, 1, 2, tzinfo=UTC)
    queue = spark.createDataFrame([(f"n:/p{k}", "n", f"/p{k}", at, 0, at + timedelta(hours=k - 2), 9 - k) for k in range(5)], tables.CRAWL_QUEUE)
    tables.write_snapshot(queue, str(tmp_path), "crawl_queue", 0)
    asked = spark.createDataFrame([("w1", at), ("w2", at), ("w3", at), ("w4", at)], "worker string, ts timestamp")
    asked.write.parquet(str(tmp_path / "in"))
    q = jobs.leases(jobs.stream_of(spark, str(tmp_path / "in"), asked.schema), str(tmp_path), str(tmp_path / "cp"))
    q.awaitTermination(120)
    claims = {r.worker: r.url for r in spark.read.parquet(str(tmp_path / "claims/v=000000000000")).collect()}
    assert claims == {"w1": "n:/p2", "w2": "n:/p1", "w3": "n:/p0"}  # two items aren't due yet
    later = {r.url: r.next_attempt for r in spark.read.parquet(str(tmp_path / "crawl_queue/v=000000000001")).collect()}
    assert len(later) == 5 and {u for u, t in later.items() if t == (at + timedelta(seconds=75)).replace(tzinfo=None)} == set(claims.values())


def test_ingest(spark):
    bodies = [json.dumps({"node": "n", "path": "p", "rid": "r"}), json.dumps({"node": "", "path": "p"}), "{broken", None, json.dumps({"node": "n", "path": "p", "link": ""})]
    df = spark.createDataFrame([(datetime(2025, 1, 1), b) for b in bodies], "ts timestamp, body string")
    got = jobs.ingest_views(df).collect()
    assert len(got) == 2 and {r.vid is None for r in got} == {True, False}


def test_token_bucket(spark, tmp_path):
    at = datetime(2025, 1, 1)
    rows = [("a", at + timedelta(milliseconds=10 * k)) for k in range(10)] + [("b", at)]
    df = spark.createDataFrame(rows, "link string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.token_bucket(jobs.stream_of(spark, str(tmp_path / "in"), df.schema)).writeStream.outputMode("append").format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT link, sum(int(allowed)) AS n FROM bucket GROUP BY link").collect()
    assert {r.link: r.n for r in got} == {"a": 6, "b": 1}
