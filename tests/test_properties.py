"""Changes of state applied twice, fusion and freshness within their bounds, and edges of the rollups."""

from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from meshloom.functions import text
from meshloom.operators import analytics, graph, results, retrieval, upserts
from meshloom.sources import derived, tables

AS_OF = datetime(2025, 7, 1, tzinfo=timezone.utc)


def rows(df):
    return Counter(tuple(str(v) for v in r) for r in df.collect())


def test_links_twice(spark):
    old = spark.createDataFrame([("a", "b", "n", "p", "Label"), ("a", "c", "n", "p", None)], tables.LINKS)
    new = spark.createDataFrame([("a", "b", "m", "q", ""), ("a", "b", "m", "q", None), ("a", "c", "n", "p", "Now"), ("d", "e", None, None, "x")], tables.LINKS)
    once = upserts.record_links(old, new)
    assert rows(once) == rows(upserts.record_links(once, new)) == Counter([("a", "b", "n", "p", "Label"), ("a", "c", "n", "p", "Now"), ("d", "e", "None", "None", "x")])


def test_queue_twice(spark):
    queue = spark.createDataFrame([("n:/a", "n", "/a", AS_OF, 0, AS_OF, 6)], tables.CRAWL_QUEUE)
    pages = spark.createDataFrame([], tables.PAGES)
    batch = spark.createDataFrame([("n", "/a", 1), ("n", "/b", 3)], "node_hash string, path string, priority int")
    more = upserts.enqueue(queue, batch, pages, AS_OF)
    after = queue.unionByName(more)
    assert {(r.url, r.priority) for r in after.collect()} == {("n:/a", 6), ("n:/b", 3)} and upserts.enqueue(after, batch, pages, AS_OF).count() == 0
    done = spark.createDataFrame([("n:/a",)], "url string")
    left = upserts.drop_queue(after, done)
    assert rows(left) == rows(upserts.drop_queue(left, done)) and left.count() == 1
    held = upserts.lease(after, upserts.claim_due(after, AS_OF, 1), AS_OF, 75)
    assert [r.url for r in upserts.claim_due(held, AS_OF, 5).collect()] == ["n:/a"]


def test_fusion_is_monotone(spark):
    words = spark.createDataFrame([(1, f"u{k}", k) for k in range(6)], "qid long, url string, rank int")
    near = spark.createDataFrame([(1, f"u{k}", k) for k in range(6)], "qid long, url string, rank int")
    score = {r.url: r.fused for r in retrieval.fuse(words, near).collect()}
    assert abs(score["u0"] - 2 / 61) < 1e-12 and all(score[f"u{k}"] > score[f"u{k + 1}"] for k in range(5))
    alone = {r.url: r.fused for r in retrieval.fuse(words, near.limit(0)).collect()}
    assert all(alone[u] < score[u] for u in score)


def test_guard(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.50005), (2, "a", 0.5), (2, "b", 0.5), (3, "a", 0.1), (3, "b", 0.2), (3, "c", 0.3)], "qid long, url string, distance double")
    assert {r.qid for r in retrieval.uniform_guard(df).collect()} == {2, 3}


def test_freshness_stays_within_its_weight(spark):
    kinds = [*text.FRESHNESS, "forum", None]
    df = spark.createDataFrame([(k, d) for k in kinds for d in (-5, 0, 1, 400, 5000)], "t string, days int")
    got = df.select("t", text.freshness(F.col("t"), F.lit(AS_OF).cast("timestamp") - F.make_interval(days=F.col("days")), AS_OF).alias("f")).collect()
    assert all(1.0 <= r.f <= 1 + text.FRESHNESS.get(r.t, text.FRESHNESS_OTHER)[0] for r in got)


def test_anchors(spark):
    links = [("f", "u", None, None, f" label{k % 700:04d} ") for k in range(1500)] + [("f", "u", None, None, x) for x in (None, "", "  ")] + [("f", None, None, None, "x"), ("f", "v", None, None, None)]
    (only,) = graph.anchors(spark.createDataFrame(links, tables.LINKS)).collect()
    assert only.to_url == "u" and only.anchors == " ".join(f"label{k:04d}" for k in range(700))[:2000]


def test_rollups_of_nothing(spark):
    events = spark.createDataFrame([], tables.PAGE_EVENTS)
    assert analytics.rum_stats(events, AS_OF).first().asDict() == {"views": 0, "visitors": 0, "views_24h": 0}
    assert analytics.rum_by_node(events).count() == 0
    searches, clicks = spark.createDataFrame([], tables.SEARCHES), spark.createDataFrame([], tables.CLICK_EVENTS)
    assert {name: df.count() for name, df in analytics.dashboard(events, clicks, searches, AS_OF).items() if not name.endswith("stats")} == dict.fromkeys(["rum_by_node", "rum_top_pages", "rum_by_day", "top_clicked", "top_searches", "zero_results"], 0)


def test_null_visitors_and_ties(spark):
    at = AS_OF - timedelta(hours=1)
    events = spark.createDataFrame([(k, at, n, "p", v) for k, (n, v) in enumerate([("b", None), ("b", "x"), ("a", "x"), ("a", "x"), (None, "y")])], tables.PAGE_EVENTS)
    assert [tuple(r) for r in analytics.rum_by_node(events).collect()] == [("a", 2, 1), ("b", 2, 1), (None, 1, 1)]


def test_latest_pages(spark):
    page = dict.fromkeys(tables.PAGES.names)
    make = lambda i, url, days: tuple((page | {"id": i, "url": url, "fetched_at": AS_OF - timedelta(days)}).values())
    df = spark.createDataFrame([make(1, "u", 3), make(2, "u", 1), make(3, "u", 1), make(4, "v", 9), make(5, None, 1)], tables.PAGES)
    assert {(r.url, r.id) for r in derived.latest_pages(df).collect()} == {("u", 3), ("v", 4)}


def test_pages_of_results(spark):
    df = spark.createDataFrame([(1, f"u{k}", "n" if k % 2 else "m", None, None, float(-k), k) for k in range(25)], "qid long, url string, node_hash string, canonical string, content_hash string, score double, pos int")
    got = {r.url: r.more_from_node for r in results.page_of(df, 0, 10).collect()}
    assert len(got) == 10 and got["u9"] == 7 and got["u8"] == 8 and got["u0"] is None
    assert [r.url for r in results.page_of(df, 20, 99).orderBy("pos").collect()] == [f"u{k}" for k in range(20, 25)]
    assert results.page_of(df, -4, -1).count() == 1 and results.page_of(df, 40, 10).count() == 0
