"""Requests and replies, declared metadata, and a crawl's step from markup to tables."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from meshloom.api import Service, known_page
from meshloom.config import EngineConfig
from meshloom.functions.declared import declared, structural_type
from meshloom.functions.text import query_hash
from meshloom.operators import crawl
from meshloom.sources import derived, tables

AS_OF = datetime(2025, 7, 1, tzinfo=timezone.utc)
N = "a" * 32
RAW = f"# +type: product\n# +title: Kit\n# +tags: a, b,,\n# +price: 24,00 EUR\n# +updated: junk\n# +published: 2024-01-02\n>Head\nbody `[Other`:/page/o.mu] `[File`:/file/x.zip] `[Reader`{'b' * 32}:/page/read.mu`ref=1]"


def test_declared(spark):
    df = spark.createDataFrame([(RAW,), (None,), ("",), ("#+x:1\n# + y : 2 \n#+x:3\n# z: 4\n# +e:\n",)], "raw string")
    got = [r[0] for r in df.select(declared(F.col("raw"))).collect()]
    assert got[0]["type"] == "product" and got[1] is None and got[2] == {} and got[3] == {"x": "1", "y": "2"}
    files = " ".join(f"`[f`:/file/{k}.zip]" for k in range(3))
    df = spark.createDataFrame([(files,), (RAW,)], "raw string")
    assert [r[0] for r in df.select(structural_type(F.col("raw"))).collect()] == ["file-index", None]


def test_crawl_step(spark):
    queue = spark.createDataFrame([(f"{N}:/page/p.mu", N, "/page/p.mu"), (f"{N}:/page/gone.mu", N, "/page/gone.mu"), (f"{N}:/file/a.zip", N, "/file/a.zip")], "url string, node_hash string, path string")
    fetched = crawl.fetch(queue, lambda node, path: (RAW.encode() if path == "/page/p.mu" else None, 7))
    assert {(r.path, r.ok) for r in fetched.collect()} == {("/page/p.mu", True), ("/page/gone.mu", False)}
    (page,) = crawl.extract(fetched, AS_OF).collect()
    assert (page.title, page.type, page.tags, float(page.price), page.md_date.date().isoformat(), page.headings, page.md_declared) == ("Kit", "product", ["a", "b"], 24.0, "2024-01-02", "Head", True)
    links, more = crawl.found_links(fetched, EngineConfig(seed_nodes=frozenset([N])))
    assert {r.to_url for r in links.collect()} == {f"{N}:/page/o.mu", f"{'b' * 32}:/page/read.mu#1"}
    assert [tuple(r) for r in more.collect()] == [(N, "/page/o.mu", 2)]
    vectors = crawl.embed(crawl.extract(fetched, AS_OF), lambda prompts: [[1.0, 0.0] for _ in prompts], 2).collect()
    assert list(vectors[0].embedding) == [1.0, 0.0]
    assert crawl.embed(crawl.extract(fetched, AS_OF), lambda prompts: [[0.0, 0.0] for _ in prompts], 2).first().embedding is None


def test_service(spark):
    folder = "/root/testdata/sf0.001"
    pages = derived.latest_pages(tables.read(spark, folder, "pages")).cache()
    clicks = derived.clicks(derived.click_events(spark, folder))
    from meshloom.plans import stored

    logged, index = [], stored.index(spark, folder)
    service = Service(spark, {"pages": pages, "nodes": tables.read(spark, folder, "nodes"), "links": tables.read(spark, folder, "links"), "clicks": clicks, "lexicon": index.lexicon(spark).cache()}, AS_OF, index=index, log=lambda name, rows: logged.append((name, rows.collect())))
    assert service.handle("{")["err"] == "bad_encoding" and service.handle("[1]")["err"] == "bad_encoding"
    assert service.handle({"op": "__manifest__"})["ok"] and service.handle({"op": "search", "v": 2, "id": 5}) == {"v": 1, "ok": False, "err": "bad_version", "id": 5}
    assert service.handle({"op": "x", "v": 1})["err"] == "bad_op" and service.handle({"op": "search", "v": 1, "q": " "})["err"] == "missing_field"
    reply = service.handle(json.dumps({"op": "search", "v": 1, "id": 9, "q": "harbour station", "limit": 99, "offset": -3}))
    assert reply["ok"] and reply["id"] == 9 and reply["limit"] == 20 and reply["offset"] == 0 and 0 < len(reply["res"]) <= 20 and reply["total"] >= len(reply["res"])
    assert "content_hash" not in reply["res"][0] and logged[0][0] == "searches" and logged[0][1][0].results == reply["total"]
    thin = service.handle({"op": "search", "v": 1, "q": "harbor staton"})
    assert thin["total"] == 0 and thin["suggestion"] == "harbour station"
    assert service.handle({"op": "click", "v": 1, "url": "u"}) == {"v": 1, "ok": True} and [name for name, _ in logged[-2:]] == ["click_events", "clicks"]
    assert logged[-2][1][0].query_hash is None and logged[-1][1][0].clicks == 1
    top = reply["res"][-1]
    for n in (1, 2):
        service.handle({"op": "click", "v": 1, "url": top["url"], "q": " Harbour  Station "}, f"link{n}")
    known = clicks.where(F.col("url") == top["url"]).first()
    assert logged[-1][1][0].clicks == 2 + (known.clicks if known else 0) and logged[-1][1][0].last_clicked == AS_OF.replace(tzinfo=None)
    want = spark.range(1).select(query_hash(F.lit("harbour station"))).first()[0]
    assert logged[-2][1][0].query_hash == want and logged[-2][1][0].url == top["url"]
    again = service.handle({"op": "search", "v": 1, "q": "harbour station", "limit": 20}, "other")
    assert next(r["score"] for r in again["res"] if r["url"] == top["url"]) > top["score"]
    assert known_page(pages, pages.where("ok").first().url) and not known_page(pages, "nowhere")


def test_rate_limit(spark):
    now = [0.0]
    service = Service(spark, {}, AS_OF, clock=lambda: now[0])
    asked = lambda link: service.handle({"op": "__manifest__", "id": 3}, link)
    assert [asked("a")["ok"] for _ in range(7)] == [True] * 6 + [False]
    assert asked("a") == {"v": 1, "ok": False, "err": "rate_limited", "id": 3} and asked("b")["ok"] and asked(None)["ok"]
    now[0] = 0.5
    assert asked("a")["ok"] and not asked("a")["ok"]
    now[0] = 1000.0
    for k in range(600):
        asked(f"l{k}")
    assert "a" not in service.bucket.held and service.handle("{", "a")["err"] == "bad_encoding"


def test_linked_nodes(spark):
    rows = [(f"{N}:/page/p.mu", N, "/page/p.mu", f"`[A`{'b' * 32}:/page/a.mu] `[B`{'c' * 32}:/page/read.mu`ref=1] `[C`:/page/own.mu] `[D`{'d' * 32}:/file/x.epub]".encode(), 7, True)]
    fetched = spark.createDataFrame(rows, "url string, node_hash string, path string, raw binary, fetch_ms int, ok boolean")
    assert [(r.dest_hash, r.name) for r in crawl.linked_nodes(fetched, AS_OF).collect()] == [("b" * 32, None)]


def test_maintenance(spark):
    page = dict.fromkeys(tables.PAGES.names) | {"id": 1, "url": "n:/p", "ok": True, "title": "two words", "content": "two words"}
    pages = spark.createDataFrame([tuple(page.values()), tuple((page | {"id": 2, "url": "n:/q"}).values())], tables.PAGES)
    state = {
        "pages": pages, "links": spark.createDataFrame([("f", "n:/p", None, None, " Label "), ("g", "n:/p", None, None, "Another")], tables.LINKS),
        "nodes": spark.createDataFrame([("n", None, None, None, 1, AS_OF - timedelta(2), True), ("m", None, None, None, 1, AS_OF, True)], tables.NODES),
        "crawl_queue": spark.createDataFrame([], tables.CRAWL_QUEUE), "lexicon": spark.createDataFrame([("old", 3), ("two", 9)], tables.LEXICON),
    }
    got = {k: {tuple(r) for r in v.collect()} for k, v in crawl.maintenance(state, AS_OF).items()}
    assert got["lexicon"] == {("old", 3), ("two", 2), ("words", 2)} and got["anchors"] == {("n:/p", "Another Label")}
    assert {u for u, *_ in got["crawl_queue"]} == {"n:/page/index.mu"} and len(got["embeddings"]) == 2
