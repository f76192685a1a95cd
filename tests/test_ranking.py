"""Cover density, fusion, spreading, folding, upserts and suggestions."""

import random
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshloom.functions.analyzer import english, simple
from meshloom.functions.querylang import parse
from meshloom.operators import results, retrieval, upserts
from meshloom.operators.index import build
from meshloom.operators.ranking import search
from meshloom.operators.snippets import OFF, ON, passages
from meshloom.operators.suggest import suggest
from meshloom.sources import tables

UTC = timezone.utc
AS_OF = datetime(2025, 7, 1, tzinfo=UTC)


@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([1.0, 0.4, 0.1])), max_size=12), st.data())
@settings(max_examples=200, deadline=None)
def test_cover_density_agrees_with_the_closed_forms(words, data):
    places = sorted(data.draw(st.lists(st.integers(1, 40), min_size=len(words), max_size=len(words), unique=True)))
    xs, ws = [w for w, _ in words], [w for _, w in words]
    match, rel = retrieval.cover_rank(parse("a or b"), xs, places, ws)
    assert match == bool(words) and abs(rel - sum(ws)) < 1e-9
    two = sum(2 / (1 / ws[k] + 1 / ws[k - 1]) / (places[k] - places[k - 1]) for k in range(1, len(xs)) if xs[k] != xs[k - 1])
    match, rel = retrieval.cover_rank(parse("a b"), xs, places, ws)
    assert match == ({"a", "b"} <= set(xs)) and abs(rel - two) < 1e-9


def test_phrases_and_exclusions():
    assert retrieval.cover_rank(parse('"a b"'), ["a", "b"], [1, 2], [1.0, 1.0]) == (True, 1.0)
    assert retrieval.cover_rank(parse('"a b"'), ["a", "b"], [1, 3], [1.0, 1.0])[0] is False
    assert retrieval.cover_rank(parse("a -b"), ["a", "b"], [1, 3], [1.0, 1.0])[0] is False
    assert retrieval.cover_rank(parse("-b"), [], [], []) == (True, 0.0)


@given(st.lists(st.sampled_from("ABCD"), max_size=40), st.integers(1, 4), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_spreading_keeps_all_and_caps(nodes, cap, window):
    order = results.spread(nodes, cap, window)
    assert sorted(order) == list(range(len(nodes)))
    left = {n: nodes.count(n) for n in set(nodes)}
    for k, place in enumerate(order):
        recent = [nodes[p] for p in order[max(0, k - window) : k]]
        if recent.count(nodes[place]) >= cap:  # only if nothing else was left
            assert all(recent.count(n) >= cap for n, c in left.items() if c)
        left[nodes[place]] -= 1


def test_spreading_example():
    assert "".join("AAAAABBBBB"[k] for k in results.spread("AAAAABBBBB", 3, 10)) == "AAABBBAABB"


def test_folding(spark):
    rows = [(1, "u1", None, "h", 2.0), (1, "u2", "", "h", 1.0), (1, "u3", "c", "h", 3.0), (1, None, None, "h", 9.0), (2, "u1", None, None, 1.0), (1, "u4", None, "h", 2.0)]
    df = spark.createDataFrame(rows, "qid long, url string, canonical string, content_hash string, score double")
    assert {(r.qid, r.url, r.also_on) for r in results.folded(df).collect()} == {(1, "u1", 2), (1, "u3", None), (2, "u1", None)}


def test_suggest(spark):
    lexicon = spark.createDataFrame([("colorado", 5), ("dog", 9)], "word string, df int")
    asked = spark.createDataFrame([(1, "colarado dogs"), (2, "colorado"), (3, ""), (4, None), (5, "dogs")], "qid long, q string")
    assert {tuple(r) for r in suggest(asked, lexicon).collect()} == {(1, "colorado dogs")}


def test_upserts_of_nodes(spark):
    t = lambda d: datetime(2025, 1, d, tzinfo=UTC)
    nodes = spark.createDataFrame([("a", "old", t(1), t(1), 3, None, None)], tables.NODES)
    news = spark.createDataFrame([("a", "new", t(3)), ("a", None, t(4)), ("b", None, t(2)), (None, "x", t(1))], "dest_hash string, name string, ts timestamp")
    got = {r.dest_hash: (r.name, r.announce_count, r.last_seen.day, r.first_seen.day) for r in upserts.upsert_nodes(nodes, news).collect()}
    assert got == {"a": ("new", 5, 4, 1), "b": (None, 1, 2, 2)}


def _page(spark, **values):
    base = dict.fromkeys(tables.PAGES.names)
    return spark.createDataFrame([tuple({**base, **values}[n] for n in tables.PAGES.names)], tables.PAGES)


def test_recrawl_of_an_unchanged_page(spark):
    old = _page(spark, id=1, url="u", node_hash="n", content_hash="h", ok=True, fetched_at=AS_OF - timedelta(2), first_seen=AS_OF - timedelta(9), last_changed=AS_OF - timedelta(5), embedding=[1.0, 2.0])
    same = _page(spark, id=2, url="u", node_hash="other", content_hash="h", ok=True, fetched_at=AS_OF, title="t")
    r = upserts.record_pages(old, same, AS_OF).collect()
    assert len(r) == 1 and r[0].last_changed.replace(tzinfo=UTC) == AS_OF - timedelta(5) and r[0].embedding == [1.0, 2.0] and r[0].title == "t" and r[0].node_hash == "n" and r[0].id == 1
    moved = _page(spark, id=2, url="u", content_hash="new", fetched_at=AS_OF)
    assert upserts.record_pages(old, moved, AS_OF).first().last_changed.replace(tzinfo=UTC) == AS_OF


def test_queue(spark):
    schema = tables.CRAWL_QUEUE
    q = spark.createDataFrame([("n:/page/a", "n", "/page/a", AS_OF, n, AS_OF - timedelta(n), 5 - n) for n in (0,)] + [("n:/page/b", "n", "/page/b", AS_OF, 4, AS_OF + timedelta(1), 3)], schema)
    failed = spark.createDataFrame([("n:/page/a",), ("n:/page/b",)], "url string")
    left = upserts.reschedule(q, failed, AS_OF).collect()
    assert [(r.url, r.attempts, (r.next_attempt.replace(tzinfo=UTC) - AS_OF).total_seconds()) for r in left] == [("n:/page/a", 1, 3600.0)]
    assert [r.url for r in upserts.claim_due(q, AS_OF).collect()] == ["n:/page/a"]
    pages = _page(spark, url="n:/page/c", ok=True, fetched_at=AS_OF - timedelta(hours=1))
    batch = spark.createDataFrame([("n", "/page/c", None), ("n", "/page/d", 2), ("n", "/page/d", 7), ("n", "/page/a", 1)], "node_hash string, path string, priority int")
    assert [(r.url, r.priority) for r in upserts.enqueue(q, batch, pages, AS_OF, 24).collect()] == [("n:/page/d", 2)]


def test_passages():
    text = " ".join(f"w{k}" for k in range(50)) + " relay " + " ".join(f"v{k}" for k in range(50))
    found = passages(text, frozenset(["relay"]))
    assert len(found) == 1 and f"{ON}relay{OFF}" in found[0] and 10 <= len(found[0].split()) <= 28
    assert passages("", frozenset(["x"])) == [] and passages("one two", frozenset(["x"])) == ["one two"]


def test_popularity_needs_a_match(spark):
    """A page that only its vector brings up gets nothing for the links to it."""
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    hub, hit = vec(), vec()
    pages = _page(spark, id=1, url="n:/hub", node_hash="n", title="hub", content="nothing here", ok=True, embedding=hub, fetched_at=AS_OF).unionByName(_page(spark, id=2, url="n:/hit", node_hash="n", title="zine", content="zine zine", ok=True, embedding=hit, fetched_at=AS_OF))
    for k in range(4):
        pages = pages.unionByName(_page(spark, id=3 + k, url=f"n:/x{k}", node_hash="n", title="x", content="x", ok=True, embedding=vec(), fetched_at=AS_OF))
    links = spark.createDataFrame([(f"f{k}", "n:/hub", None, None, None) for k in range(602)], tables.LINKS)
    nodes, clicks = spark.createDataFrame([], tables.NODES), spark.createDataFrame([], tables.CLICKS)
    got = search(pages, nodes, links, clicks, [retrieval.Request(1, "zine", vector=tuple(hub)), retrieval.Request(2, "  ")], AS_OF).orderBy("rank").collect()
    score = {r.url: r.score for r in got}
    assert set(r.qid for r in got) == {1} and score["n:/hub"] < 0.1 and got[0].url in ("n:/hit", "n:/hub")


def test_the_english_analyzer(spark):

    pages = _page(spark, id=1, url="a", title="Dogs", content="The running relays of the hill", ok=True).unionByName(_page(spark, id=2, url="b", title="cat", content="a dog and the relay", ok=True)).unionByName(_page(spark, id=3, url="c", title=None, content=None, ok=True))
    rel = lambda q, **k: {r.url: round(r.rel, 3) for r in retrieval.lexical(pages, [retrieval.Request(1, q)], **k).collect()}
    assert rel("dogs") == {"a": 1.0} and rel("dogs", lexeme=english) == {"a": 1.0, "b": 0.1}
    assert rel("the relay", lexeme=english) == {"a": 0.1, "b": 0.1} and rel("the", lexeme=english) == {}
    assert rel('"run relay"', lexeme=english) == {"a": 0.1} and rel("relay -cats", lexeme=english) == {"a": 0.1}
    assert {r.word: r.df for r in retrieval.lexicon(pages, 2, english).collect()} == {"dog": 2, "relay": 2}


def test_an_index_gives_what_the_pages_do(spark, tmp_path):
    rows = [("a", "running dogs on the relay", "dog dog relay"), ("b", None, "the relay runs"), ("c", "cats", ""), ("d", None, None), ("e", "relay", "bulletin board of the relay")]
    page = dict.fromkeys(tables.PAGES.names) | {"ok": True}
    pages = spark.createDataFrame([tuple((page | {"id": k, "url": u, "title": t, "content": c, "type": "wiki" if u == "a" else None}).values()) for k, (u, t, c) in enumerate(rows)] + [tuple((page | {"url": "z", "title": "relay", "ok": False}).values())], tables.PAGES)
    for lexeme in (simple, english):
        index = build(pages, str(tmp_path / lexeme.__name__), lexeme, 4, 2)
        for q, kind in (("relay", None), ("relay dog", None), ("relay or cats", None), ("relay -dog", None), ("-relay", None), ('"bulletin board"', None), ("relay", "wiki"), ("absent", None), ("the", None), (" ", None), ("dog relay runs", None)):
            asked = [retrieval.Request(1, q, kind)]
            want = {tuple(r) for r in retrieval.lexical(pages, asked, lexeme).collect()}
            assert {tuple(r) for r in retrieval.lexical(pages, asked, lexeme, index).collect()} == want, q
        assert {tuple(r) for r in index.lexicon(spark).collect()} == {tuple(r) for r in retrieval.lexicon(pages, 2, lexeme).collect()}
    assert build(pages.limit(0), str(tmp_path / "none")).postings(spark, ("relay",)).count() == 0


def test_vectors_in_blocks(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(90)] + [None, [0.0] * 64, [float("nan")] * 64, [1.0]]
    page = dict.fromkeys(tables.PAGES.names) | {"ok": True}
    pages = spark.createDataFrame([tuple((page | {"id": k, "url": f"u{k}", "embedding": v}).values()) for k, v in enumerate(vectors)], tables.PAGES)
    asked = pages.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    one = {tuple(r) for r in retrieval.vector_neighbours(pages, asked).select("qid", "url", "rank").collect()}
    some = {tuple(r) for r in retrieval.vector_neighbours(pages, asked, block=7, broadcast_blocks=2).select("qid", "url", "rank").collect()}
    batch = [retrieval.Request(k, "a", vector=tuple(map(float, v))) for k, v in enumerate(vectors[:90])]
    want = {tuple(r) for r in retrieval.vector_candidates(pages, batch).select("qid", "url", "rank").collect()}
    assert one == some and len(one) == 8100 and len(one - want) < 20  # the table holds the vectors in single precision
    assert retrieval.vector_neighbours(pages, asked.limit(0)).count() == 0 and retrieval.vector_neighbours(pages.limit(0), asked).count() == 0
