"""Sessions and orphan references against brute force and on the edges."""

import datetime as dt
import random
from collections import Counter

from compare import plain
from meshloom.operators.references import orphan_references, orphan_report
from meshloom.operators.sessions import sessions

UTC = dt.timezone.utc
EVENTS = "id long, ts timestamp, node string, path string, vid string, extra string"
PAGES = "url string, ok boolean, fetched_at timestamp, first_seen timestamp, junk string"
LINKS = "from_url string, to_url string, to_node_hash string, ref_field string"
NODES = "dest_hash string, first_seen timestamp"
H = "0123456789abcdef0123456789abcdef"


def day(y, m, d, *t):
    return dt.datetime(y, m, d, *t, tzinfo=UTC)


def rows(df):
    return Counter(tuple(plain(v) for v in r) for r in df.collect())


def brute_sessions(events, gap):
    by = {}
    for _, ts, node, path, vid, _ in events:
        if vid is not None and vid.strip() and ts is not None:
            by.setdefault(vid, set()).add((ts, node, path))
    out = Counter()
    for vid, views in by.items():
        views = sorted(views, key=lambda v: v[0])
        start = last = views[0][0]
        n = 0
        for ts, *_ in views:
            if (ts - last).total_seconds() > gap:
                out[(vid, start, last, n)] += 1
                start, n = ts, 0
            last = ts
            n += 1
        out[(vid, start, last, n)] += 1
    ms = lambda t: int(t.timestamp() * 1e6 + 0.5) // 1000
    return Counter({(v, ms(a), ms(b), n): c for (v, a, b, n), c in out.items()})


def test_sessions_against_brute_force(spark):
    rng = random.Random(5)
    base = day(2025, 1, 1)
    events = []
    for i in range(1500):
        vid = rng.choice(["a", "a", "a", "b", "c", None, " ", ""])
        ts = base + dt.timedelta(microseconds=rng.randrange(0, 90_000) * 1_000_000 + rng.choice([0, 1, 999_999]))
        events.append((i, ts, rng.choice(["n", None]), rng.choice(["p", "q", None]), vid, "x"))
    events += events[:200]
    assert rows(sessions(spark.createDataFrame(events, EVENTS))) == brute_sessions(events, 1800)


def test_session_gap_is_inclusive_and_ties_stay_together(spark):
    at = day(2025, 1, 1, 12)
    events = [(1, at, "n", "p", "v", ""), (2, at, "n", "q", "v", ""), (3, at + dt.timedelta(minutes=30), "n", "p", "v", ""), (4, at + dt.timedelta(minutes=60, microseconds=1), "n", "p", "v", ""), (5, None, "n", "p", "v", "")]
    found = sorted((r["n_events"]) for r in sessions(spark.createDataFrame(events, EVENTS)).collect())
    assert found == [1, 3]


def test_sessions_of_nothing(spark):
    assert sessions(spark.createDataFrame([], EVENTS)).count() == 0


def tables(spark, pages, links, nodes):
    return spark.createDataFrame(links, LINKS), spark.createDataFrame(pages, PAGES), spark.createDataFrame(nodes, NODES)


def test_orphans(spark):
    a, b, later, failed = f"{H}:/page/a.mu", f"{H}:/page/B.mu", f"{H}:/page/later.mu", f"{H}:/page/failed.mu"
    pages = [
        (a, True, day(2025, 1, 5), None, "x"), (a, False, day(2025, 2, 7), None, "x"),  # the latest fetch counts, though it failed
        (b, True, day(2025, 1, 31, 23, 59), None, "x"), (later, True, day(2025, 5, 1), day(2025, 3, 1), "x"), (failed, False, day(2025, 1, 1), None, "x"), (None, True, None, None, None),
    ]
    links = [
        (a, b, H, "x"), (a, b, H, "x"),  # repeated
        (a, f" {H.upper()}:/page/B.mu#top\t", f" {H.upper()} ", "x"), (a, f"{H}:/page/b.mu", None, "x"),  # a path keeps its case
        (a, later, "  ", "x"), (a, failed, "f" * 32, "x"), (a, None, None, "x"), (a, " ", "", "x"), (f"{H}:/gone", b, "e" * 32, "x"), (None, failed, H, None),
    ]
    nodes = [(H, day(2025, 2, 28)), (None, None), ("e" * 32, day(2025, 4, 1)), ("d" * 32, None)]
    found = rows(orphan_references(*tables(spark, pages, links, nodes)))
    feb = "2025-02"
    assert found == Counter([("to_url", feb, a, f"{H}:/page/b.mu"), ("to_url", feb, a, later), ("to_url", feb, a, failed), ("to_node_hash", feb, a, failed), ("to_url", None, None, failed)])
    report = rows(orphan_report(*tables(spark, pages, links, nodes)))
    assert report == Counter([("to_url", feb, 3, 3), ("to_node_hash", feb, 1, 1), ("to_url", None, 1, 1)])


def test_orphans_of_nothing(spark):
    assert orphan_references(*tables(spark, [], [], [])).count() == 0
    links = [(f"{H}:/a", f"{H}:/b", H, "")]
    assert orphan_references(*tables(spark, [], links, [])).count() == 2


def test_a_key_of_most_rows(spark):
    pages = [(f"{H}:/p{i}", True, day(2025, 1, 1 + i % 28), None, "") for i in range(200)]
    links = [(f"{H}:/p{i}", f"{H}:/missing", H, "") for i in range(200)]
    found = orphan_references(*tables(spark, pages, links, [(H, day(2024, 1, 1))]))
    assert found.count() == 200
