"""Golden cases of the scalar expressions, markup and the query language."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from meshloom.functions import analyzer, markup, text, trigram
from meshloom.functions.querylang import Factor, parse

AS_OF = datetime(2026, 11, 26, tzinfo=timezone.utc)


def values(spark, cases, build, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_price(spark):
    assert values(spark, ["24.00", "$24.00", "24,00 EUR", "1,234.56", "-5", "free", "", None, "99999999"], text.parse_price) == [24.0, 24.0, 24.0, 1.23, None, None, None, None, None]


def test_declared_date(spark):
    got = values(spark, ["2026-08-16", " 2026-08-16T10:30:00Z", "2014-12-31", "2099-01-01", "2024-13-01", "junk", "2024-01-02T25:00", "2024-01-02x", None], lambda c: F.date_format(text.parse_declared_date(c, AS_OF), "yyyy-MM-dd HH:mm"))
    assert got == ["2026-08-16 00:00", "2026-08-16 10:30", None, None, None, None, None, None, None]


def test_date_precedence(spark):
    df = spark.createDataFrame([("junk", "2024-01-02", "2024-01-01")], "u string, p string, d string")
    got = df.select(text.effective_declared_date(F.col("u"), F.col("p"), F.col("d"), AS_OF).cast("date").cast("string").alias("x")).first()["x"]
    assert got == "2024-01-02"


def test_query_normalisation_and_hash(spark):
    assert values(spark, ["  Foo \u00a0 BAR\n", "", None, "a" * 199 + " b"], text.normalize_query) == ["foo bar", "", None, "a" * 199 + " "]
    assert values(spark, ["", None, "x"], text.query_hash)[:2] == [None, None]


def test_rank_type(spark):
    df = spark.createDataFrame([("news", "file-index"), ("wiki", "file-index"), (None, "article"), (None, None)], "d string, i string")
    assert [r[0] for r in df.select(text.rank_type(F.col("d"), F.col("i"))).collect()] == ["file-index", "wiki", "article", "index"]


def test_freshness(spark):
    df = spark.createDataFrame([("news", 0), ("news", 7), ("news", 14), ("wiki", 1), ("news", -3)], "t string, age int")
    when = F.lit(AS_OF).cast("timestamp") - F.make_interval(days=F.col("age"))
    assert [round(r[0], 6) for r in df.select(text.freshness(F.col("t"), when, AS_OF)).collect()] == [2.0, 1.5, 1.25, 1.0, 2.0]


def test_intent(spark):
    df = spark.createDataFrame([("recent news", "news"), ("recent news", "wiki"), ("buy radio", "product"), ("hello", "news")], "q string, t string")
    assert [r[0] for r in df.select(text.intent_multiplier(F.col("q"), F.col("t"))).collect()] == [1.35, 0.4, 1.5, 1.0]


def test_junk_ratio(spark):
    assert values(spark, ["─a─b", "", None, "abc"], text.junk_ratio) == [0.5, 0.0, 0.0, 0.0]


def test_trigrams(spark):
    df = spark.createDataFrame([("colarado", "colorado"), ("", ""), ("abc", "ABC")], "a string, b string")
    assert [r[0] for r in df.select(trigram.similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 1.0]


def test_ref_is_url_safe(spark):
    import base64

    df = spark.createDataFrame([("book", "p?>" * 60)], "b string, p string")
    want = base64.urlsafe_b64encode(("book\n" + "p?>" * 60).encode()).decode().rstrip("=")
    assert df.select(text.encode_ref(F.col("b"), F.col("p"))).first()[0] == want


def test_markup_text(spark):
    got = values(spark, [">Title\n# +type: news\nbody  `F0afred`f\n\n\n\nend", None, "`[Label`:/page/x.mu] rest", "---\n-"], markup.to_text)
    assert got == ["Title\nbody red\n\nend", "", "Label rest", ""]


def test_titles(spark):
    assert values(spark, ["  >Title", "\n\nfirst\n>Head", "plain", "", None, ">>\nx"], markup.title) == [">Title", "Head", "plain", None, None, "x"]


def test_links(spark):
    n = "a" * 32
    raw = "`[Home`:/page/index.mu] `[Doc`:/page/read.mu`ref=abc] `[x`https://x] `[y`lxmf@z] `[z`:/other] `[again`/page/index.mu] `[There`" + "B" * 16 + ":/page/t.mu] `[`:/page/e.mu`a=1|ref=1|ref= 2 ]"
    df = spark.createDataFrame([(f"{n}:/page/p.mu", n, raw), ("u", None, None), ("v", n, "")], "url string, node_hash string, raw string")
    got = {tuple(r)[1:] for r in markup.extract_links(df).collect()}
    assert got == {(f"{n}:/page/index.mu", n, "/page/index.mu", "Home"), (f"{n}:/page/read.mu#abc", n, "/page/read.mu", "Doc"), ("b" * 16 + ":/page/t.mu", "b" * 16, "/page/t.mu", "There"), (f"{n}:/page/e.mu#2", n, "/page/e.mu", None)}


@pytest.mark.parametrize("word, want", [("dogs", "dog"), ("running", "run"), ("flies", "fli"), ("hopeful", "hope"), ("national", "nation"), ("generously", "generous"), ("happy", "happi"), ("agreed", "agre"), ("skies", "sky"), ("rational", "ration"), ("abilities", "abil"), ("cat", "cat"), ("是", "是")])
def test_stems(word, want):
    assert analyzer.stem(word) == want


def test_query_language():
    q = parse('radio "bulletin board" -spam or Relay')
    assert q.alternatives == ((Factor(("radio",)), Factor(("bulletin", "board")), Factor(("spam",), True)), (Factor(("relay",)),))
    assert parse("").alternatives == () and parse(None).alternatives == () and parse('or "').alternatives == ()
    assert parse("a b").simple == "two" and parse("a or b or c").simple == "any" and parse("a -b").simple == "other"
