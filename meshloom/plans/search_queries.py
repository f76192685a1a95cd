"""Queries of markup, retrieval, ranking and results, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AS_OF, DEFAULT
from ..functions import markup as M
from ..functions.analyzer import english, simple
from ..functions.text import tokens
from ..operators import federation, ranking, results
from ..operators import retrieval as R
from ..operators.graph import inbound_links
from ..operators.suggest import neighbours
from ..operators.suggest import suggest as suggest_words
from ..operators.upserts import upsert_lexicon as fold_lexicon
from ..sources import derived as D
from ..sources.tables import read
from . import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ markup

_SPACE = r"[\s\x0b\x{85}\p{Z}]"
_LINK = r"`\[([^`\]]*)`([^\]]*)\]"
_COLOUR, _CODE = r"`[FBfb][0-9a-fA-F]{3}", r"`[a-zA-Z!_=\*<>]"


def _without(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _strip(x: str) -> str:
    return _without(x, f"^{_SPACE}+|{_SPACE}+$")


def _lines(x: str) -> str:
    return rf"string_split_regex({x}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def _plain(x: str) -> str:
    """Links as their labels, without codes and backticks."""
    return f"replace({_without(_without(x, _LINK, chr(92) + '1'), _CODE)}, '`', '')"


_RAW = "raws AS (SELECT doc_id, left(sha256(source), 16) AS node, left(sha256(source), 16) || ':/page/' || doc_id || '.mu' AS url, text AS raw FROM documents)"
_FLAT = _without(_without(_without("coalesce(raw, '')", _LINK, r"\1 "), _COLOUR), _CODE)
_TEXT = f"list_transform(list_filter({_lines(_FLAT)}, lambda x: NOT starts_with({_strip('x')}, '#')), lambda x: CASE WHEN starts_with(x, '>') OR starts_with(x, '-') THEN {_strip(_without('x', '^[>-]+'))} ELSE x END)"
_JOINED = f"replace(replace(array_to_string({_TEXT}, chr(10)), '\\`', '`'), '`', '')"
_WHOLE = _strip(_without(_without(_JOINED, r"[ \t]+", " "), r"\n{3,}", "\n\n"))
_HEAD_LINE = _without(f"regexp_extract(x, '^{_SPACE}*>+{_SPACE}*(.+)$', 1)", _COLOUR)
_HEAD = f"list_filter(list_transform({_lines("coalesce(raw, '')")}, lambda x: {_strip(_plain(_HEAD_LINE))}), lambda x: x <> '')"
_TITLE_LINE = _strip(_without(_without("x", _COLOUR), "^>+"))
_TITLED = f"list_filter(list_transform(list_filter({_lines('raw')}, lambda x: starts_with({_strip('x')}, '>')), lambda x: {_strip(_plain(_TITLE_LINE))}), lambda x: x <> '')"


@query(f"WITH {_RAW} SELECT doc_id, {_WHOLE} AS text FROM raws")
def page_text(spark, folder):
    return D.raw_pages(spark, folder).select("doc_id", M.to_text(F.col("raw")).alias("text"))


@query(f"WITH {_RAW} SELECT doc_id, array_to_string({_HEAD}, chr(10)) AS headings FROM raws")
def page_headings(spark, folder):
    return D.raw_pages(spark, folder).select("doc_id", M.headings(F.col("raw")).alias("headings"))


@query(f"WITH {_RAW} SELECT doc_id, left(coalesce({_TITLED}[1], list_filter(list_transform(string_split({_WHOLE}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')[1]), 200) AS title FROM raws")
def page_titles(spark, folder):
    return D.raw_pages(spark, folder).select("doc_id", M.title(F.col("raw")).alias("title"))


@query(rf"""WITH {_RAW}, found AS (SELECT url AS from_url, node, unnest(m) AS whole, unnest(range(len(m))) AS at_no FROM (SELECT url, node, regexp_extract_all(raw, '{_LINK}') AS m FROM raws)),
parts AS (SELECT from_url, node, at_no, regexp_extract(whole, '{_LINK}', 1) AS text, string_split(regexp_extract(whole, '{_LINK}', 2), '`') AS p FROM found),
placed AS (SELECT from_url, at_no, nullif(left({_strip("replace(" + _without(_without("text", _COLOUR), _CODE) + ", '`', '')")}, 200), '') AS label, {_strip('p[1]')} AS target, node,
  nullif({_strip("substr(list_filter(string_split(coalesce(p[2], ''), '|'), lambda x: starts_with(x, 'ref='))[-1], 5)")}, '') AS ref FROM parts),
good AS (SELECT from_url, at_no, label, ref, CASE WHEN target LIKE ':%' OR target LIKE '/page/%' THEN node ELSE lower(regexp_extract(target, '^([0-9a-fA-F]{{16,64}}):', 1)) END AS to_node_hash,
  CASE WHEN target LIKE ':%' THEN substr(target, 2) WHEN target LIKE '/page/%' THEN target ELSE regexp_extract(target, '^[0-9a-fA-F]{{16,64}}:(.*)$', 1) END AS to_path FROM placed)
SELECT from_url, to_url, to_node_hash, to_path, label FROM (SELECT *, to_node_hash || ':' || to_path || coalesce('#' || ref, '') AS to_url FROM good WHERE to_path LIKE '/page/%')
QUALIFY row_number() OVER (PARTITION BY from_url, to_url ORDER BY at_no) = 1""")
def extract_links(spark, folder):
    return M.extract_links(D.raw_pages(spark, folder))


# ------------------------------------------------------------------ words

_LATEST = "p AS (SELECT * FROM pages WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, id DESC) = 1)"
_WORDS = "regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
_POSTS = f"""{_LATEST}, t AS (SELECT url, type, {_WORDS.format(x='title')} AS a, {_WORDS.format(x="coalesce(headings, '') || ' ' || coalesce(anchors, '')")} AS b, {_WORDS.format(x='description')} AS c, {_WORDS.format(x='content')} AS d FROM p WHERE ok),
posts AS (
  SELECT url, type, unnest(a) AS lexeme, unnest(range(1, len(a) + 1)) AS pos, 1.0 AS w FROM t
  UNION ALL SELECT url, type, unnest(b), len(a) + unnest(range(1, len(b) + 1)), 0.4 FROM t
  UNION ALL SELECT url, type, unnest(c), len(a) + len(b) + unnest(range(1, len(c) + 1)), 0.2 FROM t
  UNION ALL SELECT url, type, unnest(d), len(a) + len(b) + len(c) + unnest(range(1, len(d) + 1)), 0.1 FROM t
)"""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return stored.pages(spark, folder)


def _posts(spark: SparkSession, folder: str, *words: str) -> DataFrame:
    """``url, lexeme, pos, w`` of the given words, from the index."""
    return stored.index(spark, folder).postings(spark, words).select("url", "lexeme", F.inline("at"))


def _lexical(spark: SparkSession, folder: str, *requests: R.Request, lexeme=simple) -> DataFrame:
    return R.lexical(_pages(spark, folder), list(requests), lexeme, stored.index(spark, folder, lexeme))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rel", F.round("rel", 5))


@query(f"WITH {_POSTS} SELECT url, round(sum(w)::DOUBLE, 5) AS rel FROM posts WHERE lexeme = 'relay' GROUP BY url")
def lex_single_term(spark, folder):
    return _rounded(R.rank_any(_posts(spark, folder, "relay")))


@query(f"WITH {_POSTS} SELECT url, round(sum(w)::DOUBLE, 5) AS rel FROM posts WHERE lexeme IN ('antenna', 'bateria', 'relais') GROUP BY url")
def lex_or(spark, folder):
    return _rounded(R.rank_any(_posts(spark, folder, "antenna", "bateria", "relais")))


_TWO = f"""{_POSTS}, n AS (SELECT url, type, lexeme, pos, w, lag(lexeme) OVER v AS l0, lag(pos) OVER v AS p0, lag(w) OVER v AS w0 FROM posts WHERE lexeme IN ('routing', 'table') WINDOW v AS (PARTITION BY url ORDER BY pos)),
two AS (SELECT url, any_value(type) AS type, sum(2.0::DOUBLE / (1 / w::DOUBLE + 1 / w0::DOUBLE) / (pos - p0)) AS rel FROM n WHERE l0 <> lexeme GROUP BY url)"""


@query(f"WITH {_TWO} SELECT url, round(rel, 5) AS rel FROM two")
def lex_two_term_and(spark, folder):
    return _rounded(R.rank_two(_posts(spark, folder, "routing", "table")))


@query(f"WITH {_TWO} SELECT 1::BIGINT AS qid, url, round(rel, 6) AS rel FROM two")
def lex_general_two(spark, folder):
    """The general evaluation of a query gives what the closed form does."""
    return _lexical(spark, folder, R.Request(1, "routing table"))


@query(f"WITH {_POSTS} SELECT 1::BIGINT AS qid, url, round(sum(w)::DOUBLE, 5) AS rel FROM posts WHERE lexeme = 'relay' AND url NOT IN (SELECT url FROM posts WHERE lexeme = 'crawler') GROUP BY url")
def lex_not(spark, folder):
    return _rounded(_lexical(spark, folder, R.Request(1, "relay -crawler")))


@query(f"WITH {_POSTS} SELECT 1::BIGINT AS qid, a.url, count(*) AS n FROM posts a JOIN posts b ON a.url = b.url AND b.pos = a.pos + 1 WHERE a.lexeme = 'bulletin' AND b.lexeme = 'board' GROUP BY a.url")
def lex_phrase(spark, folder):
    """Pages with the phrase, and how often they have it."""
    matched = _lexical(spark, folder, R.Request(1, '"bulletin board"')).select("qid", "url")
    posts = _posts(spark, folder, "bulletin", "board")
    next_to = Window.partitionBy("url").orderBy("pos")
    pairs = posts.withColumns({"l1": F.lead("lexeme").over(next_to), "p1": F.lead("pos").over(next_to)}).where((F.col("lexeme") == "bulletin") & (F.col("l1") == "board") & (F.col("p1") == F.col("pos") + 1))
    return matched.join(pairs.groupBy("url").agg(F.count(F.lit(1)).alias("n")), "url").select("qid", "url", "n")


@query(f"WITH {_POSTS} SELECT 1::BIGINT AS qid, url, round(sum(w)::DOUBLE, 5) AS rel FROM posts WHERE lexeme = 'relay' AND type = 'wiki' GROUP BY url")
def type_filter(spark, folder):
    return _rounded(_lexical(spark, folder, R.Request(1, "relay", "wiki")))


@query(f"WITH {_POSTS} SELECT 1::BIGINT AS qid, url, round(sum(w)::DOUBLE, 5) AS rel FROM posts WHERE lexeme = 'relay' GROUP BY url")
def lex_scanned(spark, folder):
    """The same without an index, from the pages themselves."""
    return _rounded(R.lexical(_pages(spark, folder), [R.Request(1, "relay")]))


@query(f"WITH {_POSTS} SELECT 1::BIGINT AS qid, url, 0.0::DOUBLE AS rel FROM p WHERE ok AND url NOT IN (SELECT url FROM posts WHERE lexeme = 'relay')")
def lex_only_not(spark, folder):
    return _lexical(spark, folder, R.Request(1, "-relay"))


_STEMS = "CASE WHEN lexeme IN ('route', 'routes', 'routed', 'routing', 'routings') THEN 'rout' WHEN lexeme IN ('table', 'tables', 'tabled', 'tabling') THEN 'tabl' WHEN lexeme IN ('relay', 'relays', 'relayed', 'relaying') THEN 'relay' END"


@query(f"WITH {_POSTS} SELECT 1::BIGINT AS qid, url, round(sum(w)::DOUBLE, 5) AS rel FROM posts WHERE {_STEMS} = 'relay' GROUP BY url")
def lex_stemmed(spark, folder):
    """Stems and stop words of English: all forms of a word match."""
    return _rounded(_lexical(spark, folder, R.Request(1, "the relays"), lexeme=english))


@query(f"""WITH {_POSTS}, n AS (SELECT url, {_STEMS} AS s, pos, w, lag({_STEMS}) OVER v AS l0, lag(pos) OVER v AS p0, lag(w) OVER v AS w0 FROM posts WHERE {_STEMS} IN ('rout', 'tabl') WINDOW v AS (PARTITION BY url ORDER BY pos))
SELECT 1::BIGINT AS qid, url, round(sum(2.0::DOUBLE / (1 / w::DOUBLE + 1 / w0::DOUBLE) / (pos - p0)), 6) AS rel FROM n WHERE l0 <> s GROUP BY url""")
def lex_stemmed_two(spark, folder):
    return _lexical(spark, folder, R.Request(1, "tables with a route"), lexeme=english)


_LEXICON = f"lexicon AS (SELECT lexeme AS word, count(DISTINCT url)::INT AS df FROM posts WHERE regexp_matches(lexeme, '^[a-z][a-z]{{2,29}}$') GROUP BY lexeme HAVING count(DISTINCT url) >= 2)"


@query(f"WITH {_POSTS}, {_LEXICON} SELECT word, df FROM lexicon")
def lexicon(spark, folder):
    return stored.index(spark, folder).lexicon(spark)


@query(f"WITH {_POSTS}, {_LEXICON}, old AS (SELECT 'x' || lower(hint) AS word, 7 AS df FROM name_hints UNION SELECT word, df + 1 FROM lexicon WHERE word < 'm') SELECT word, coalesce(l.df, o.df)::INT AS df FROM lexicon l FULL JOIN old o USING (word)")
def upsert_lexicon(spark, folder):
    """Counted anew from the pages; the old one has other counts and words that no page holds."""
    fresh = R.lexicon(_pages(spark, folder))
    gone = read(spark, folder, "name_hints").select(F.concat(F.lit("x"), F.lower("hint")).alias("word"), F.lit(7).alias("df")).where("word IS NOT NULL").distinct()
    old = gone.unionByName(fresh.where("word < 'm'").select("word", (F.col("df") + 1).alias("df")))
    return fold_lexicon(old, fresh).select("word", F.col("df").cast("int").alias("df"))


_ASKED = ["harbor staton", "antena on the roof", "battrey bank", "relay", "solr node", "routng tabel", "crawlers", "der neue ruter"]
_ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{q}')" for k, q in enumerate(_ASKED)) + ") v(qid, q))"
_G = "list_distinct(list_transform(range(1, length({c}) + 2), lambda i: substr('  ' || {c} || ' ', i, 3)))"
_NEAR = f"""tok AS (SELECT qid, unnest(regexp_extract_all(q, '[a-z0-9]+')) AS token, unnest(range(len(regexp_extract_all(q, '[a-z0-9]+')))) AS at_no FROM asked),
unknown AS (SELECT DISTINCT token, {_G.format(c='token')} AS g FROM tok WHERE length(token) >= 4 AND token NOT IN (SELECT word FROM lexicon)),
rated AS (SELECT token, word, df, len(list_intersect(g, {_G.format(c='word')})) / len(list_distinct(list_concat(g, {_G.format(c='word')}))) AS sim FROM unknown, lexicon),
near AS (SELECT * FROM rated WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY token ORDER BY sim DESC, df DESC, word) = 1)"""


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_ASKED)), "qid bigint, q string")


@query(f"WITH {_POSTS}, {_LEXICON}, {_ASKED_SQL}, {_NEAR} SELECT token, word, round(sim, 5) AS sim, df FROM near")
def nearest_words(spark, folder):
    known = stored.index(spark, folder).lexicon(spark)
    words = _asked(spark).select(F.explode(tokens(F.col("q"))).alias("token")).where(F.length("token") >= 4).distinct().join(known.select(F.col("word").alias("token")), "token", "left_anti")
    return neighbours(words, known).withColumn("sim", F.round("sim", 5))


@query(f"""WITH {_POSTS}, {_LEXICON}, {_ASKED_SQL}, {_NEAR}, fix AS (SELECT token, word FROM near WHERE sim >= 0.42 AND NOT starts_with(token, word) AND NOT starts_with(word, token))
SELECT qid, string_agg(coalesce(word, token), ' ' ORDER BY at_no) AS suggestion FROM tok LEFT JOIN fix USING (token) GROUP BY qid HAVING count(word) > 0""")
def suggest(spark, folder):
    return suggest_words(_asked(spark), stored.index(spark, folder).lexicon(spark))


# ------------------------------------------------------------------ vectors and fusion

_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_VECTORS = f"""{_LATEST}, q AS (SELECT row_number() OVER (ORDER BY id) - 1 AS qid, embedding AS v FROM (SELECT id, embedding FROM pages WHERE ok AND {_USABLE} ORDER BY id LIMIT 5)),
near AS (SELECT qid, url, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, url) - 1 AS rank
  FROM (SELECT qid, url, 1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS distance FROM p, q WHERE ok AND {_USABLE}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, url) <= 100)"""


def _requests(spark: SparkSession, folder: str, texts: list[str], types: list[str | None] | None = None) -> list[R.Request]:
    """Requests whose vectors are the first usable embeddings of the pages."""
    e = F.col("embedding")
    good = read(spark, folder, "pages").where(F.col("ok") & (F.size(e) == DEFAULT.embedding_dim) & ~F.exists(e, F.isnan) & F.exists(e, lambda x: x != 0))
    rows = good.orderBy("id").limit(len(texts)).select("embedding").collect()
    vectors = [tuple(float(x) for x in r["embedding"]) for r in rows]
    return [R.Request(k, q, types[k] if types else None, vector=vectors[k] if k < len(vectors) else None) for k, q in enumerate(texts)]


_EVERY = f"""{_LATEST}, q AS (SELECT id AS qid, embedding AS v FROM pages WHERE id % 20 = 0 AND {_USABLE}),
near AS (SELECT qid, url, 1 - list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS distance FROM p, q WHERE ok AND {_USABLE} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, url) <= 100)"""


@query(f"WITH {_EVERY} SELECT qid, count(*) AS n, round(max(distance), 5) AS last, round(sum(distance), 4) AS total FROM near GROUP BY qid")
def knn_cosine(spark, folder):
    """The nearest pages of every page whose id is divisible by 20; equals may stand in any order, so their distances are compared."""
    asked = read(spark, folder, "pages").where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    near = R.vector_neighbours(_pages(spark, folder), asked)
    return near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("distance"), 5).alias("last"), F.round(F.sum("distance"), 4).alias("total"))


@query(f"WITH {_VECTORS} SELECT qid, url, round(distance, 5) AS distance FROM near")
def knn_requests(spark, folder):
    """The nearest pages of a batch of requests."""
    asked = _requests(spark, folder, ["a"] * 5)
    return R.vector_candidates(_pages(spark, folder), asked).select("qid", "url", F.round("distance", 5).alias("distance"))


@query(f"WITH {_VECTORS} SELECT qid, false AS alike, count(*) AS n FROM near GROUP BY qid UNION ALL SELECT qid, true, 2 FROM q")
def uniform_guard(spark, folder):
    """Requests keep their candidates, but have none where all pages have the same vector, unless these are less than three."""
    asked, pages = _requests(spark, folder, ["a"] * 5), _pages(spark, folder)
    same = pages.withColumn("embedding", F.array(*[F.lit(float(k % 3 + 1)).cast("float") for k in range(DEFAULT.embedding_dim)]))
    count = lambda df, alike: df.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).withColumn("alike", F.lit(alike))
    return count(R.vector_candidates(pages, asked), False).unionByName(count(R.vector_candidates(same, asked), True)).unionByName(count(R.vector_candidates(same.where("ok").orderBy("url").limit(2), asked), True))


_LEX = _POSTS[len(_LATEST) + 2 :]
_LEXICAL = f"{_LEX}, lex AS (SELECT qid, url, round(sum(w)::DOUBLE, 6) AS rel FROM posts JOIN (VALUES (0::BIGINT, 'relay'), (1, 'antenna'), (2, 'library'), (3, 'crawler'), (4, 'battery')) v(qid, term) ON lexeme = term GROUP BY qid, url)"
_TERMS = ["relay", "antenna", "library", "crawler", "battery"]
_POOL = "pool AS (SELECT qid, url, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, url) - 1 AS rank FROM lex QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rel DESC, url) <= 145)"


@query(f"""WITH {_VECTORS}, {_LEXICAL}, {_POOL} SELECT qid, url, round(sum(1.0::DOUBLE / (61 + rank)), 5) AS fused FROM (SELECT qid, url, rank FROM pool UNION ALL SELECT qid, url, rank FROM near) GROUP BY qid, url""")
def rrf_fusion(spark, folder):
    pages, asked = _pages(spark, folder), _requests(spark, folder, _TERMS)
    words = R.top(R.lexical(pages, asked, index=stored.index(spark, folder)), [F.desc("rel"), F.col("url")], 145)
    return R.fuse(words, R.vector_candidates(pages, asked)).withColumn("fused", F.round("fused", 5))


@query(f"""WITH {_VECTORS}, {_LEXICAL}, {_POOL}, both_lists AS (SELECT qid, url, rel FROM pool UNION ALL SELECT qid, url, 0.0 FROM near WHERE rank < 25),
admitted AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, url) - 1 AS place FROM (SELECT qid, url, max(rel) AS rel FROM both_lists GROUP BY qid, url) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rel DESC, url) <= 145)
SELECT qid, url, round(rel, 5) AS rel, round(CASE WHEN rel > 0 THEN 1.0::DOUBLE / (61 + place) ELSE 0 END + coalesce(1.0::DOUBLE / (61 + near.rank), 0), 5) AS fused FROM admitted LEFT JOIN near USING (qid, url)""")
def vector_pull_gate(spark, folder):
    found = ranking.candidates(_pages(spark, folder), _requests(spark, folder, _TERMS), index=stored.index(spark, folder))
    return found.select("qid", "url", F.round("rel", 5).alias("rel"), F.round("fused", 5).alias("fused"))


# ------------------------------------------------------------------ scores and results


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with the word ``relay``, scored without vectors and previews: ``qid`` 1."""
    pages = _pages(spark, folder)
    rel = R.rank_any(_posts(spark, folder, "relay")).select(F.lit(1).cast("bigint").alias("qid"), F.lit("recent relay news").alias("q"), "url", "rel", F.lit(0.0).alias("fused"), F.lit(False).alias("vectors"), F.lit(False).alias("all_junk"))
    return _scored_of(spark, folder, rel, pages)


def _scored_of(spark: SparkSession, folder: str, rel: DataFrame, pages: DataFrame) -> DataFrame:
    nodes = read(spark, folder, "nodes").select(F.col("dest_hash").alias("node_hash"), "announce_count")
    clicks = D.clicks(D.click_events(spark, folder)).select("url", "clicks")
    rows = rel.join(pages, "url").join(nodes, "node_hash", "left").join(inbound_links(read(spark, folder, "links")).withColumnRenamed("to_url", "url"), "url", "left").join(clicks, "url", "left")
    return ranking.scored(rows, AS_OF)


_KIND = "CASE WHEN coalesce(inferred_type, type, '?') = 'file-index' AND coalesce(type, '?') IN ('news', 'article', 'blog', 'status', 'product', 'event') THEN 'file-index' ELSE coalesce(nullif(coalesce(type, '?'), ''), nullif(inferred_type, ''), 'index') END"
_SCORES = f"""inb AS (SELECT to_url AS url, count(*) AS n FROM links GROUP BY to_url), clk AS (SELECT p.url, count(*) AS n FROM events e JOIN pages p ON p.id = e.user_id WHERE e.event_type = 'click' GROUP BY p.url),
parts AS (SELECT p.*, rel, coalesce(inb.n, 0) AS inbound, coalesce(clk.n, 0) AS clicks, CASE WHEN coalesce(n.announce_count, 0) = 0 THEN 1 ELSE n.announce_count END AS announces, {_KIND} AS kind,
  coalesce(md_date, last_changed, p.first_seen, fetched_at) AS eff, relevance, lexical, penalty FROM rel JOIN p USING (url) LEFT JOIN nodes n ON n.dest_hash = p.node_hash LEFT JOIN inb USING (url) LEFT JOIN clk USING (url)),
s AS (SELECT url, title, node_hash, canonical, content_hash, round((relevance * (1 + 0.4 * coalesce(md_declared, false)::INT) * (1 + ln(1 + announces) * 0.1) * (1.15 - least(coalesce(fetch_ms, 3000), 15000) / 15000.0 * 0.30)
  * CASE WHEN eff IS NULL OR kind IN ('wiki', 'dataset', 'file-index', 'index') THEN 1.0::DOUBLE ELSE 1 + CASE kind WHEN 'news' THEN 1.0 WHEN 'status' THEN 0.9 WHEN 'article' THEN 0.55 WHEN 'blog' THEN 0.55 WHEN 'product' THEN 0.65 ELSE 0.2 END
    * pow(0.5, greatest((epoch_us(TIMESTAMPTZ '2025-07-01 00:00:00+00') - epoch_us(eff)) / 86400000000.0, 0) / CASE kind WHEN 'news' THEN 7 WHEN 'status' THEN 3 WHEN 'article' THEN 45 WHEN 'blog' THEN 45 WHEN 'product' THEN 30 ELSE 60 END) END
  * CASE kind WHEN 'news' THEN 1.35 WHEN 'article' THEN 1.15 WHEN 'blog' THEN 1.15 WHEN 'status' THEN 1.2 WHEN 'wiki' THEN 0.4 ELSE 1.0 END
  + CASE WHEN lexical THEN ln(1 + clicks) * 0.3 + ln(1 + inbound) * 0.2 ELSE 0 END) * penalty, 5) AS score FROM parts)"""
_SCORED = f"{_POSTS}, rel AS (SELECT url, sum(w)::DOUBLE AS rel, sum(w)::DOUBLE AS relevance, true AS lexical, 1.0 AS penalty FROM posts WHERE lexeme = 'relay' GROUP BY url), {_SCORES}"
_GATED = f"""{_POSTS}, found AS (SELECT url, sum(w)::DOUBLE AS w FROM posts WHERE lexeme = 'relay' GROUP BY url),
rel AS (SELECT p.url, coalesce(w, 0) AS rel, CASE WHEN embedding IS NOT NULL THEN 0.015::DOUBLE ELSE coalesce(w, 0) END AS relevance, coalesce(w, 0) > 0 OR embedding IS NULL AS lexical, CASE WHEN coalesce(title, '') LIKE '%a%' THEN 0.85::DOUBLE ELSE 1 END AS penalty FROM p LEFT JOIN found USING (url) WHERE ok), {_SCORES}"""


@query(f"WITH {_GATED} SELECT url, score FROM s")
def score_gates(spark, folder):
    """Every good page: with vectors those that words match and those that only their vectors bring in, without vectors all; some have nothing but junk to show."""
    pages = _pages(spark, folder).where("ok")
    words = R.rank_any(_posts(spark, folder, "relay"))
    rel = pages.select("url", F.col("embedding").isNotNull().alias("vectors"), F.coalesce("title", F.lit("")).like("%a%").alias("all_junk")).join(words, "url", "left")
    rel = rel.select(F.lit(1).cast("bigint").alias("qid"), F.lit("recent relay news").alias("q"), "url", F.coalesce("rel", F.lit(0.0)).alias("rel"), F.lit(0.015).alias("fused"), "vectors", "all_junk")
    return _scored_of(spark, folder, rel, pages).select("url", "score")


@query(f"WITH {_SCORED} SELECT url, score FROM s")
def score_stack(spark, folder):
    return _scored(spark, folder).select("url", "score")


_FOLDED = f"{_SCORED}, f AS (SELECT *, coalesce(nullif(canonical, ''), nullif(content_hash, ''), url) AS k FROM s), d AS (SELECT url, title, node_hash, score, nullif(count(*) OVER (PARTITION BY k) - 1, 0)::INT AS also_on FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, url) = 1)"


@query(f"WITH {_FOLDED} SELECT url, also_on FROM d")
def dedup_also_on(spark, folder):
    return results.folded(_scored(spark, folder).select("qid", "url", "node_hash", "canonical", "content_hash", "score")).select("url", "also_on")


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    folded = results.folded(_scored(spark, folder).select("qid", "url", "node_hash", "canonical", "content_hash", "score"))
    best = R.top(folded, [F.desc("score"), F.col("url")], DEFAULT.search_cap, "pos")
    return best.withColumn("pos", F.col("pos").cast("int"))


_PLACED = f"{_FOLDED}, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, url) - 1 AS pos FROM d QUALIFY row_number() OVER (ORDER BY score DESC, url) <= 60)"


@query(f"WITH {_PLACED} SELECT url, pos::INT AS pos, (SELECT count(*) FROM o) AS total FROM o WHERE pos BETWEEN 10 AND 19")
def paginate(spark, folder):
    return results.page_of(_placed(spark, folder), 10, 10).select("url", "pos", "total")


@query(f"""WITH {_PLACED}, l AS (SELECT node_hash, max(pos) FILTER (pos < 10) AS last_here, count(*) FILTER (pos >= 10) AS after FROM o GROUP BY node_hash)
SELECT url, CASE WHEN pos = last_here AND after > 0 THEN after END AS more_from_node FROM o LEFT JOIN l ON o.node_hash IS NOT DISTINCT FROM l.node_hash WHERE pos < 10""")
def more_from_node(spark, folder):
    return results.page_of(_placed(spark, folder), 0, 10).select("url", "more_from_node")


@query()
def crowding(spark, folder):
    """Reordered so that no node crowds a page; no SQL can say a greedy order."""
    return results.node_crowding(_placed(spark, folder).drop("pos")).select("url", "node_hash", "score", "pos")


_HITS = "hits AS (SELECT 1::BIGINT AS qid, row_number() OVER (ORDER BY doc_id) AS pos, source AS book, title AS path, title, lang AS book_title, left(text, 80) AS snippet FROM documents WHERE doc_type = 'wiki' ORDER BY doc_id LIMIT 18)"


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").where("doc_type = 'wiki'").orderBy("doc_id").limit(DEFAULT.federated_cap)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("doc_id"))  # eighteen rows
    return docs.select(F.lit(1).cast("bigint").alias("qid"), place.alias("pos"), F.col("source").alias("book"), F.col("title").alias("path"), "title", F.col("lang").alias("book_title"), F.left("text", F.lit(80)).alias("snippet"))


@query(f"""WITH {_PLACED}, {_HITS}, h AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY pos) - 1 AS i FROM hits), r AS (SELECT 'wiki:/page/read.mu#' || rtrim(replace(replace(base64(encode(book || chr(10) || path)), '+', '-'), '/', '_'), '=') AS url, title, round(0.8 * (n - i) / n, 5) AS score FROM h WHERE book <> '' AND path <> '')
SELECT r.url, r.title, round(score + ln(1 + coalesce(i.n, 0)) * 0.2, 5) AS score FROM r LEFT JOIN (SELECT to_url AS url, count(*) AS n FROM links GROUP BY to_url) i USING (url)
UNION ALL SELECT url, title, score FROM o""")
def federated_union(spark, folder):
    hits = federation.federated(_hits(spark, folder), "wiki")
    clicks = D.clicks(D.click_events(spark, folder))
    own = _placed(spark, folder).drop("pos").join(_pages(spark, folder).select("url", "title"), "url")
    return federation.merged(own, hits, read(spark, folder, "links"), clicks).select("url", "title", "score")


_FLAGSHIP = ["routing table", "recent news antenna", '"bulletin board" or "routing table"', "relay -crawler", "buy antenna", "library"]


@query()
def search(spark, folder):
    """Hybrid search for a batch of requests: words, vectors, fusion, scores, previews, folding and spreading."""
    asked = _requests(spark, folder, _FLAGSHIP, [None, None, None, None, "product", "wiki"])
    clicks = D.clicks(D.click_events(spark, folder))
    found = ranking.search(_pages(spark, folder), read(spark, folder, "nodes"), read(spark, folder, "links"), clicks, asked, AS_OF, index=stored.index(spark, folder))
    return results.page_of(results.node_crowding(results.folded(found)), 0, 10)
