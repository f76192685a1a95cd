"""Queries of the registry, traffic, click and search rollups, of scalars, and of state changes, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AS_OF, EVENTS_AS_OF
from ..functions import text as X
from ..operators import analytics as A
from ..operators import graph as G
from ..operators import upserts as U
from ..operators.suggest import similar
from ..sources import derived as D
from ..sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def stamp(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c if isinstance(c, str) else "at")


_AS_OF = "TIMESTAMPTZ '2025-07-01 00:00:00+00'"
_EVENTS = "TIMESTAMPTZ '2025-01-20 00:00:00+00'"
_STAMP = "strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS {c}"
_QUEUE = f"""
queue AS (
  SELECT to_url AS url, split_part(to_url, ':', 1) AS node_hash, substr(to_url, strpos(to_url, ':') + 1) AS path, least(count(*) - 1, 4)::INT AS attempts,
         {_AS_OF} + INTERVAL 1 HOUR * (least(count(*) - 1, 4) - 1) AS next_attempt, CASE WHEN to_url LIKE '%/page/index.mu' THEN 3 ELSE 6 END AS priority
  FROM links WHERE regexp_matches(to_url, '^[0-9a-f]{{16,64}}:/page/') AND to_url NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY to_url
)"""
_CLICKED = "clicked AS (SELECT e.ts, p.url FROM events e JOIN pages p ON p.id = e.user_id WHERE e.event_type = 'click')"
_SEARCHES = r"""
searches AS (
  SELECT * FROM (SELECT doc_id AS id, fetched_at AS ts, left(trim(regexp_replace(lower(title), '[\s\p{Z}]+', ' ', 'g')), 200) AS q, (doc_id % 4)::INT AS results FROM documents WHERE title IS NOT NULL) WHERE q <> ''
)"""


@query(f"""WITH {_QUEUE}
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE reachable) AS reachable, (SELECT count(*) FROM nodes WHERE reachable IS FALSE) AS unreachable,
  (SELECT count(*) FROM pages WHERE ok) AS pages, (SELECT count(*) FROM pages WHERE md_declared) AS md_declared, (SELECT count(*) FROM pages WHERE fetched_at > {_AS_OF} - INTERVAL 24 HOUR) AS fetched_24h,
  (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM queue WHERE next_attempt <= {_AS_OF}) AS queue_due, (SELECT count(*) FROM queue) AS queue_total""")
def stats_overview(spark, folder):
    return A.stats(read(spark, folder, "nodes"), read(spark, folder, "pages"), read(spark, folder, "links"), D.crawl_queue(spark, folder, AS_OF), AS_OF)


@query("SELECT coalesce(type, '(none)') AS type, count(*) AS n FROM pages WHERE ok GROUP BY 1")
def categories(spark, folder):
    return A.categories(read(spark, folder, "pages"))


@query(f"SELECT id, url, coalesce(title, '(untitled)') AS title, coalesce(type, '?') AS type, node_hash, {_STAMP.format(c='fetched_at')} FROM (SELECT * FROM pages WHERE ok ORDER BY fetched_at DESC, id LIMIT 25)")
def recent_pages(spark, folder):
    return A.recent_pages(read(spark, folder, "pages")).select("id", "url", "title", "type", "node_hash", stamp("fetched_at"))


@query(f"SELECT dest_hash, coalesce(name, '') AS name, coalesce(announce_count, 0) AS announce_count, {_STAMP.format(c='last_seen')} FROM (SELECT * FROM nodes ORDER BY coalesce(announce_count, 0) DESC, last_seen DESC NULLS LAST, dest_hash LIMIT 15)")
def top_nodes(spark, folder):
    return A.top_nodes(read(spark, folder, "nodes")).select("dest_hash", "name", "announce_count", stamp("last_seen"))


@query(f"SELECT count(*) AS views, count(DISTINCT vid) AS visitors, count(*) FILTER (ts > {_EVENTS} - INTERVAL 24 HOUR) AS views_24h FROM page_events")
def rum_stats(spark, folder):
    return A.rum_stats(read(spark, folder, "page_events"), EVENTS_AS_OF)


@query("SELECT node, count(*) AS views, count(DISTINCT vid) AS visitors FROM page_events GROUP BY node ORDER BY views DESC, node LIMIT 20")
def rum_by_node(spark, folder):
    return A.rum_by_node(read(spark, folder, "page_events"))


@query("SELECT node, path, count(*) AS views, count(DISTINCT vid) AS visitors FROM page_events GROUP BY node, path ORDER BY views DESC, node, path LIMIT 20")
def rum_top_pages(spark, folder):
    return A.rum_top_pages(read(spark, folder, "page_events"))


@query(f"SELECT strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS views, count(DISTINCT vid) AS visitors FROM page_events WHERE ts > {_EVENTS} - INTERVAL 336 HOUR GROUP BY 1")
def rum_by_day(spark, folder):
    return A.rum_by_day(read(spark, folder, "page_events"), EVENTS_AS_OF).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT count(*) FILTER (embedding IS NULL) AS missing, count(embedding) AS present FROM pages WHERE ok")
def embedding_backlog(spark, folder):
    return A.embedding_backlog(read(spark, folder, "pages"))


@query("SELECT id, url, title FROM pages WHERE ok AND embedding IS NULL ORDER BY id LIMIT 20")
def pages_needing_embedding(spark, folder):
    return A.pages_needing_embedding(read(spark, folder, "pages"))


@query(f"WITH {_CLICKED} SELECT count(*) AS clicks, count(*) FILTER (ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR) AS clicks_24h, count(DISTINCT url) AS urls FROM clicked")
def click_event_stats(spark, folder):
    from datetime import datetime, timezone

    return A.click_event_stats(D.click_events(spark, folder), datetime(2024, 1, 31, tzinfo=timezone.utc))


@query(f"WITH {_CLICKED} SELECT url, n, strftime(last, '%Y-%m-%d %H:%M:%S') AS last FROM (SELECT url, count(*) AS n, max(ts) AS last FROM clicked GROUP BY url ORDER BY n DESC, last DESC, url LIMIT 15)")
def top_clicked(spark, folder):
    return A.top_clicked(D.click_events(spark, folder)).select("url", "n", stamp("last"))


@query(f"WITH {_SEARCHES} SELECT count(*) AS searches, count(*) FILTER (ts > {_AS_OF} - INTERVAL 24 HOUR) AS searches_24h, count(*) FILTER (results = 0) AS zero_results FROM searches")
def search_stats(spark, folder):
    return A.search_stats(D.searches(spark, folder), AS_OF)


@query(f"WITH {_SEARCHES} SELECT q, count(*) AS n, max(results) AS results FROM searches GROUP BY q ORDER BY n DESC, max(ts) DESC, q LIMIT 15")
def top_searches(spark, folder):
    return A.top_searches(D.searches(spark, folder))


@query(f"WITH {_SEARCHES} SELECT q, count(*) AS n FROM searches WHERE results = 0 GROUP BY q ORDER BY n DESC, max(ts) DESC, q LIMIT 15")
def zero_result_searches(spark, folder):
    return A.zero_result_searches(D.searches(spark, folder))


@query("WITH v AS (SELECT node, count(*) AS views, count(DISTINCT vid) AS visitors FROM page_events GROUP BY node) SELECT *, greatest(floor(views * 120 / (SELECT max(views) FROM v))::INT, 3) AS px FROM v")
def bar_scaling(spark, folder):
    return A.scaled(A.views_by(read(spark, folder, "page_events"), ["node"]), "views", 120, 3)


@query("SELECT to_url, count(*) AS inbound FROM links WHERE to_url IS NOT NULL GROUP BY to_url")
def inbound_links(spark, folder):
    return G.inbound_links(read(spark, folder, "links"))


@query("SELECT to_url, left(string_agg(l, ' ' ORDER BY l), 2000) AS anchors FROM (SELECT DISTINCT to_url, trim(label) AS l FROM links WHERE to_url IS NOT NULL AND trim(label) <> '') GROUP BY to_url")
def anchors(spark, folder):
    return G.anchors(read(spark, folder, "links"))


@query(f"""WITH {_CLICKED}, c AS (SELECT url, count(*) AS n FROM clicked GROUP BY url), i AS (SELECT to_url AS url, count(*) AS n FROM links GROUP BY to_url)
SELECT u.url, round(ln(1 + coalesce(i.n, 0)) * 0.2 + ln(1 + coalesce(c.n, 0)) * 0.3, 5) AS bonus FROM (SELECT DISTINCT url FROM pages) u LEFT JOIN c ON u.url = c.url LEFT JOIN i ON u.url = i.url""")
def rank_bonus(spark, folder):
    return G.rank_bonus(read(spark, folder, "pages").select("url"), read(spark, folder, "links"), D.clicks(D.click_events(spark, folder)))


# ------------------------------------------------------------------ scalars


@query(r"""SELECT doc_id, q, CASE WHEN q <> '' THEN left(sha256(q), 16) END AS hash
FROM (SELECT doc_id, left(trim(regexp_replace(lower(title), '[\s\p{Z}]+', ' ', 'g')), 200) AS q FROM documents)""")
def query_hash(spark, folder):
    docs = read(spark, folder, "documents")
    return docs.select("doc_id", X.normalize_query(F.col("title")).alias("q"), X.query_hash(F.col("title")).alias("hash"))


@query("SELECT id, left(sha256('visitor:' || nullif(vid, '')), 16) AS vid FROM page_events")
def visitor_hash(spark, folder):
    return read(spark, folder, "page_events").select("id", X.visitor_id(F.col("vid")).alias("vid"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, folder):
    return read(spark, folder, "documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@query(r"""SELECT id, raw, CASE WHEN v >= 0 AND v < 10000000 THEN v END AS value
FROM (SELECT id, raw, TRY_CAST(nullif(regexp_extract(replace(raw, ',', '.'), '[-+]?\d{1,9}(?:\.\d{1,2})?'), '') AS DOUBLE) AS v FROM (SELECT id, concat_ws(' ', price::VARCHAR, currency, sku) AS raw FROM pages))""")
def parse_price(spark, folder):
    pages = read(spark, folder, "pages").select("id", F.concat_ws(" ", F.col("price").cast("string"), "currency", "sku").alias("raw"))
    return pages.select("id", "raw", X.parse_price(F.col("raw")).alias("value"))


@query(r"""SELECT id, nullif(left(trim(currency), 8), '') AS currency, nullif(left(trim(availability), 32), '') AS availability, nullif(left(trim(sku), 64), '') AS sku, nullif(left(trim(vendor), 120), '') AS vendor, nullif(left(trim(shop_dest), 64), '') AS shop FROM pages""")
def trimmed_fields(spark, folder):
    t = lambda c, n, name=None: X.trimmed(F.col(c), n).alias(name or c)
    return read(spark, folder, "pages").select("id", t("currency", 8), t("availability", 32), t("sku", 64), t("vendor", 120), t("shop_dest", 64, "shop"))


_DATED = r"""
SELECT doc_id, raw, CASE WHEN full_part <> '' THEN try_strptime(left(full_part, 10) || ' ' || substr(full_part, 12, 5) || CASE WHEN length(full_part) > 16 THEN substr(full_part, 17) ELSE ':00' END, '%Y-%m-%d %H:%M:%S')
  WHEN day_part <> '' THEN try_strptime(day_part, '%Y-%m-%d') END AS d
FROM (SELECT *, regexp_extract(raw, '^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?') AS full_part, regexp_extract(raw, '^(\d{4}-\d{2}-\d{2})(?:\W|$)', 1) AS day_part
  FROM (SELECT doc_id, unnest([regexp_extract(text, '\d{4}-\d{2}-\d{2}[^\n]{0,9}'), strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%d') || 'T25:61', strftime(fetched_at AT TIME ZONE 'UTC', '%Y-%m-%d') || 'T10:30:00Z']) AS raw FROM documents))"""


@query(f"SELECT doc_id, raw, strftime(CASE WHEN d >= TIMESTAMP '2015-01-01' AND d <= TIMESTAMP '2025-07-02' THEN d END, '%Y-%m-%d %H:%M:%S') AS declared FROM ({_DATED})")
def parse_declared_date(spark, folder):
    """The first date in every text, and the day of every fetch with a time that can't be and with one that can."""
    day = F.date_format("fetched_at", "yyyy-MM-dd")
    raws = F.array(F.regexp_extract("text", r"\d{4}-\d{2}-\d{2}[^\n]{0,9}", 0), F.concat(day, F.lit("T25:61")), F.concat(day, F.lit("T10:30:00Z")))
    rows = read(spark, folder, "documents").select("doc_id", F.explode(raws).alias("raw"))
    return rows.select("doc_id", "raw", F.date_format(X.parse_declared_date(F.col("raw"), AS_OF), "yyyy-MM-dd HH:mm:ss").alias("declared"))


_RANK_TYPE = "CASE WHEN inferred_type = 'file-index' AND type IN ('news', 'article', 'blog', 'status', 'product', 'event') THEN inferred_type ELSE coalesce(nullif(type, ''), nullif(inferred_type, ''), 'index') END"


@query(f"SELECT id, {_RANK_TYPE} AS rank_type FROM pages")
def rank_type(spark, folder):
    return read(spark, folder, "pages").select("id", X.rank_type(F.col("type"), F.col("inferred_type")).alias("rank_type"))


_FRESH = f"""
SELECT id, kind, d, CASE WHEN d IS NULL OR kind IN ('wiki', 'dataset', 'file-index', 'index') THEN 1.0 ELSE
  1 + CASE kind WHEN 'news' THEN 1.0 WHEN 'status' THEN 0.9 WHEN 'article' THEN 0.55 WHEN 'blog' THEN 0.55 WHEN 'product' THEN 0.65 ELSE 0.2 END
  * pow(0.5, greatest((epoch_us({_AS_OF}) - epoch_us(d)) / 86400000000.0, 0) / CASE kind WHEN 'news' THEN 7 WHEN 'status' THEN 3 WHEN 'article' THEN 45 WHEN 'blog' THEN 45 WHEN 'product' THEN 30 ELSE 60 END) END AS f
FROM (SELECT id, {_RANK_TYPE} AS kind, coalesce(md_date, last_changed, first_seen, fetched_at) AS d FROM pages)"""


@query(f"SELECT id, strftime(d AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, round(f, 5) AS freshness FROM ({_FRESH})")
def freshness(spark, folder):
    pages = read(spark, folder, "pages")
    date = X.effective_date(F.col("md_date"), F.col("last_changed"), F.col("first_seen"), F.col("fetched_at"))
    kind = X.rank_type(F.col("type"), F.col("inferred_type"))
    return pages.select("id", F.date_format(date, "yyyy-MM-dd").alias("date"), F.round(X.freshness(kind, date, AS_OF), 5).alias("freshness"))


@query(r"""SELECT id, coalesce(CASE WHEN type = 'product' AND list_has_any(w, ['buy', 'shop', 'price', 'prices', 'store', 'sale', 'purchase', 'cheap', 'order']) THEN 1.5 END,
  CASE WHEN list_has_any(w, ['recent', 'latest', 'new', 'newest', 'today', 'news', 'breaking', 'now', 'current']) THEN CASE type WHEN 'news' THEN 1.35 WHEN 'article' THEN 1.15 WHEN 'blog' THEN 1.15 WHEN 'status' THEN 1.2 WHEN 'wiki' THEN 0.4 END END, 1.0)::DOUBLE AS intent
FROM (SELECT id, type, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS w FROM pages)""")
def intent(spark, folder):
    return read(spark, folder, "pages").select("id", X.intent_multiplier(F.coalesce("title", F.lit("")), F.col("type")).alias("intent"))


@query(r"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[\x{2500}-\x{25FF}]')) / length(text) ELSE 0 END, 6) AS junk FROM documents")
def junk_ratio(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.round(X.junk_ratio(F.col("text")), 6).alias("junk"))


#: Endings put behind real paths, so that both kinds are met: downloads, look-alikes, and none.
_ENDINGS = ["", ".pdf", ".EPUB", ".zip", ".gz", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".mp3", ".ogg", ".opus", ".mp4", ".bin", ".tar", ".7z", ".rar", ".exe", ".pdf.mu", "epub", "/read.mu"]
_VARIED = f"SELECT DISTINCT to_url, coalesce(to_path, '') || e AS path FROM links, (SELECT unnest({_ENDINGS!r}) AS e)"
_DOWNLOAD = "(starts_with(lower(path), '/file/') OR " + " OR ".join(f"ends_with(lower(path), '{e}')" for e in (".pdf", ".epub", ".zip", ".gz", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".mp3", ".ogg", ".opus", ".mp4", ".bin", ".tar")) + ")"


def _varied(spark: SparkSession, folder: str) -> DataFrame:
    """The targets of all links, each path also with the endings above."""
    ends = F.explode(F.array(*[F.lit(e) for e in _ENDINGS])).alias("e")
    return read(spark, folder, "links").select("to_url", "to_path", ends).select("to_url", F.concat(F.coalesce("to_path", F.lit("")), "e").alias("path")).distinct()


@query(f"SELECT to_url, path, {_DOWNLOAD} AS binary_path, NOT {_DOWNLOAD} AND NOT ends_with(path, '/read.mu') AS queued FROM ({_VARIED})")
def binary_paths(spark, folder):
    return _varied(spark, folder).select("to_url", "path", X.is_binary(F.col("path")).alias("binary_path"), X.may_enqueue(F.col("path")).alias("queued"))


@query("SELECT id, coalesce(concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(headings, ''), nullif(content, '')), '') AS source, 'search_document: ' || left(nullif(trim(concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(headings, ''), nullif(content, ''))), ''), 2500) AS prompt FROM pages")
def embedding_prompts(spark, folder):
    source = X.embedding_source(F.col("title"), F.col("description"), F.col("headings"), F.col("content"))
    return read(spark, folder, "pages").select("id", source.alias("source"), X.embedding_prompt(source).alias("prompt"))


@query("SELECT id, embedding IS NOT NULL AND len(embedding) = 64 AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AS usable FROM pages")
def usable_vectors(spark, folder):
    return read(spark, folder, "pages").select("id", F.coalesce(X.usable_vector(F.col("embedding"), 64), F.lit(False)).alias("usable"))


@query("SELECT id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v FROM pages WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x)))")
def rounded_vectors(spark, folder):
    e = F.col("embedding")
    return read(spark, folder, "pages").where(e.isNotNull() & ~F.exists(e, F.isnan)).select("id", X.rounded_vector(e).alias("v"))


_SEEDS = ("66e1eb653dc1abeb01280004a4d5f447", "dbe92ec82f53c8ceedbb75d26dafc62d")


@query(f"""SELECT DISTINCT from_url, to_url, CASE WHEN to_path = '/page/index.mu' AND to_node_hash IN {_SEEDS} THEN 1 WHEN to_node_hash IN {_SEEDS} OR split_part(from_url, ':', 1) IN {_SEEDS} THEN 2 WHEN to_path = '/page/index.mu' THEN 3 ELSE 6 END AS priority
FROM links WHERE to_node_hash <> '' AND to_path <> ''""")
def link_priority(spark, folder):
    links = read(spark, folder, "links").where((F.col("to_node_hash") != "") & (F.col("to_path") != ""))
    rank = X.priority(F.substring_index("from_url", ":", 1), F.col("to_node_hash"), F.col("to_path") == "/page/index.mu", frozenset(_SEEDS))
    return links.select("from_url", "to_url", rank.alias("priority")).distinct()


@query(r"SELECT DISTINCT source, title, rtrim(replace(replace(base64(encode(source || chr(10) || title)), '+', '-'), '/', '_'), '=') AS ref FROM documents WHERE title IS NOT NULL")
def encoded_refs(spark, folder):
    docs = read(spark, folder, "documents").where(F.col("title").isNotNull())
    return docs.select("source", "title", X.encode_ref(F.col("source"), F.col("title")).alias("ref")).distinct()


_GRAMS = "list_distinct(list_transform(range(1, length({c}) + 2), lambda i: substr('  ' || {c} || ' ', i, 3)))"


@query(f"""WITH h AS (SELECT DISTINCT lower(hint) AS w, {_GRAMS.format(c='lower(hint)')} AS g FROM name_hints)
SELECT a.w AS a, b.w AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 5) AS sim FROM h a JOIN h b ON a.w < b.w WHERE len(list_intersect(a.g, b.g)) > 0""")
def trigram_similarity(spark, folder):
    words = read(spark, folder, "name_hints").select(F.lower("hint").alias("a")).distinct()
    pairs = similar(words, words.withColumnRenamed("a", "b")).where(F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round("sim", 5).alias("sim"))


# ------------------------------------------------------------------ changes of state


@query(f"""WITH b AS (SELECT node AS dest_hash, min(ts) AS b_first, max(ts) AS b_last, count(*) AS b_n, max({{'ts': ts, 'name': repeat(path, 12)}}) FILTER (nullif(vid, '') IS NOT NULL AND path IS NOT NULL) AS named FROM page_events WHERE node IS NOT NULL GROUP BY node)
SELECT dest_hash, coalesce(left(named.name, 200), name) AS name, strftime(coalesce(first_seen, b_first) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(coalesce(b_last, last_seen) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_seen,
  (coalesce(announce_count, 0) + coalesce(b_n, 0))::INT AS announce_count, reachable FROM nodes FULL JOIN b USING (dest_hash)""")
def upsert_nodes(spark, folder):
    """Views stand for announces: those of a known visitor have a name, often a long one, the others have none."""
    name = F.when(F.nullif("vid", F.lit("")).isNotNull(), F.repeat("path", F.lit(12)))
    announces = read(spark, folder, "page_events").select(F.col("node").alias("dest_hash"), name.alias("name"), "ts")
    return U.upsert_nodes(read(spark, folder, "nodes"), announces).select("dest_hash", "name", stamp("first_seen"), stamp("last_seen"), "announce_count", "reachable")


@query(f"""WITH {_CLICKED} SELECT url, (2 * count(*))::BIGINT AS clicks, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_clicked FROM clicked GROUP BY url""")
def upsert_clicks(spark, folder):
    events = D.click_events(spark, folder)
    return U.upsert_clicks(D.clicks(events), events).select("url", "clicks", stamp("last_clicked"))


@query(f"""WITH old AS (SELECT url, first(content_hash ORDER BY fetched_at, id) AS h, first(last_changed ORDER BY fetched_at, id) AS changed, first(coalesce(first_seen, fetched_at) ORDER BY fetched_at, id) AS seen, first(embedding ORDER BY fetched_at, id) AS e FROM pages WHERE url IS NOT NULL GROUP BY url),
 new AS (SELECT url, last(content_hash ORDER BY fetched_at, id) AS h, last(title ORDER BY fetched_at, id) AS title FROM pages WHERE url IS NOT NULL GROUP BY url)
SELECT url, new.title, new.h AS content_hash, CASE WHEN old.h IS DISTINCT FROM new.h THEN '2025-07-01 00:00:00' ELSE strftime(changed AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS last_changed, strftime(seen AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_seen FROM old JOIN new USING (url)""")
def upsert_pages(spark, folder):
    pages = read(spark, folder, "pages").where(F.col("url").isNotNull()).withColumn("first_seen", F.coalesce("first_seen", "fetched_at"))
    own = [c for c in pages.columns if c != "url"]
    oldest = pages.groupBy("url").agg(F.min_by(F.struct(*own), F.struct("fetched_at", "id")).alias("x")).select("url", "x.*")
    return U.record_pages(oldest, D.latest_pages(pages).select(*oldest.columns), AS_OF).select("url", "title", "content_hash", stamp("last_changed"), stamp("first_seen"))


@query("""WITH old AS (SELECT from_url, to_url, max(nullif(label, '')) AS label, arg_min({'h': to_node_hash, 'p': to_path}, {'h': to_node_hash, 'p': to_path}) AS x FROM links GROUP BY ALL),
 seen AS (SELECT from_url, CASE WHEN label LIKE '%a%' THEN to_url ELSE to_url || '#again' END AS to_url, to_node_hash, to_path, CASE WHEN label LIKE '%e%' THEN upper(label) ELSE '' END AS label FROM links),
 new AS (SELECT from_url, to_url, max(nullif(label, '')) AS label FROM seen GROUP BY ALL)
SELECT from_url, to_url, coalesce(new.label, old.label) AS label FROM old FULL JOIN new USING (from_url, to_url)""")
def upsert_links(spark, folder):
    """Every page is read again: some links have another label now, some none, and some lead elsewhere."""
    links = read(spark, folder, "links")
    old = U.record_links(links.limit(0), links)
    to = F.when(F.col("label").like("%a%"), F.col("to_url")).otherwise(F.concat("to_url", F.lit("#again")))
    label = F.when(F.col("label").like("%e%"), F.upper("label")).otherwise("")
    again = links.select("from_url", to.alias("to_url"), "to_node_hash", "to_path", label.alias("label"))
    return U.record_links(old, again).select("from_url", "to_url", "label")


_NEW_TARGETS = f"SELECT DISTINCT split_part(to_url, ':', 1) AS node_hash, substr(to_url, strpos(to_url, ':') + 1) || e AS path, to_url || e AS url FROM links, (SELECT unnest(['', '.epub', '.7z', '/read.mu']) AS e) WHERE to_url LIKE '%:/page/%'"


@query(f"""WITH {_QUEUE} SELECT url, node_hash, path FROM ({_NEW_TARGETS}) WHERE NOT {_DOWNLOAD} AND NOT ends_with(path, '/read.mu') AND url NOT IN (SELECT url FROM queue) AND url NOT IN (SELECT url FROM pages WHERE ok AND fetched_at > {_AS_OF} - INTERVAL 720 HOUR)""")
def enqueue_fresh(spark, folder):
    links = read(spark, folder, "links").where(F.col("to_url").like("%:/page/%"))
    ends = links.select("to_url", F.explode(F.array(*[F.lit(e) for e in ("", ".epub", ".7z", "/read.mu")])).alias("e"))
    path = F.concat(F.regexp_extract("to_url", "(?s)^[^:]*:(.*)$", 1), "e")
    targets = ends.select(F.substring_index("to_url", ":", 1).alias("node_hash"), path.alias("path"), F.lit(5).alias("priority")).where(X.may_enqueue(F.col("path")))
    return U.enqueue(D.crawl_queue(spark, folder, AS_OF), targets, read(spark, folder, "pages"), AS_OF, 720).select("url", "node_hash", "path")


@query(f"WITH {_QUEUE} SELECT url, priority, attempts FROM queue WHERE next_attempt <= {_AS_OF} ORDER BY priority, next_attempt, url LIMIT 50")
def claim_due(spark, folder):
    return U.claim_due(D.crawl_queue(spark, folder, AS_OF), AS_OF, 50).select("url", "priority", "attempts")


@query(f"WITH {_QUEUE} SELECT url, attempts + 1 AS attempts, strftime(({_AS_OF} + INTERVAL 1 HOUR * (attempts + 1)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS next_attempt FROM queue WHERE attempts < 4")
def backoff(spark, folder):
    queue = D.crawl_queue(spark, folder, AS_OF)
    return U.reschedule(queue, queue, AS_OF).select("url", "attempts", stamp("next_attempt"))


_ANNOUNCED = "announced AS (SELECT lower(dest_hash) || ':/page/index.mu' AS url FROM nodes WHERE announce_count > 3)"


def _queue_after_announces(spark: SparkSession, folder: str) -> DataFrame:
    """The queue with the index pages of the nodes announced often."""
    queue = D.crawl_queue(spark, folder, AS_OF)
    often = read(spark, folder, "nodes").where("announce_count > 3").select(F.lower("dest_hash").alias("node_hash"), F.lit("/page/index.mu").alias("path"), F.lit(3).alias("priority"))
    return queue.unionByName(U.enqueue(queue, often, read(spark, folder, "pages"), AS_OF, 24))


@query(f"""WITH {_QUEUE}, {_ANNOUNCED} SELECT dest_hash AS node_hash, lower(dest_hash) || ':/page/index.mu' AS url FROM nodes WHERE (last_crawled IS NULL OR last_crawled < {_AS_OF} - INTERVAL 24 HOUR)
  AND lower(dest_hash) || ':/page/index.mu' NOT IN (SELECT url FROM queue UNION ALL SELECT url FROM announced)""")
def recrawl_stale(spark, folder):
    return U.enqueue_recrawl(read(spark, folder, "nodes"), _queue_after_announces(spark, folder), AS_OF).select("node_hash", "url")


@query(f"WITH {_QUEUE}, {_ANNOUNCED} SELECT url, priority FROM queue UNION ALL SELECT url, 3 FROM announced WHERE url NOT IN (SELECT url FROM queue)")
def enqueue_announced(spark, folder):
    return _queue_after_announces(spark, folder).select("url", "priority")


@query(f"WITH {_QUEUE} SELECT url, attempts FROM queue WHERE url NOT IN (SELECT to_url FROM links WHERE label LIKE '%a%')")
def drop_queue(spark, folder):
    """The queue after the targets of some links were fetched."""
    done = read(spark, folder, "links").where(F.col("label").like("%a%")).select(F.col("to_url").alias("url"))
    return U.drop_queue(D.crawl_queue(spark, folder, AS_OF), done).select("url", "attempts")


@query(f"""WITH {_QUEUE}, held AS (SELECT url FROM queue WHERE next_attempt <= {_AS_OF} ORDER BY priority, next_attempt, url LIMIT 50)
SELECT url, attempts, strftime((CASE WHEN url IN (SELECT url FROM held) THEN {_AS_OF} + INTERVAL 75 SECOND ELSE next_attempt END) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS next_attempt FROM queue""")
def lease_due(spark, folder):
    queue = D.crawl_queue(spark, folder, AS_OF)
    return U.lease(queue, U.claim_due(queue, AS_OF, 50), AS_OF).select("url", "attempts", stamp("next_attempt"))


@query("""WITH v AS (SELECT id, first(embedding ORDER BY id) AS e FROM (SELECT p.id, q.embedding FROM pages p JOIN pages q ON p.content_hash = q.content_hash WHERE p.embedding IS NULL AND q.embedding IS NOT NULL AND len(q.embedding) = 64) GROUP BY id)
SELECT id, embedding IS NOT NULL AS before, coalesce(len(v.e), len(embedding))::INT AS size FROM pages LEFT JOIN v USING (id)""")
def set_embeddings(spark, folder):
    """Pages without an embedding get that of a page of the same content."""
    pages = read(spark, folder, "pages")
    known = pages.where("embedding IS NOT NULL AND size(embedding) = 64").groupBy("content_hash").agg(F.min_by("embedding", "id").alias("embedding"))
    vectors = pages.where("embedding IS NULL").select("id", "content_hash").join(known, "content_hash").select("id", "embedding")
    put = U.set_embeddings(pages, vectors).select("id", F.size("embedding").alias("size"))
    return put.join(pages.select("id", F.col("embedding").isNotNull().alias("before")), "id").select("id", "before", F.when(F.col("size") >= 0, F.col("size")).alias("size"))


@query(f"""WITH d AS ({_DATED}), v AS (SELECT doc_id, raw, CASE WHEN d >= TIMESTAMP '2015-01-01' AND d <= TIMESTAMP '2025-07-02' THEN d END AS d FROM d),
k AS (SELECT doc_id, max(d) FILTER (raw LIKE '%T25:61') AS a, max(d) FILTER (raw NOT LIKE '%T25:61' AND raw NOT LIKE '%T10:30:00Z') AS b, max(d) FILTER (raw LIKE '%T10:30:00Z') AS c FROM v GROUP BY doc_id)
SELECT doc_id, strftime(coalesce(a, b, c), '%Y-%m-%d %H:%M:%S') AS declared FROM k""")
def effective_declared_date(spark, folder):
    """``updated`` holds a time that can't be, ``published`` the first date in the text, ``date`` the time of the fetch."""
    day = F.date_format("fetched_at", "yyyy-MM-dd")
    declared = X.effective_declared_date(F.concat(day, F.lit("T25:61")), F.regexp_extract("text", r"\d{4}-\d{2}-\d{2}[^\n]{0,9}", 0), F.concat(day, F.lit("T10:30:00Z")), AS_OF)
    return read(spark, folder, "documents").select("doc_id", F.date_format(declared, "yyyy-MM-dd HH:mm:ss").alias("declared"))


@query(f"SELECT dest_hash, coalesce(x.ok, reachable) AS reachable, CASE WHEN x.ok IS NOT NULL THEN '2025-07-01 00:00:00' ELSE strftime(last_crawled AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') END AS last_crawled FROM nodes LEFT JOIN (SELECT node_hash, bool_or(ok) AS ok FROM pages GROUP BY 1) x ON node_hash = dest_hash")
def mark_crawled(spark, folder):
    tried = read(spark, folder, "pages").where(F.col("node_hash").isNotNull()).groupBy(F.col("node_hash").alias("dest_hash")).agg(F.bool_or("ok").alias("reachable"))
    return U.mark_crawled(read(spark, folder, "nodes"), tried, AS_OF).select("dest_hash", "reachable", stamp("last_crawled"))


@query("""WITH a AS (SELECT to_url AS url, left(string_agg(l, ' ' ORDER BY l), 2000) AS new FROM (SELECT DISTINCT to_url, trim(label) AS l FROM links WHERE trim(label) <> '') GROUP BY to_url)
SELECT p.id, coalesce(new, anchors) AS anchors, new IS NOT NULL AND new IS DISTINCT FROM anchors AS changed FROM pages p LEFT JOIN a USING (url)""")
def refresh_anchors(spark, folder):
    pages = read(spark, folder, "pages")
    names = G.anchors(read(spark, folder, "links")).select(F.col("to_url").alias("url"), F.col("anchors").alias("new"))
    both = pages.select("id", "url", F.col("anchors").alias("old")).join(names, "url", "left")
    return both.select("id", F.coalesce("new", "old").alias("anchors"), (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


@query("SELECT id, left(node, 64) AS node, left(repeat(path, 12), 200) AS path, nullif(vid, '') AS vid FROM page_events WHERE node <> '' AND path <> ''")
def record_events(spark, folder):
    events = read(spark, folder, "page_events").withColumn("path", F.repeat("path", F.lit(12)))  # some paths are then too long
    return U.record_events(events).select("id", "node", "path", "vid")


@query(f"WITH {_SEARCHES} SELECT q, results, [q] AS shown_urls FROM searches")
def impressions(spark, folder):
    return U.record_searches(D.searches(spark, folder)).select("q", "results", "shown_urls")
