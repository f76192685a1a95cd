"""Scores of search candidates, and the search itself for a batch of requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as X
from ..functions.analyzer import simple
from ..functions.querylang import parse
from ..session import broadcast_if_small, materialise
from . import retrieval as R
from .graph import inbound_links, popularity
from .snippets import headline, pick


#: Candidates of a batch of requests that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def multipliers(declared: Column, announces: Column, fetch_ms: Column, of_type: Column, effective: Column, query: Column, as_of: datetime) -> Column:
    """Declared metadata, trust in the node, responsiveness, freshness and the query's intent, multiplied."""
    schema = F.lit(1.0) + F.lit(0.4) * F.coalesce(declared, F.lit(False)).cast("int")
    known = F.when(F.coalesce(announces, F.lit(0)) == 0, F.lit(1)).otherwise(announces)
    trust = F.lit(1.0) + F.log1p(known) * F.lit(0.1)
    waited = F.least(F.coalesce(fetch_ms, F.lit(3000)), F.lit(15000))
    quick = F.lit(1.15) - waited / F.lit(15000.0) * F.lit(0.30)
    return schema * trust * quick * X.freshness(of_type, effective, as_of) * X.intent_multiplier(query, of_type)


def scored(candidates: DataFrame, as_of: datetime, config: EngineConfig = DEFAULT) -> DataFrame:
    """Adds ``score`` to candidates ``q, rel, fused, vectors, all_junk`` with their pages' columns.

    Popularity counts only for what matched by words, or where there were no vectors at all: else a page
    much linked to would come up for everything its vector is near.
    """
    shown = F.coalesce("type", F.lit("?"))
    kind = X.rank_type(shown, F.coalesce("inferred_type", "type", F.lit("?")))
    date = X.effective_date(F.col("md_date"), F.col("last_changed"), F.col("first_seen"), F.col("fetched_at"))
    relevance = F.when(F.col("vectors"), F.col("fused")).otherwise(F.col("rel"))
    base = relevance * multipliers(F.col("md_declared"), F.col("announce_count"), F.col("fetch_ms"), kind, date, F.col("q"), as_of)
    lexical = (F.col("rel") > 0) | ~F.col("vectors")
    bonus = F.when(lexical, popularity(F.col("inbound"), F.col("clicks"), config.inbound_weight, config.click_weight)).otherwise(F.lit(0.0))
    penalty = F.when(F.col("all_junk"), F.lit(config.junk_penalty)).otherwise(F.lit(1.0))
    return candidates.withColumn("score", F.round((base + bonus) * penalty, 5)).withColumn("date", F.date_format(date, "yyyy-MM-dd"))


def candidates(pages: DataFrame, requests: list[R.Request], config: EngineConfig = DEFAULT, lexeme=simple, limit: int | None = None, index=None) -> DataFrame:
    """``qid, url, rel, fused, vectors``: what words match, with what vectors alone pull in, cut to a pool by ``rel``."""
    spark = pages.sparkSession
    pool = max(limit or config.search_cap, config.vector_topk) + config.vector_pull + 20
    words = R.top(R.lexical(pages, requests, lexeme, index), [F.desc("rel"), F.col("url")], pool)
    near = R.vector_candidates(pages, requests, config)
    live = near.select("qid").distinct().withColumn("vectors", F.lit(True))
    types = spark.createDataFrame([(r.qid, r.ptype) for r in requests], "qid bigint, ptype string")
    kinds = pages.where("ok").select("url", "type")
    # of the nearest few, those of another type than asked for are dropped, but keep their places in the list
    pulled = near.where(F.col("rank") < config.vector_pull).join(F.broadcast(types), "qid").join(kinds, "url").where(F.col("ptype").isNull() | (F.col("type") == F.col("ptype"))).select("qid", "url")
    both = words.select("qid", "url", "rel").unionByName(pulled.withColumn("rel", F.lit(0.0)))
    admitted = R.top(both.groupBy("qid", "url").agg(F.max("rel").alias("rel")), [F.desc("rel"), F.col("url")], pool, "place")
    matched = admitted.where(F.col("rel") > 0).select("qid", "url", F.col("place").alias("rank"))
    fused = R.fuse(matched, near.select("qid", "url", "rank"), config.rrf_k)
    out = admitted.join(fused, ["qid", "url"], "left").join(F.broadcast(live), "qid", "left")
    return out.select("qid", "url", "rel", F.coalesce("fused", F.lit(0.0)).alias("fused"), F.coalesce("vectors", F.lit(False)).alias("vectors"))


def search(pages: DataFrame, nodes: DataFrame, links: DataFrame, clicks: DataFrame, requests: list[R.Request], as_of: datetime, config: EngineConfig = DEFAULT, lexeme=simple, limit: int | None = None, index=None) -> DataFrame:
    """Ranked results of a batch of requests, ``limit`` (60 by default) of each at most.

    ``pages`` holds one row a url, ``clicks`` too; ``index`` is an index of the same pages, by ``lexeme``. Blank requests have no result. Previews are made only for the
    candidates left after the pool is cut.
    """
    spark = pages.sparkSession
    limit = limit or config.search_cap
    live = [r for r in requests if r.q and r.q.strip()]
    queries = {r.qid: parse(r.q, lexeme) for r in live}
    asked = spark.createDataFrame([(r.qid, r.q) for r in live], "qid bigint, q string")
    # candidates are at most a pool a request: they're written, so what follows reads them and not the tables again, and the
    # large tables are cut down to them before anything is aggregated
    found = materialise(candidates(pages, live, config, lexeme, limit, index)).join(F.broadcast(asked), "qid")
    urls = broadcast_if_small(found.select("url").distinct(), BROADCAST_ROWS)
    pool = pages.join(urls, "url", "left_semi")
    inbound = inbound_links(links.join(urls.withColumnRenamed("url", "to_url"), "to_url", "left_semi")).withColumnRenamed("to_url", "url")
    registry = nodes.select(F.col("dest_hash").alias("node_hash"), F.col("name").alias("node_name"), "announce_count")
    rows = found.join(pool, "url").join(registry, "node_hash", "left").join(inbound, "url", "left").join(clicks.join(urls, "url", "left_semi").select("url", "clicks"), "url", "left")
    rows = rows.withColumn("raw_headline", headline(F.col("content"), F.col("qid"), queries, lexeme))
    snippet, junk = pick(F.col("raw_headline"), F.col("description"), F.coalesce("title", F.lit("(untitled)")), config.junk_ratio)
    ranked = scored(rows.withColumn("snippet", snippet).withColumn("all_junk", junk), as_of, config)
    best = R.top(ranked, [F.desc("score"), F.col("url")], limit)
    return best.select(
        "qid", "rank", "url", "node_hash", "path", F.coalesce("title", F.lit("(untitled)")).alias("title"), F.coalesce("type", F.lit("?")).alias("type"),
        F.coalesce("node_name", F.lit("")).alias("node_name"), F.coalesce("md_declared", F.lit(False)).alias("md"), F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        "snippet", "date", "content_hash", "canonical", F.col("price").cast("double").alias("price"), "currency", "availability", "sku", "vendor", F.col("shop_dest").alias("shop"), "score",
    )
