"""From fetched markup to pages and links, and the batches that a crawl runs on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import markup
from ..functions import text as X
from ..functions.declared import declared, list_field, structural_type
from . import graph, retrieval, upserts

#: A fetched page is cut to this many bytes.
MAX_PAGE_BYTES = 512 * 1024

Fetcher = Callable[[str, str], tuple[bytes | None, int]]
Embedder = Callable[[list[str]], list[list[float] | None]]


def fetch(items: DataFrame, fetcher: Fetcher) -> DataFrame:
    """``url, node_hash, path, raw, fetch_ms, ok`` of the claimed queue items; a page that can't be had has ok false.

    ``fetcher(node_hash, path)`` gives the bytes, or none, and the milliseconds it took; it runs in the workers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [fetcher(n, p) for n, p in zip(b["node_hash"], b["path"])]
            raw = [None if data is None else data[:MAX_PAGE_BYTES] for data, _ in got]
            yield pd.DataFrame({"url": b["url"], "node_hash": b["node_hash"], "path": b["path"], "raw": raw, "fetch_ms": [ms for _, ms in got], "ok": [r is not None for r in raw]})

    wanted = items.where(~X.is_binary(F.col("path"))).select("url", "node_hash", "path")
    return wanted.mapInPandas(run, "url string, node_hash string, path string, raw binary, fetch_ms int, ok boolean")


def extract(fetched: DataFrame, as_of: datetime) -> DataFrame:
    """Page rows (without ids and embeddings) of the good fetches ``url, node_hash, path, raw, fetch_ms, ok``; ``raw`` may be bytes or text.

    What a page declares goes before what its structure shows; a page that declares nothing of its type is an index.
    """
    raw = F.col("raw").cast("string")
    read = fetched.where("ok").withColumns({"text_": raw, "md": declared(raw), "shown": structural_type(raw)})
    md = lambda key: F.try_element_at(F.col("md"), F.lit(key))
    has = F.size("md") > 0
    return read.select(
        "url", "node_hash", "path", F.coalesce(md("title"), markup.title(F.col("text_"))).alias("title"), markup.to_text(F.col("text_")).alias("content"),
        F.sha2(F.col("raw").cast("binary"), 256).alias("content_hash"), F.octet_length("raw").cast("int").alias("bytes"), F.lit(True).alias("ok"), F.lit(as_of).cast("timestamp").alias("fetched_at"),
        F.when(has, F.coalesce(md("type"), F.lit("index"))).otherwise(F.coalesce("shown", F.lit("index"))).alias("type"), md("description").alias("description"), md("lang").alias("lang"),
        list_field(md("tags")).alias("tags"), has.alias("md_declared"), "fetch_ms", X.effective_declared_date(md("updated"), md("published"), md("date"), as_of).alias("md_date"),
        X.trimmed(md("canonical"), 10_000).alias("canonical"), markup.headings(F.col("text_")).alias("headings"), F.coalesce("shown", F.when(~has, F.lit("index"))).alias("inferred_type"),
        X.parse_price(md("price")).cast("decimal(12,2)").alias("price"), X.trimmed(md("currency"), 8).alias("currency"), X.trimmed(md("availability"), 32).alias("availability"),
        X.trimmed(md("sku"), 64).alias("sku"), X.trimmed(md("vendor"), 120).alias("vendor"), X.trimmed(md("shop"), 64).alias("shop_dest"),
    )


def embed(pages: DataFrame, embedder: Embedder, dim: int = DEFAULT.embedding_dim) -> DataFrame:
    """``url, embedding`` of the pages with some text. Answers that aren't usable vectors become null, and the page is tried again later."""
    source = X.embedding_prompt(X.embedding_source(F.col("title"), F.col("description"), F.col("headings"), F.col("content")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"url": b["url"], "embedding": embedder(list(b["prompt"]))})

    raw = pages.select("url", source.alias("prompt")).where(F.col("prompt").isNotNull()).mapInPandas(run, "url string, embedding array<float>")
    return raw.select("url", F.when(X.usable_vector(F.col("embedding"), dim), F.col("embedding")).alias("embedding"))


def found_links(fetched: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The links of the good fetches, and what they add to the queue ``node_hash, path, priority``."""
    links = markup.extract_links(fetched.where("ok").withColumn("raw", F.col("raw").cast("string")))
    own = F.substring_index("from_url", ":", 1)
    rank = X.priority(own, F.col("to_node_hash"), F.lit(False), config.seed_nodes)
    queue = links.where(X.may_enqueue(F.col("to_path"))).select(F.col("to_node_hash").alias("node_hash"), F.col("to_path").alias("path"), rank.alias("priority"))
    return links, queue


def linked_nodes(fetched: DataFrame, as_of: datetime) -> DataFrame:
    """``dest_hash, name, ts`` as from announces without a name: the other nodes that the good fetches link to, once for each link that may be crawled."""
    links, _ = found_links(fetched)
    own = F.substring_index("from_url", ":", 1)
    other = links.where(X.may_enqueue(F.col("to_path")) & ~F.col("to_node_hash").eqNullSafe(own))
    return other.select(F.col("to_node_hash").alias("dest_hash"), F.lit(None).cast("string").alias("name"), F.lit(as_of).cast("timestamp").alias("ts"))


def maintenance(tables: dict[str, DataFrame], as_of: datetime, config: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """What the hourly sweep changes: stale nodes to queue again, the lexicon, anchors, and pages that need an embedding. ``tables`` are snapshots by name."""
    pages, links = tables["pages"], tables["links"]
    return {
        "crawl_queue": upserts.enqueue_recrawl(tables["nodes"], tables["crawl_queue"], as_of, config.recrawl_hours),
        "lexicon": upserts.upsert_lexicon(tables["lexicon"], retrieval.lexicon(pages, config.min_document_frequency)),
        "anchors": upserts.refresh_anchors(pages, graph.anchors(links)).where("changed").select("url", "anchors"),
        "embeddings": pages.where(F.col("ok") & F.col("embedding").isNull()).select("url", "title", "description", "headings", "content"),
    }
