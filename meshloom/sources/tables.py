"""Logical tables and where they are read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


NODES = _struct(dest_hash=S, name=S, first_seen=TS, last_seen=TS, announce_count=I, last_crawled=TS, reachable=B)
PAGES = _struct(
    id=L, url=S, node_hash=S, path=S, title=S, content=S, content_hash=S, bytes=I, ok=B, fetched_at=TS,
    type=S, description=S, lang=S, tags=T.ArrayType(S), md_declared=B, fetch_ms=I, first_seen=TS,
    last_changed=TS, md_date=TS, canonical=S, headings=S, inferred_type=S, anchors=S,
    price=T.DecimalType(12, 2), currency=S, availability=S, sku=S, vendor=S, shop_dest=S,
    embedding=T.ArrayType(T.FloatType()),
)
LINKS = _struct(from_url=S, to_url=S, to_node_hash=S, to_path=S, label=S)
CRAWL_QUEUE = _struct(url=S, node_hash=S, path=S, enqueued_at=TS, attempts=I, next_attempt=TS, priority=I)
CLICKS = _struct(url=S, clicks=L, last_clicked=TS)
PAGE_EVENTS = _struct(id=L, ts=TS, node=S, path=S, vid=S)
SEARCHES = _struct(id=L, ts=TS, q=S, results=I, suggested=B, shown_urls=T.ArrayType(S))
LEXICON = _struct(word=S, df=I)
CLICK_EVENTS = _struct(id=L, ts=TS, query_hash=S, url=S)
RAW_PAGES = _struct(node_hash=S, path=S, raw=S, fetched_at=TS, fetch_ms=I)
QUERIES = _struct(qid=L, q=S, ptype=S, limit=I, offset=I)

SCHEMAS = {
    "nodes": NODES, "pages": PAGES, "links": LINKS, "crawl_queue": CRAWL_QUEUE, "clicks": CLICKS,
    "page_events": PAGE_EVENTS, "searches": SEARCHES, "lexicon": LEXICON, "click_events": CLICK_EVENTS,
    "raw_pages": RAW_PAGES, "queries": QUERIES,
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a snapshot folder; zone-less timestamps are taken as UTC."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    plain = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def register(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> None:
    """Temporary views of a snapshot, for ``spark.sql``."""
    for table in tables:
        read(spark, folder, table).createOrReplaceTempView(table)


def write_snapshot(df: DataFrame, folder: str, table: str, version: int) -> str:
    """Writes a new version of a table beside the older ones and returns its path. Readers of an older version aren't disturbed."""
    path = f"{folder}/{table}/v={version:012d}"
    df.write.mode("overwrite").parquet(path)
    return path
