"""From ranked rows to pages of results: copies folded, nodes spread, slices and notes."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig


def folded(results: DataFrame) -> DataFrame:
    """One row of each group of copies of a query, the best, with ``also_on`` counting the others.

    Copies share a canonical url or else a content hash; rows with neither stand alone. Rows without a url are dropped.
    """
    filled = lambda c: F.nullif(c, F.lit(""))
    key = F.coalesce(filled("canonical"), filled("content_hash"), F.col("url"))
    rest = [c for c in results.columns if c not in ("qid", "url")]
    best = F.min_by(F.struct("url", *rest), F.struct(-F.col("score"), F.col("url"))).alias("x")  # of equal scores the smaller url wins
    groups = results.where(F.col("url").isNotNull()).groupBy("qid", key.alias("__key")).agg(best, F.count(F.lit(1)).alias("n"))
    return groups.select("qid", "x.*", F.when(F.col("n") > 1, F.col("n") - 1).cast("int").alias("also_on"))


def spread(nodes: list, cap: int, window: int) -> list[int]:
    """An order of places in which no more than ``cap`` of any ``window + 1`` in a row share a node, as long as others are left; the best goes first."""
    waiting: dict = {}
    for place, node in enumerate(nodes):
        waiting.setdefault(node, deque()).append(place)
    recent: deque = deque()
    held: dict = {}
    out = []
    while waiting:
        free = [q[0] for node, q in waiting.items() if held.get(node, 0) < cap]
        place = min(free) if free else min(q[0] for q in waiting.values())
        node = nodes[place]
        waiting[node].popleft()
        if not waiting[node]:
            del waiting[node]
        out.append(place)
        recent.append(node)
        held[node] = held.get(node, 0) + 1
        if len(recent) > window:
            held[recent.popleft()] -= 1
    return out


def node_crowding(results: DataFrame, cap: int = DEFAULT.node_cap, window: int = DEFAULT.page_size) -> DataFrame:
    """Adds ``pos`` from 0: each query's rows (at most some dozens) reordered so that no node crowds a page. Nothing is dropped."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "url"], ascending=[False, True], kind="stable").reset_index(drop=True)
        order = spread([None if pd.isna(n) else n for n in rows["node_hash"]], cap, window)
        pos = pd.Series(range(len(order)), index=order, dtype="int32")
        return rows.assign(pos=pos.sort_index())

    schema = ", ".join(f"`{c}` {t}" for c, t in results.dtypes) + ", pos int"
    return results.groupBy("qid").applyInPandas(run, schema)


def page_of(results: DataFrame, offset: int = 0, limit: int = DEFAULT.page_size, config: EngineConfig = DEFAULT) -> DataFrame:
    """One slice of each query's rows by ``pos``, with ``total``, and ``more_from_node`` on the last row of each node that has more further down."""
    size, start = min(max(limit or config.page_size, 1), config.page_size_max), max(offset or 0, 0)
    by_node, by_query = Window.partitionBy("qid", "node_hash"), Window.partitionBy("qid")
    on_page = (F.col("pos") >= start) & (F.col("pos") < start + size)
    counted = results.withColumns(
        {
            "total": F.count(F.lit(1)).over(by_query),
            "after": F.count_if(F.col("pos") >= start + size).over(by_node),
            "last_here": F.max(F.when(on_page, F.col("pos"))).over(by_node),
        }
    )
    more = F.when((F.col("pos") == F.col("last_here")) & (F.col("after") > 0), F.col("after"))
    return counted.where(on_page).withColumn("more_from_node", more).drop("after", "last_here", "content_hash", "canonical")
