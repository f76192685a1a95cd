"""Hits of another search service beside one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import encode_ref
from .graph import rank_bonus


def federated(hits: DataFrame, node: str = "") -> DataFrame:
    """Hits ``qid, pos, book, path, title, book_title, snippet`` as result rows, scored by their place among all hits; those without book or path are then dropped."""
    own = Window.partitionBy("qid")
    n, i = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy("pos")) - 1
    placed = hits.withColumns({"n": n, "i": i})
    ref = encode_ref(F.col("book"), F.col("path"))
    good = placed.where((F.coalesce("book", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""))
    return good.select(
        "qid", F.concat(F.lit(f"{node}:/page/read.mu#"), ref).alias("url"), F.lit(node).alias("node_hash"), F.lit("/page/read.mu").alias("path"), ref.alias("ref"),
        F.coalesce("title", F.lit("(untitled)")).alias("title"), F.lit("wiki").alias("type"), F.coalesce("book_title", F.lit("encyclopedia")).alias("node_name"),
        F.coalesce("snippet", F.lit("")).alias("description"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.lit(True).alias("md"),
        F.round(F.lit(0.8) * (F.col("n") - F.col("i")) / F.col("n"), 5).alias("score"),
    )


def merged(results: DataFrame, hits: DataFrame, links: DataFrame, clicks: DataFrame) -> DataFrame:
    """Own results and federated rows together; links to and clicks on the latter raise them too."""
    raised = hits.join(rank_bonus(hits, links, clicks), "url", "left")
    more = raised.withColumn("score", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 5)).drop("bonus")
    return results.unionByName(more, allowMissingColumns=True)
