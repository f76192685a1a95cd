"""Link graph: inbound counts, anchor texts, popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inbound_links(links: DataFrame) -> DataFrame:
    """``to_url, inbound``: rows of links to each url."""
    return links.where(F.col("to_url").isNotNull()).groupBy("to_url").agg(F.count(F.lit(1)).alias("inbound"))


def anchors(links: DataFrame, most: int = 2000) -> DataFrame:
    """``to_url, anchors``: the distinct labels of links to each url, in order, parted by blanks, at most ``most`` characters.

    Labels are made distinct by an aggregation of their own first, so a url that a third of all links
    name with one label brings one row. Of the distinct labels only those that can reach the cut are
    gathered: each takes a character and a blank at least, so the first ``most`` of them do.
    """
    label = F.trim("label")
    distinct = links.where(F.col("to_url").isNotNull() & (label != "")).select("to_url", label.alias("label")).distinct()
    # first per part of the labels, then per url: no group holds more than the cut can show, times the parts
    part = distinct.groupBy("to_url", F.pmod(F.xxhash64("label"), F.lit(32)).alias("part")).agg(F.slice(F.array_sort(F.collect_list("label")), 1, most).alias("some"))
    whole = part.groupBy("to_url").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, most).alias("all"))
    return whole.select("to_url", F.left(F.array_join("all", " "), F.lit(most)).alias("anchors"))


def popularity(inbound: Column, clicks: Column, inbound_weight: float = 0.2, click_weight: float = 0.3) -> Column:
    zero = F.lit(0)
    return F.log1p(F.coalesce(inbound, zero)) * F.lit(inbound_weight) + F.log1p(F.coalesce(clicks, zero)) * F.lit(click_weight)


def rank_bonus(urls: DataFrame, links: DataFrame, clicks: DataFrame) -> DataFrame:
    """``url, bonus`` of each given url, whether or not it is a page."""
    found = urls.select("url").distinct().join(inbound_links(links).withColumnRenamed("to_url", "url"), "url", "left").join(clicks.select("url", "clicks"), "url", "left")
    return found.select("url", F.round(popularity(F.col("inbound"), F.col("clicks")), 5).alias("bonus"))
