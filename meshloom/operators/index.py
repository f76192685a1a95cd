"""An inverted index of the pages: written once, read only where a query's words lie.

A posting is a row a word and page with the places and weights of the word there. Postings lie in folders by a hash of the word
and are sorted by word within their files, so a query reads its words' folders, and of these the parts that hold the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analyzer import simple
from ..session import broadcast_if_small, materialise
from .retrieval import page_words


#: An index without any word has no file to tell this from.
POSTINGS = "url string, type string, lexeme string, at array<struct<pos:int,w:double>>, bucket int"


@dataclass(frozen=True)
class Index:
    """Where an index lies, into how many folders its words are parted, and the analyzer it was written with."""

    folder: str
    buckets: int
    lexeme: Callable[[str], str | None] = simple

    def postings(self, spark: SparkSession, words: tuple[str, ...]) -> DataFrame:
        """``url, type, lexeme, at`` of the given words, ``at`` being an array of places and weights in order."""
        rows = spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings")
        folders = [_bucket(F.lit(w), self.buckets) for w in words]
        return rows.where(F.col("bucket").isin(*folders) & F.col("lexeme").isin(*words)).select("url", "type", "lexeme", "at")

    def pages(self, spark: SparkSession) -> DataFrame:
        """``url, type`` of all pages of the index."""
        return spark.read.parquet(f"{self.folder}/pages")

    def lexicon(self, spark: SparkSession, min_df: int = 2) -> DataFrame:
        """``word, df`` of the words of three to thirty letters that at least ``min_df`` pages hold."""
        return spark.read.parquet(f"{self.folder}/lexicon").where(F.col("df") >= min_df)


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def build(pages: DataFrame, folder: str, lexeme: Callable[[str], str | None] = simple, buckets: int = 64, parts: int = 4) -> Index:
    """Writes the index of the good pages (one row a url). Each folder is written in ``parts`` parts by page, so a word that most pages hold isn't one task's.

    The analyzer is asked once for each distinct word, and its answers joined back; words without a lexeme (stop words) are left out, their places stay taken.
    """
    words = page_words(pages).select("url", "type", F.inline("words"))
    if lexeme is not simple:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(known=[lexeme(w) for w in b["lexeme"]])

        known = words.select("lexeme").distinct().mapInPandas(run, "lexeme string, known string").where("known IS NOT NULL")
        words = words.join(broadcast_if_small(materialise(known), 500_000), "lexeme").select("url", "type", F.col("known").alias("lexeme"), "pos", "w")
    placed = words.withColumns({"bucket": _bucket(F.col("lexeme"), buckets), "part": F.pmod(F.xxhash64("url"), F.lit(parts))}).repartition("bucket", "part")
    # grouped where it lies: the rows of a word and page are in one part already
    posts = placed.groupBy("bucket", "part", "lexeme", "url").agg(F.first("type").alias("type"), F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("at"))
    posts.drop("part").sortWithinPartitions("bucket", "lexeme", "url").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    pages.where("ok").select("url", "type").write.mode("overwrite").parquet(f"{folder}/pages")
    spark = pages.sparkSession
    counted = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").where(F.col("lexeme").rlike("^[a-z][a-z]{2,29}$")).groupBy(F.col("lexeme").alias("word")).agg(F.count(F.lit(1)).cast("int").alias("df"))
    counted.write.mode("overwrite").parquet(f"{folder}/lexicon")
    return Index(folder, buckets, lexeme)
