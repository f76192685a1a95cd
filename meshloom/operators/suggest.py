"""Spelling suggestions from the words of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.text import tokens
from ..functions.trigram import trigrams


def similar(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """``a, b, sim`` of the words ``a`` and ``b`` that share a trigram, through a join on trigrams; words that share none have no row. ``more`` columns of ``b`` are kept."""
    grams = lambda df, c, n, *own: df.select(c, *own, trigrams(F.col(c)).alias("g")).select(c, *own, F.size("g").alias(n), F.explode("g").alias("gram"))
    pairs = grams(left, "a", "n").join(grams(right, "b", "m", *more), "gram").groupBy("a", "b", "n", "m", *more).agg(F.count(F.lit(1)).alias("both"))
    return pairs.select("a", "b", *more, (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("sim"))


def neighbours(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``token, word, sim, df``: the word of the lexicon most similar to each given token, of equals the more frequent, then the first by letters.

    The tokens' side is as small as the queries.
    """
    rated = similar(words.select(F.col("token").alias("a")), lexicon.select(F.col("word").alias("b"), "df"), "df").where(F.col("sim") >= 0.3)
    best = rated.groupBy("a").agg(F.min_by(F.struct(F.col("b").alias("word"), "sim", "df"), F.struct(-F.col("sim"), -F.col("df"), F.col("b"))).alias("x"))
    return best.select(F.col("a").alias("token"), "x.*")


def suggest(queries: DataFrame, lexicon: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """``qid, suggestion`` for the queries ``qid, q`` in which some word of four letters or more isn't known but resembles one that is.

    A word isn't corrected to its own beginning or to a longer form of itself, as the lexicon may hold stems.
    """
    words = queries.select("qid", F.posexplode(tokens(F.col("q"))).alias("at", "token"))
    unknown = words.where(F.length("token") >= 4).select("token").distinct().join(lexicon.select(F.col("word").alias("token")), "token", "left_anti")
    near = neighbours(unknown, lexicon).where(F.col("sim") >= config.min_similarity)
    fixes = near.where(~F.startswith("token", F.col("word")) & ~F.startswith("word", F.col("token"))).select("token", "word")
    put = words.join(fixes, "token", "left")
    whole = put.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("word", "token").alias("w")))).alias("ws"), F.count("word").alias("fixed"))
    return whole.where(F.col("fixed") > 0).select("qid", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("suggestion"))
