"""Trigram similarity of words, as used for spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """The distinct trigrams of each word, with two blanks before it and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 for two texts without any."""
    x, y = trigrams(a), trigrams(b)
    whole = F.size(F.array_union(x, y))
    return F.when(whole > 0, F.size(F.array_intersect(x, y)) / whole).otherwise(F.lit(0.0))
