"""Result previews: highlighted passages of a page's text, junk passed over."""

from __future__ import annotations

import re
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.querylang import Query
from ..functions.text import junk_ratio

#: Marks around highlighted words in results, and between passages.
ON, OFF, NEXT = "\x01", "\x02", "\x03"
_WORD = re.compile(r"\w+")


def passages(text: str, words: frozenset[str], lexeme=lambda w: w, fragments: int = 3, most: int = 28, least: int = 10) -> list[str]:
    """Up to ``fragments`` passages of at most ``most`` words, those with most different query words first, with the words marked.

    Without any query word in the text the first ``least`` words are given.
    """
    spans = [(m.start(), m.end(), lexeme(m[0].lower()) in words) for m in _WORD.finditer(text)]
    hits = [k for k, s in enumerate(spans) if s[2]]
    if not spans:
        return []
    if not hits:
        return [text[: spans[min(least, len(spans)) - 1][1]]]
    windows, k = [], 0
    while k < len(hits):
        end = k
        while end + 1 < len(hits) and hits[end + 1] - hits[k] < most:
            end += 1
        spare = max(0, least - (hits[end] - hits[k] + 1)) // 2 + 2
        first = max(0, hits[k] - spare)
        last = min(len(spans) - 1, max(hits[end] + spare, first + least - 1), first + most - 1)
        found = {lexeme(text[spans[h][0] : spans[h][1]].lower()) for h in hits[k : end + 1]}
        windows.append((-len(found), first, last))
        k = end + 1
    out = []
    for _, first, last in sorted(sorted(windows)[:fragments], key=lambda w: w[1]):
        pieces, at = [], spans[first][0]
        for a, b, hit in spans[first : last + 1]:
            pieces += [text[at:a], f"{ON}{text[a:b]}{OFF}" if hit else text[a:b]]
            at = b
        out.append("".join(pieces).strip())
    return out


def headline(content: Column, qid: Column, queries: dict[int, Query], lexeme=lambda w: w) -> Column:
    """The passages of a content for its query, parted by ``NEXT``. Meant for the few candidates of a query, not for whole tables."""
    words = {k: frozenset(q.wanted) for k, q in queries.items()}

    @F.pandas_udf("string")
    def run(texts: pd.Series, ids: pd.Series) -> pd.Series:
        one = partial(passages, lexeme=lexeme)
        return pd.Series([NEXT.join(one(t or "", words.get(k, frozenset()))) for t, k in zip(texts, ids)])

    return run(content, qid)


def pick(raw: Column, description: Column, title: Column, limit: float = 0.20) -> tuple[Column, Column]:
    """The first passage that isn't junk, or else description or title; and whether junk was all there was."""
    plain = lambda x: F.translate(x, ON + OFF, "")
    parts = F.filter(F.split(raw, NEXT), lambda x: F.trim(x) != "")
    good = F.try_element_at(F.filter(parts, lambda x: junk_ratio(plain(x)) <= limit), F.lit(1))
    filled = lambda c: F.nullif(c, F.lit(""))
    instead = F.trim(F.coalesce(filled(description), filled(title), F.lit("")))
    return F.coalesce(F.trim(good), instead), good.isNull() & (F.size(parts) > 0)
