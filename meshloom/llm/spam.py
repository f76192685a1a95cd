"""Pages of repeated keywords, product tags, keyword filler or bare links instead of sentences.

Each line is measured once: characters, words, function words, separators, the share of its most
frequent other word, distinct word pairs, and the part of it that is links. Lines too short to say anything are measured
together with the short lines beside them, and a line that a page repeats is marked. What is too much or too little
of each is calibrated per language from all lines of the corpus that hold enough function words. A page is spam if the
greater part of its characters stands in lines that fail. Function words are those of public lists of fourteen languages; lines of
other languages, known by short words that no list of theirs explains, or by their script, aren't judged by function words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .words import LISTS, function_words, other_script

LANGUAGES = tuple(LISTS)


@dataclass(frozen=True)
class SpamConfig:
    """``share``: part of a page's characters in failing lines from which it is spam. ``of_median``: a line fails below this part
    of the median share of function words in its language. ``min_words``: shorter lines say nothing about function words. ``top_word``, ``pairs``: a line
    of few function words fails from so many times the share of the most frequent word that one in a hundred sentences of its language has,
    and from so many times the share of repeated word pairs. ``separators``: the same of the gaps between words that
    separators fill; such a line is a list of tags. ``min_lines``: lines that a language is calibrated on at least; others have the limits of
    all languages together, or with too few lines in all those of ``fallback``: function words, top word, pairs that differ, separators.
    ``links``: part of a line that is links from which it fails. ``words_a_line``: words a line up to which
    a run of short lines of few function words is one of keywords; longer ones may be titles or names. ``list_run``: lines in a row that make a list; ``list_lines``: lines of lists that a page of links has at least."""

    share: float = 0.5
    of_median: float = 0.25
    fallback: tuple[float, float, float, float] = (0.05, 0.22, 0.5, 0.5)
    min_lines: int = 200
    min_words: int = 8
    top_word: float = 1.75
    top_words: int = 14
    pairs: float = 2.0
    separators: float = 2.5
    links: float = 0.6
    words_a_line: float = 1.5
    list_run: int = 6
    list_lines: int = 6


_WORD = re.compile(r"[^\W\d_]+")
#: A link's address: a node's hash and a path, or a url of the web.
_ADDRESS = re.compile(r"(?:\b[0-9a-fA-F]{16,64}:/\S*|(?<!\w):/page/\S*|\bhttps?://\S+)")
_SEPARATOR = re.compile(r"[|·•;,/+~&*#>]+|\s[-–—]\s")
_ENDS = (".", "!", "?", "…", ":", ";", '."', '!"', '?"')
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
#: A list's marker, and a number with its unit.
_MARKER = re.compile(r"^(?:[*•\-–+]|\(?\d{1,3}[.):])\s+")
_READING = re.compile(r"\d\s*(?:%|°|[^\W\d_]{1,3}\b)|\d\D+\d")
#: Short lines have fewer words than a line's function words are judged by; so often a line of a page is a repeated one.
_SHORT, _REPEATED = 8, 3
#: Words from which a line may hold two languages.
_LONG = 30
#: Bits of each language's count in one whole number, so that a line's counts are one sum.
_FIELD, _MOST = 24, (1 << 24) - 1
#: Short words that no list of the line's language has, from which part of its words, and from how many different ones, the line is of another.
_SHORT_LETTERS, _FOREIGN_SHARE, _FOREIGN_WORDS = 2, 0.08, 2
_FIELDS = ["chars", "words", "lang", "function", "top", "pairs", "foreign", "separators", "links", "listed", "repeated", "run_lines", "run_words", "run_lang", "run_function", "run_top", "run_pairs", "run_foreign"]


def packed_words(lists: dict[str, tuple[str, ...]]) -> dict[str, int]:
    """Each function word with a one in the field of each of its languages."""
    out: dict[str, int] = {}
    for lang, words in lists.items():
        for w in words:
            out[w] = out.get(w, 0) | 1 << LANGUAGES.index(lang) * _FIELD
    return out


def _shares(words: list[str], packed: dict[str, int]) -> tuple[int, float, float, float, bool]:
    """Language, share of its function words, share of the most frequent other word, share of distinct pairs, and whether it seems to be of none of the languages."""
    n = len(words)
    counts = sum(map(packed.get, words, repeat(0)))
    best, lang = 0, -1
    if counts:
        for k in range(len(LANGUAGES)):
            c = counts >> k * _FIELD & _MOST
            if c > best:
                best, lang = c, k
    if lang >= 0 and n >= _LONG and best < n / 4:  # a long line may change its language: the words of the next best count too
        fields = [counts >> k * _FIELD & _MOST for k in range(len(LANGUAGES))]
        other = max((k for k in range(len(LANGUAGES)) if k != lang), key=fields.__getitem__)
        both = 1 << lang * _FIELD | 1 << other * _FIELD
        best = sum(1 for w in words if packed.get(w, 0) & both)
    top = pairs = 0.0
    if n >= 2:
        content = Counter([w.rstrip("s") for w in words if w not in packed])
        top = max(content.values(), default=0) / n
        pairs = len(set(zip(words, words[1:]))) / (n - 1)
    short = [w for w in words if len(w) <= _SHORT_LETTERS and not (lang >= 0 and packed.get(w, 0) >> lang * _FIELD & 1)]
    foreign = len(short) >= _FOREIGN_SHARE * n and len(set(short)) >= _FOREIGN_WORDS
    return lang, best / n if n else 0.0, top, pairs, foreign or other_script("".join(words))


def measure(text: str, packed: dict[str, int]) -> list[tuple]:
    """Of each line with anything on it the figures named in ``_FIELDS``; ``lang`` is -1 where no function word stands.

    ``listed`` marks short lines without an end of sentence and without a table's digits; ``links`` are the characters of addresses, and of
    a title beside one; ``repeated`` marks those that the page has several times. ``run_lines`` and what
    follows are the figures of a run of short lines, without tables' rows, as if it were one line; 0 where there is none.
    ``packed`` is what ``packed_words`` gives.
    """
    out, keys, runs = [], [], []
    before = False
    for line in (_INVISIBLE.sub("", text) if _INVISIBLE.search(text) else text).split("\n"):
        line = line.strip()
        chars = len(line) - line.count(" ")
        if not chars:
            continue
        bare = _ADDRESS.sub(" ", line) if ":/" in line else line
        has_address = len(bare) != len(line)
        words = _WORD.findall(bare.lower())
        n = len(words)
        shares = _shares(words, packed)
        letters = sum(map(len, words))
        linked = 0 if not has_address else chars if n <= 3 else chars - len(bare) + bare.count(" ")
        wordy = not has_address and n > 0 and letters >= 0.6 * chars
        listed = wordy and n < 8 and not line.endswith(_ENDS)
        plain = wordy and not _READING.search(_MARKER.sub("", line))
        short = plain and n < _SHORT
        if short:
            if not before:
                runs.append((len(out), []))
            runs[-1][1].append(words)
        before = short
        keys.append("".join(words) if plain else "")
        out.append((chars, n, *shares, len(_SEPARATOR.findall(bare)) / max(n - 1, 1), linked, listed))
    times = Counter(keys)
    marked = [(*x, k != "" and times[k] >= _REPEATED, 0, 0, -1, 0.0, 0.0, 0.0, False) for x, k in zip(out, keys)]
    for first, lines in runs:
        if len(lines) > 1:
            words = [w for x in lines for w in x]
            figures = (len(lines), len(words), *_shares(words, packed))
            for k in range(first, first + len(lines)):
                marked[k] = (*marked[k][:11], *figures)
    return marked


def line_figures(pages: DataFrame) -> DataFrame:
    """``id, url, lines`` of pages ``id, url, content``."""
    packed = packed_words(function_words(pages.sparkSession))
    types = [pa.int32(), pa.int32(), pa.int32(), *[pa.float32()] * 3, pa.bool_(), pa.float32(), pa.int32(), pa.bool_(), pa.bool_(), *[pa.int32()] * 3, *[pa.float32()] * 3, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [measure(t or "", packed) for t in b.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
            columns = list(zip(*(line for x in lines for line in x))) or [()] * len(_FIELDS)
            rows = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=_FIELDS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), rows)], names=["id", "url", "lines"])

    line = "chars:int,words:int,lang:int,function:float,top:float,pairs:float,foreign:boolean,separators:float,links:int,listed:boolean,repeated:boolean"
    line += ",run_lines:int,run_words:int,run_lang:int,run_function:float,run_top:float,run_pairs:float,run_foreign:boolean"
    return pages.select("id", "url", "content").mapInArrow(run, f"id bigint, url string, lines array<struct<{line}>>")


@dataclass(frozen=True)
class Limits:
    """Of each language, and last of lines without any: least share of function words, and the shares of the top word, of pairs and of separators from which a line fails."""

    function: tuple[float, ...]
    top: tuple[float, ...]
    pairs: tuple[float, ...]
    separators: tuple[float, ...]


def calibrate(figures: DataFrame, config: SpamConfig) -> Limits:
    """The limits of each language from all its lines of some length: part of the median of function words, and what sentences, as lines with enough of these are called, hardly ever reach."""
    c = config
    line = figures.select(F.inline("lines")).where((F.col("words") >= c.min_words) & (F.col("lang") >= 0) & ~F.col("foreign"))
    median = line.groupBy("lang").agg(F.percentile_approx("function", 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("n"))
    sentence = line.join(F.broadcast(median), "lang").where(F.col("function") >= c.of_median * F.col("median"))  # a row a language at most
    high = lambda x: F.percentile_approx(x, 0.99, 1000)
    repeats = F.lit(1.0) - F.col("pairs")
    rows = sentence.groupBy("lang").agg(F.first("median").alias("median"), F.first("n").alias("n"), high("top").alias("top"), high(repeats).alias("repeats"), high("separators").alias("separators")).collect()
    known = {r["lang"]: (c.of_median * r["median"], c.top_word * r["top"], 1 - c.pairs * r["repeats"], c.separators * r["separators"]) for r in rows if r["n"] >= c.min_lines}
    # what a language without enough lines has: the most lenient limits of those calibrated
    other = tuple(f(x[j] for x in known.values()) for j, f in enumerate((min, max, min, max))) if known else c.fallback
    each = [known.get(k, other) for k in range(len(LANGUAGES))]
    least = tuple(f(x[j] for x in each) for j, f in enumerate((min, max, min, max)))
    return Limits(*(tuple(x[j] for x in [*each, least]) for j in range(4)))


def _failing(line: Column, limits: Limits, c: SpamConfig) -> Column:
    table = {k: F.array(*[F.lit(float(x)) for x in getattr(limits, k)]) for k in ("function", "top", "pairs", "separators")}
    of = lambda k, lang: table[k][F.when(lang >= 0, lang).otherwise(len(LANGUAGES))]
    lang, run_lang = line["lang"], line["run_lang"]
    limit, run_limit = of("function", lang), of("function", run_lang)
    few = (line["words"] >= c.min_words) & (line["function"] < limit) & ~line["foreign"]
    stuffed = (line["words"] >= c.top_words) & (line["top"] >= of("top", lang)) & (line["function"] < 2 * limit)
    looped = (line["words"] >= c.top_words) & (line["pairs"] <= of("pairs", lang)) & (line["function"] < 2 * limit)
    tags = (line["words"] >= 6) & (line["separators"] >= of("separators", lang)) & (line["function"] < limit) & ~line["foreign"]
    repeated = line["repeated"] & (line["function"] < limit)
    run = (line["run_lines"] >= c.list_run) & (line["run_words"] >= c.min_words)
    run_few = (line["run_function"] < run_limit) & ~line["run_foreign"] & (line["run_words"] <= c.words_a_line * line["run_lines"])
    run_repeats = (line["run_top"] >= of("top", run_lang)) | (line["run_pairs"] <= of("pairs", run_lang))
    run_stuffed = (line["run_words"] >= c.top_words) & run_repeats & (line["run_function"] < 2 * run_limit)
    linked = (line["links"] > 0) & (line["links"] >= c.links * line["chars"])
    return linked | few | stuffed | looped | tags | repeated | (run & (run_few | run_stuffed))


def spam_pages(pages: DataFrame, links: DataFrame, config: SpamConfig = SpamConfig()) -> DataFrame:
    """``id`` of the pages whose greater part is keywords, tags, filler of keywords, or links without explanation.

    Only rows with ``ok`` true and content with something on it can be; null, empty and blank contents
    are none. Lists of titles count as links if the page has at least half as many rows in ``links``
    as the list has lines. Repeated sentences, tables of readings, lists with an explanation on each
    line and lists shorter than the text beside them are no spam. Extra columns are ignored; empty
    tables give no row. Repeated rows of a page are judged each by itself.
    """
    c = config
    good = pages.select("id", "url", "content", "ok").where(F.col("ok") & (F.trim("content") != ""))
    figures = materialise(line_figures(good))
    limits = calibrate(figures, c)
    out_links = links.where(F.col("from_url").isNotNull()).groupBy("from_url").agg(F.count(F.lit(1)).alias("n_links"))

    failing = lambda x: _failing(x, limits, c)
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda s, x: s + x["chars"])
    total = chars(F.col("lines"))
    # a list is a run of short lines; one other line within it doesn't end it
    near = lambda i: F.slice(F.col("lines"), F.greatest(i + 1 - (c.list_run - 1), F.lit(1)), 2 * c.list_run - 1)
    in_list = lambda x, i: x["listed"] & ~failing(x) & (F.size(F.filter(near(i), lambda y: y["listed"])) >= c.list_run)
    listed = F.when(F.size(F.filter("lines", lambda x: x["listed"])) >= c.list_run, F.filter("lines", in_list)).otherwise(F.slice("lines", 1, 0))
    judged = figures.select("id", "url", total.alias("total"), chars(F.filter("lines", failing)).alias("bad"), chars(listed).alias("list_chars"), F.size(listed).alias("list_lines"))
    sure = judged.where(F.col("bad") > c.share * F.col("total"))
    maybe = judged.where((F.col("bad") <= c.share * F.col("total")) & (F.col("list_lines") >= c.list_lines) & (F.col("bad") + F.col("list_chars") > c.share * F.col("total")))
    linked = maybe.join(out_links, maybe["url"] == out_links["from_url"]).where(2 * F.col("n_links") >= F.col("list_lines"))
    return sure.select("id").unionByName(linked.select("id"))
