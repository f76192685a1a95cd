"""Scalar expressions over queries, labels, prices, dates and hashes. All are built-in Spark expressions."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Freshness weight and half-life in days of each type; other types have the last.
FRESHNESS = {
    "news": (1.00, 7.0), "status": (0.90, 3.0), "article": (0.55, 45.0), "blog": (0.55, 45.0), "product": (0.65, 30.0),
    "wiki": (0.0, None), "dataset": (0.0, None), "file-index": (0.0, None), "index": (0.0, None),
}
FRESHNESS_OTHER = (0.20, 60.0)
# Query words that show an intent, and what they do to each type.
TEMPORAL = "breaking current latest new newest news now recent today"
COMMERCE = "buy cheap order price prices purchase sale shop store"
TEMPORAL_TYPES = {"article": 1.15, "blog": 1.15, "news": 1.35, "status": 1.20, "wiki": 0.4}
COMMERCE_TYPES = {"product": 1.5}
#: Types that make a claim about content, which the page's structure may contradict.
CONTENT_TYPES = ("article", "blog", "event", "news", "product", "status")
# Path endings that are downloads.
BINARY_ENDINGS = (".pdf", ".epub", ".zip", ".gz", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".mp3", ".ogg", ".opus", ".mp4", ".bin", ".tar")
#: Paths of downloads, in lower case: those of the file area, and those with such an ending.
BINARY_PATH = "^/file/|(?:" + "|".join(e.replace(".", r"\.") for e in BINARY_ENDINGS) + r")\z"


def normalize_query(q: Column) -> Column:
    """Lower case, white space runs as one space, trimmed, at most 200 characters. The cut comes last, so a space may end it."""
    return F.left(F.trim(F.regexp_replace(F.lower(q), r"(?U)\s+", " ")), F.lit(200))


def hash16(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def query_hash(q: Column) -> Column:
    """Sixteen hex digits of the normalised query; null for an empty one."""
    return hash16(F.nullif(normalize_query(q), F.lit("")))


def visitor_id(raw: Column, salt: str = "visitor:") -> Column:
    """An opaque id of a visitor, salted; null for an empty one."""
    return hash16(F.concat(F.lit(salt), F.nullif(raw, F.lit(""))))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def trimmed(text: Column, most: int) -> Column:
    """Trimmed and cut; empty becomes null."""
    return F.nullif(F.left(F.trim(text), F.lit(most)), F.lit(""))


def parse_price(raw: Column) -> Column:
    """The first decimal number, a comma counting as a point; null if there is none, or it is negative or ten million or more."""
    found = F.regexp_extract(F.translate(raw, ",", "."), r"[-+]?\d{1,9}(?:\.\d{1,2})?", 0)
    value = F.nullif(found, F.lit("")).try_cast("double")
    return F.when((value >= 0) & (value < 10_000_000), value)


def parse_declared_date(raw: Column, as_of: datetime, first_year: int = 2015) -> Column:
    """A declared ISO date or date and time as UTC, any zone being ignored; null if malformed, too old or over a day ahead."""
    text = F.trim(raw)
    full = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(?::\d{2})?", 0)
    date = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?!\w)", 1)
    seconds = F.regexp_extract(full, r":\d{2}:(\d{2})$", 1)
    stamp = F.concat(F.left(full, F.lit(10)), F.lit(" "), F.substring(full, 12, 5), F.lit(":"), F.when(seconds == "", "00").otherwise(seconds))
    at = F.when(full != "", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))).when(date != "", F.try_to_timestamp(date, F.lit("yyyy-MM-dd")))
    limit = F.lit(as_of).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    return F.when((F.year(at) >= first_year) & (at <= limit), at)


def effective_declared_date(updated: Column, published: Column, date: Column, as_of: datetime) -> Column:
    """The first valid of the declared fields, in this order."""
    return F.coalesce(*[parse_declared_date(c, as_of) for c in (updated, published, date)])


def effective_date(md_date: Column, last_changed: Column, first_seen: Column, fetched_at: Column) -> Column:
    return F.coalesce(md_date, last_changed, first_seen, fetched_at)


def rank_type(declared: Column, inferred: Column) -> Column:
    """The type that ranking uses: what the structure shows where it contradicts a claim of content."""
    contradicted = (inferred == "file-index") & declared.isin(*CONTENT_TYPES)
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.when(contradicted, inferred).otherwise(F.coalesce(filled(declared), filled(inferred), F.lit("index")))


def freshness(of_type: Column, effective: Column, as_of: datetime) -> Column:
    """One plus the type's weight halved for each half-life of age; one for neutral types and unknown dates."""
    age = F.greatest((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(effective)) / F.lit(86_400_000_000.0), F.lit(0.0))
    fade = lambda w, half: F.lit(1.0) + F.lit(w) * F.pow(F.lit(0.5), age / F.lit(half)) if half else F.lit(1.0)
    out = F.when(effective.isNull(), F.lit(1.0))
    for name, (w, half) in FRESHNESS.items():
        out = out.when(of_type == name, fade(w, half))
    return out.otherwise(fade(*FRESHNESS_OTHER))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def intent_multiplier(q: Column, of_type: Column) -> Column:
    """What the intent shown by a query's words does to a type; where two intents name a type, boosts go before demotions."""
    words = tokens(q)
    shows = lambda text: F.arrays_overlap(words, F.array(*[F.lit(w) for w in text.split()]))
    out = F.when(F.lit(False), F.lit(1.0))
    for text, types in ((COMMERCE, COMMERCE_TYPES), (TEMPORAL, TEMPORAL_TYPES)):
        for name, by in types.items():
            out = out.when((of_type == name) & shows(text), F.lit(by))
    return out.otherwise(F.lit(1.0))


def junk_ratio(text: Column) -> Column:
    """Share of box-drawing, block and geometric characters; 0 for an empty or null text."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit("[─-◿]")) / F.length(text)).otherwise(F.lit(0.0))


def is_binary(path: Column) -> Column:
    # within a function of its own the path is worked out once, whatever expression it is
    ends = lambda low: reduce(or_, [F.endswith(low, F.lit(e)) for e in BINARY_ENDINGS], F.startswith(low, F.lit("/file/")))
    return F.exists(F.array(F.lower(path)), ends)


def may_enqueue(path: Column) -> Column:
    """Neither a download nor a reader page, which is nothing without its reference."""
    return ~is_binary(path) & ~F.endswith(path, F.lit("/read.mu"))


def embedding_source(*parts: Column) -> Column:
    """The non-empty parts, a line each."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def embedding_prompt(text: Column, query: bool = False) -> Column:
    """The text with the prefix that the embedder expects, cut to its limit; null for a blank one."""
    kind, most = ("search_query: ", 1000) if query else ("search_document: ", 2500)
    return F.concat(F.lit(kind), F.left(F.nullif(F.trim(text), F.lit("")), F.lit(most)))


def usable_vector(v: Column, dim: int) -> Column:
    return (F.size(v) == dim) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def rounded_vector(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x.cast("double"), digits))


def encode_ref(book: Column, path: Column) -> Column:
    """Url-safe base64 without padding; the breaks that long encodings get are taken out."""
    raw = F.base64(F.encode(F.concat(book, F.lit("\n"), path), "UTF-8"))
    return F.rtrim(F.translate(F.translate(raw, "\r\n", ""), "+/", "-_"), F.lit("="))


def backoff(attempts: Column, max_attempts: int = 4) -> tuple[Column, Column]:
    """Whether a failed item is given up, and else the seconds until its next attempt."""
    n = F.coalesce(attempts, F.lit(0))
    return n >= max_attempts, F.when(n < max_attempts, F.lit(3600) * (n + 1))


def priority(from_node: Column, to_node: Column, is_index: Column, seeds: frozenset[str]) -> Column:
    """1 for the index of a seed node, 2 for what seed nodes hold or link to, 3 for other indexes, 6 for the rest."""
    seed = lambda c: c.isin(*sorted(seeds)) if seeds else F.lit(False)
    return F.when(is_index & seed(to_node), 1).when(seed(to_node) | seed(from_node), 2).when(is_index, 3).otherwise(6)
