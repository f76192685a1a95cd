"""Metadata that a page declares about itself in comment lines, ``# +key: value``, and what its structure shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markup
from .text import BINARY_PATH

_LINE = r"(?U)^\s*#\s*\+\s*([A-Za-z_]+)\s*:\s*(.*?)\s*$"
#: Links to downloads from which a page is an index of files.
FILE_LINKS = 3


def declared(raw: Column) -> Column:
    """``map<string, string>`` of the declared fields, keys in lower case, the first of each; empty values and malformed lines are passed over. Null for null markup."""
    lines = F.split(raw, markup.LINE_END, -1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, _LINE, 1)).alias("key"), F.regexp_extract(x, _LINE, 2).alias("value")))
    good = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    keys = F.array_distinct(F.transform(good, lambda p: p["key"]))
    first = F.transform(keys, lambda k: F.struct(k.alias("key"), F.filter(good, lambda p: p["key"] == k)[0]["value"].alias("value")))
    return F.map_from_entries(first)


def structural_type(raw: Column) -> Column:
    """``file-index`` for a page with some links to downloads, else null."""
    targets = F.transform(F.regexp_extract_all(raw, F.lit(markup.LINK), F.lit(2)), lambda t: F.lower(F.regexp_extract(F.split(t, "`")[0], r"^[^:]*:?(.*)$", 1)))
    files = F.filter(targets, lambda t: t.rlike(BINARY_PATH))
    return F.when(F.size(files) >= FILE_LINKS, F.lit("file-index"))


def list_field(value: Column) -> Column:
    """The items of a field that lists some, parted by commas; null for none."""
    items = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) > 0, items)
