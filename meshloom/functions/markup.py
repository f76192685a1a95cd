"""Plain text, headings, titles and links of page markup, as built-in Spark expressions over whole columns.

Markup is lines of text with control codes that begin with a backtick, headings marked ``>``, comments
marked ``#`` and links written as label, target and fields between backticks in brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of links, colour codes and other codes.
LINK = r"`\[([^`\]]*)`([^\]]*)\]"
COLOUR = r"`[FBfb][0-9a-fA-F]{3}"
CODE = r"`[a-zA-Z!_=\*<>]"
#: Line ends, as many as text editors know.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def _bare(c: Column) -> Column:
    """Without colour and other codes."""
    return F.regexp_replace(F.regexp_replace(c, COLOUR, ""), CODE, "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_label(label: Column) -> Column:
    """A link's label as plain text of at most 200 characters; empty gives null."""
    return F.nullif(F.left(_strip(F.replace(_bare(label), F.lit("`"), F.lit(""))), F.lit(200)), F.lit(""))


def _lines(c: Column) -> Column:
    return F.split(c, LINE_END, -1)


def to_text(raw: Column) -> Column:
    """Readable text: link labels stay, codes and comment lines go, headings lose their marks, runs of blanks are one. Null gives an empty text."""
    flat = _bare(F.regexp_replace(F.coalesce(raw, F.lit("")), LINK, "$1 "))
    shown = F.filter(_lines(flat), lambda x: ~_strip(x).startswith("#"))
    marked = lambda x: x.startswith(">") | x.startswith("-")
    plain = F.transform(shown, lambda x: F.when(marked(x), _strip(F.regexp_replace(x, r"^[>\-]+", ""))).otherwise(x))
    text = F.replace(F.replace(F.array_join(plain, "\n"), F.lit("\\`"), F.lit("`")), F.lit("`"), F.lit(""))
    return _strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def headings(raw: Column) -> Column:
    """The text of all heading lines, a line each; empty if there is none."""
    body = F.transform(_lines(F.coalesce(raw, F.lit(""))), lambda x: F.regexp_extract(x, r"(?U)^\s*>+\s*(.+)$", 1))
    text = lambda x: _strip(F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, COLOUR, ""), LINK, "$1"), CODE, ""), F.lit("`"), F.lit("")))
    return F.array_join(F.filter(F.transform(body, text), lambda x: x != ""), "\n")


def title(raw: Column) -> Column:
    """The first heading with text, or else the first line with text, at most 200 characters; null if there is neither.

    A heading that is indented keeps its mark, as the mark is only taken from a line's start.
    """
    marked = F.filter(_lines(raw), lambda x: _strip(x).startswith(">"))
    text = lambda x: _strip(F.replace(F.regexp_replace(F.regexp_replace(_strip(F.regexp_replace(F.regexp_replace(x, COLOUR, ""), "^>+", "")), LINK, "$1"), CODE, ""), F.lit("`"), F.lit("")))
    first = F.filter(F.transform(marked, text), lambda x: x != "")
    other = F.filter(F.transform(F.split(to_text(raw), "\n"), _strip), lambda x: x != "")
    return F.left(F.coalesce(F.try_element_at(first, F.lit(1)), F.try_element_at(other, F.lit(1))), F.lit(200))


def extract_links(pages: DataFrame, url: str = "url", node: str = "node_hash", raw: str = "raw") -> DataFrame:
    """``from_url, to_url, to_node_hash, to_path, label``: the links of each page to pages of the mesh, the first of each target.

    Targets that are empty, of the web or of mail are skipped, as are paths outside ``/page/``. A ``ref``
    field is added to the target's url. Pages of null or empty markup have none.
    """
    found = F.regexp_extract_all(F.col(raw), F.lit(LINK), F.lit(0))
    each = pages.where(F.col(raw).contains("`[")).select(F.col(url).alias("from_url"), F.col(node).alias("own"), F.posexplode(found).alias("at", "whole"))
    parts = each.select("from_url", "own", "at", F.regexp_extract("whole", LINK, 1).alias("text"), F.split(F.regexp_extract("whole", LINK, 2), "`").alias("part"))
    target = _strip(F.col("part")[0])
    fields = F.coalesce(F.try_element_at(F.col("part"), F.lit(2)), F.lit(""))
    refs = F.filter(F.split(fields, r"\|"), lambda x: x.startswith("ref="))
    ref = F.nullif(_strip(F.regexp_replace(F.try_element_at(refs, F.lit(-1)), "^ref=", "")), F.lit(""))
    read = parts.select("from_url", "own", "at", clean_label(F.col("text")).alias("label"), target.alias("target"), ref.alias("ref"))
    there = F.lower(F.regexp_extract("target", r"^([0-9a-fA-F]{16,64}):", 1))
    local = F.when(F.startswith("target", F.lit(":")), F.expr("substring(target, 2)")).when(F.startswith("target", F.lit("/page/")), F.col("target"))
    path = F.coalesce(local, F.when(there != "", F.regexp_extract("target", r"(?s)^[0-9a-fA-F]{16,64}:(.*)$", 1)))
    placed = read.select("from_url", "at", "label", F.when(local.isNotNull(), F.col("own")).otherwise(there).alias("to_node_hash"), path.alias("to_path"), "ref")
    good = placed.where(F.startswith("to_path", F.lit("/page/")))
    whole = good.withColumn("to_url", F.concat(F.coalesce("to_node_hash", F.lit("")), F.lit(":"), "to_path", F.coalesce(F.concat(F.lit("#"), "ref"), F.lit(""))))
    # grouping combines on the map side, where a window would sort all links of a page
    first = whole.groupBy("from_url", "to_url").agg(F.min_by(F.struct("to_node_hash", "to_path", "label"), "at").alias("x"))
    return first.select("from_url", "to_url", "x.to_node_hash", "x.to_path", "x.label")
