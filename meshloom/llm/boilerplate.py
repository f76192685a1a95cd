"""Lines that a site repeats over its documents, found through content-defined chunks.

A document's letters form one stream, whatever its line breaks. A rolling hash over a window of
letters decides where chunks end, so equal text is cut into equal chunks, but for those at its ends, wherever it stands and however it is
wrapped, spaced or capitalised. Distinct documents are counted per source and chunk. The repeated chunks are mapped back to the
lines they lie in: a line can only be repeated if the chunks inside it are, so whole lines are compared only there. A line
without a whole chunk inside is compared as if it were one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

#: Letters in the rolling window, and the average number of letters from one cut to the next.
WINDOW, AVERAGE = 6, 16
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64, and the seeds of the two hashes.
_BASE = 0x9E3779B97F4A7C15
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)
_TOP = 0x110000
#: Letters hashed at once.
SLICE = 2_000_000
#: Repeated chunks and lines up to this number are broadcast; beyond it they're joined by a shuffle.
BROADCAST_ROWS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Letters:
    """Which code points are letters, and prefix sums that give the hash of any stretch of letters."""

    def __init__(self) -> None:
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(_TOP)), dtype=bool, count=_TOP)
        self.powers, self.inverses = [], []
        for base in _BASES:
            for out, b in ((self.powers, base), (self.inverses, pow(base, -1, 1 << 64))):
                p = np.full(SLICE + 1, b, dtype=np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))

    def prefix(self, codes: np.ndarray, which: int) -> np.ndarray:
        value = _mix(codes.astype(np.uint64) + np.uint64((which + 1) * 0x1000000))
        sums = np.empty(len(codes) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(value * self.inverses[which][: len(codes)], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash of the letters from start to end; equal letters give equal hashes wherever they stand."""
        return _mix((sums[end] - sums[start]) * self.powers[which][start] + (end - start).astype(np.uint64))


@lru_cache(maxsize=1)
def shared_letters() -> Letters:
    """The tables of a worker process, made once."""
    return Letters()


def line_chunks(letters: Letters, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of every line with a letter: index of its text, line number from 1, chunk, and the two hashes of its letters; then of every chunk
    of the texts' streams of letters: index of its text, and hash.

    The chunk of a line is, of the chunks that lie inside it together with the window that begins them, the one of least hash. All of these are
    the same wherever the line stands. A line that holds none is a chunk by itself, which is added to the text's chunks.
    """
    joined = "\n\n".join(t.casefold() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    breaks = codes == 10
    # a text's end is a pair of breaks; texts may hold such pairs themselves, so ends are taken from lengths
    sizes = np.fromiter((t.count("\n") for t in texts), dtype=np.int64, count=len(texts))
    row_of = np.cumsum(breaks)
    keep = letters.is_letter[codes]
    row = row_of[keep]
    stream = codes[keep]
    n = len(stream)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none, none, none, none
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    end = np.concatenate([start[1:], [n]])
    line_row = row[start]
    first_row = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    text = np.searchsorted(first_row, line_row, side="right") - 1
    number = line_row - first_row[text] + 1

    one, two = letters.prefix(stream, 0), letters.prefix(stream, 1)
    key_a, key_b = letters.stretch(one, start, end, 0), letters.stretch(two, start, end, 1)
    chunk = key_a.copy()
    alone = np.ones(len(start), dtype=bool)
    text_start = start[np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))]  # the first letter of each text that has one
    text_of = text[np.searchsorted(start, text_start)]
    cut = np.empty(0, dtype=np.int64)
    if n >= WINDOW:
        head = np.arange(n - WINDOW + 1)
        cut = np.flatnonzero(letters.stretch(one, head, head + WINDOW, 0) % np.uint64(AVERAGE) == 0) + WINDOW  # a chunk ends before this letter
        cut = cut[cut - WINDOW >= text_start[np.searchsorted(text_start, cut - 1, side="right") - 1]]
    # texts begin and end with a cut too; chunks lie between neighbouring ones
    low = np.union1d(cut, text_start)
    low = low[low < n]
    high = np.concatenate([low[1:], [n]])
    hashes = letters.stretch(one, low, high, 0)
    owner = text_of[np.searchsorted(text_start, low, side="right") - 1]
    # the chunks that a line holds with the window before them
    line = np.searchsorted(start, low - WINDOW, side="right") - 1
    held = np.flatnonzero((line >= 0) & (high <= end[np.maximum(line, 0)]) & np.isin(low, cut) & (np.isin(high, cut)))
    if len(held):
        mine = line[held]
        group = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        chunk[mine[group]] = np.minimum.reduceat(hashes[held], group)
        alone[mine[group]] = False
    signed = lambda x: x.view(np.int64)
    of, own = np.concatenate([owner, text[alone]]), np.concatenate([signed(hashes), signed(chunk)[alone]])
    once = np.lexsort((own, of))
    of, own = of[once], own[once]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (own[1:] != own[:-1])])
    return text, number, signed(chunk), signed(key_a), signed(key_b), of[new], own[new]


def source_of(node_hash: Column, url: Column) -> Column:
    """The site of a page: its node hash, or else what stands before the colon of its url."""
    return F.coalesce(F.nullif(F.trim(node_hash), F.lit("")), F.nullif(F.substring_index(url, ":", 1), F.lit("")))


def chunked_lines(documents: DataFrame) -> DataFrame:
    """``id, source, lines, chunks`` of documents ``id, source, content``: of each line its number, chunk and letter hashes, and the document's different chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = shared_letters()
        for batch in batches:
            contents = batch.column(2).to_pylist()
            low, size = 0, 0
            for k, t in enumerate(contents):
                if len(t) * 3 > SLICE:  # a text longer than the tables of powers gets tables of its own
                    letters = _grown(letters, len(t) * 3 + 16)
                size += len(t) + 2
                if size * 3 > SLICE or k + 1 == len(contents):
                    yield _emit(letters, batch.slice(low, k + 1 - low), contents[low : k + 1])
                    low, size = k + 1, 0

    line = "line_no bigint, chunk bigint, a bigint, b bigint"
    return documents.select("id", "source", "content").mapInArrow(run, f"id bigint, source string, lines array<struct<{line.replace(' ', ':').replace(',:', ',')}>>, chunks array<bigint>")


def _grown(letters: Letters, size: int) -> Letters:
    if size > len(letters.powers[0]):
        for which, base in enumerate(_BASES):
            for name, b in (("powers", base), ("inverses", pow(base, -1, 1 << 64))):
                p = np.full(size + 1, b, dtype=np.uint64)
                p[0] = 1
                getattr(letters, name)[which] = np.multiply.accumulate(p)
    return letters


def _emit(letters: Letters, batch: pa.RecordBatch, contents: list[str]) -> pa.RecordBatch:
    # casefold may lengthen a text up to threefold; the tables hold for that
    text, number, chunk, a, b, of, chunks = line_chunks(letters, contents)
    edges = lambda owner: pa.array(np.searchsorted(owner, np.arange(len(contents) + 1)).astype(np.int32))
    rows = pa.StructArray.from_arrays([pa.array(number, pa.int64()), pa.array(chunk, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["line_no", "chunk", "a", "b"])
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(edges(text), rows), pa.ListArray.from_arrays(edges(of), pa.array(chunks, pa.int64()))], names=["id", "source", "lines", "chunks"])


def repeated_lines(pages: DataFrame, min_rows: int = 5, min_share: float = 0.1) -> DataFrame:
    """``id, line_no`` of every occurrence of a line that its site repeats.

    Lines are parted by ``\\n`` and numbered from 1. Lines are the same if their letters are, in order,
    whatever the case and whatever stands between them; lines without a letter never count. A line is
    repeated if it stands in at least ``min_rows`` rows of its site and in at least ``min_share`` of the
    site's rows with non-empty content. The site is ``node_hash`` or else the hash in ``url``; rows with
    neither form one site. Rows with null or empty content are ignored, as are more columns. Rows that
    share an id count as rows of their own. Letters are compared through 128 bits of hash.
    """
    usable = pages.select("id", source_of(F.col("node_hash"), F.col("url")).alias("source"), "content").where(F.col("content") != "")
    # rows are numbered before they're written, as rows of equal ids count apart, and not again for each line
    lines = materialise(chunked_lines(usable.withColumn("source", F.coalesce("source", F.lit("")))).withColumn("row", F.monotonically_increasing_id()))

    # a document's chunks are different, so the count is one of distinct documents, and it is combined before the shuffle;
    # source and chunk go as one number, as two that share it only leave more lines to be compared
    of = F.xxhash64("source", "chunk").alias("key")
    chunks = lines.select("source", F.explode("chunks").alias("chunk")).select(of)
    common = materialise(chunks.groupBy("key").count().where(F.col("count") >= min_rows).select("key"))
    rows = lines.select("id", "source", "row", F.inline("lines")).withColumn("key", of)
    maybe = rows.join(broadcast_if_small(common, BROADCAST_ROWS), "key", "left_semi")

    total = lines.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    distinct = maybe.select("source", "a", "b", "row").distinct()
    counted = distinct.groupBy("source", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    often = counted.join(total, "source").where(F.col("n") >= F.lit(min_share) * F.col("total")).select("source", "a", "b")
    often = materialise(often)
    return maybe.join(broadcast_if_small(often, BROADCAST_ROWS), ["source", "a", "b"], "left_semi").select("id", "line_no")


def without_repeated_lines(pages: DataFrame, **thresholds: float) -> DataFrame:
    """``id, content`` of every page, the repeated lines cut out; the others stay as they are, in order. Null content stays null."""
    cut = repeated_lines(pages, **thresholds).groupBy("id").agg(F.collect_set("line_no").alias("cut"))
    kept = F.filter(F.split("content", "\n", -1), lambda _, i: ~F.array_contains("cut", i.cast("long") + 1))
    return pages.select("id", "content").join(cut, "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"))
