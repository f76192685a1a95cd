"""Passages of held-out test items inside a training corpus, found by spaced seeds.

A spaced seed is a fixed mask laid over consecutive words: the words under its ones are hashed, those
under its zeros are ignored, so a replaced word under a zero leaves the hash as it was. All masks have
as many ones, and a hash tells nothing of its mask: a mask without zeros on a document also meets masks with zeros
on an item, as where the document leaves a word out. Seeds of the items and of the documents are joined on their
hashes, and wherever a seed of an item hits a document, the passage around the hit is aligned word by word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

#: Masks over consecutive words of a document, and of an item: those, and others that pass over a word the document leaves out.
#: A one is a word that must agree; each mask holds six.
MASKS = ("111111", "1110111", "11011011")
ITEM_MASKS = (*MASKS, "1011111", "1101111", "1111011", "1111101")
SEED_WORDS = 6


@dataclass(frozen=True)
class LeakConfig:
    """``run``: words in a row that are a leak. ``most``: part of an item whose words, with odd ones replaced or left out, are
    one too, but eight words at least, or all where the item has fewer. ``broadcast_words``: words of all items up to which
    their seeds are broadcast; those of more are joined by a shuffle. ``bits``: of the map by which documents' seeds are
    passed over before that shuffle. ``hot_rows``: documents of one seed from which it is split. ``span``: shifts of one passage in the shuffle."""

    run: int = 15
    most: float = 0.5
    match: float = 1.0
    replaced: float = -3.0
    left_out: float = -2.0
    broadcast_words: int = 500_000
    bits: int = 27
    hot_rows: int = 1_000_000
    span: int = 4096


_DROPPED = re.compile("[­̀-ͯ​-‏⁠-⁤︀-️﻿]")
_JOINED = re.compile(r"(?<=\w)['’‘`ʼ\-‐-‒](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[a-z][Ͱ-ӿ]|[Ͱ-ӿ][a-z]")
# Letters of other scripts that look like Latin ones, and the letters they look like.
_LOOKS = str.maketrans("аеіјорсухѕԁһӏαεικνορτυχ", "aeijopcyxsdhlaeikvoptux")


def words(text: str | None) -> list[str]:
    """The words of a text without case, marks, spacing, joined hyphens and apostrophes, and invisible or variant characters."""
    if not text:
        return []
    if not text.isascii():
        text = _DROPPED.sub("", unicodedata.normalize("NFKD", text))
        text = text.casefold()
        if _MIXED.search(text):
            text = _WORD.sub(lambda m: m[0].translate(_LOOKS) if _MIXED.search(m[0]) else m[0], text)
    else:
        text = text.lower()
    return _WORD.findall(_JOINED.sub("", text))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def hash_words(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after the other, and where each text starts."""
    codes, vocabulary = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    hashes = pd.util.hash_array(np.asarray(vocabulary, dtype=object), categorize=False) if len(vocabulary) else np.empty(0, np.uint64)
    return hashes[codes], np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def seeds(hashes: np.ndarray, starts: np.ndarray, masks: tuple[str, ...] = MASKS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every seed that lies within one text."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out, places = [], []
    for mask in masks:
        n = len(hashes) - len(mask) + 1
        if n <= 0:
            continue
        value = np.ones(n, dtype=np.uint64)
        for k, one in enumerate(mask):
            if one == "1":
                value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
        inside = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
        out.append(value[inside])
        places.append(inside)
    return (np.concatenate(out), np.concatenate(places)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64))


@dataclass
class Items:
    """The items' words and their seeds, in the order of the seeds' hashes. ``code`` numbers the different words, ``vocabulary`` holds them in order."""

    ids: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray
    vocabulary: np.ndarray
    code: np.ndarray

    @classmethod
    def build(cls, ids: list[int], texts: list[str]) -> Items:
        return cls.of_words(np.array(ids, dtype=np.int64), *hash_words([words(t) for t in texts]))

    @classmethod
    def of_words(cls, ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> Items:
        keys, places = seeds(hashes, starts, ITEM_MASKS)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        item = np.searchsorted(starts, places, side="right") - 1
        size = 1 << max(16, int(np.ceil(np.log2(len(keys) * 16 + 1))))  # a bit map of the hashes' low ends, to pass over most seeds that hit nothing
        present = np.zeros(size, dtype=bool)
        present[(keys & np.uint64(size - 1)).astype(np.int64)] = True
        vocabulary, code = np.unique(hashes, return_inverse=True)
        return cls(ids, hashes, starts, keys, item, places - starts[item], present, vocabulary, code)

    def words(self, item: int) -> np.ndarray:
        return self.hashes[self.starts[item] : self.starts[item + 1]]


def needed(length: np.ndarray | int, c: LeakConfig) -> np.ndarray:
    """Words of an item that must be equal in an alignment."""
    return np.minimum(np.maximum(np.ceil(c.most * length), 8), length)


def longest_run(a: np.ndarray, b: np.ndarray, shifts: np.ndarray) -> int:
    """The most words in a row that both hold, among the alignments ``place in b - place in a`` given."""
    best = 0
    for s in shifts:
        low, high = max(0, -s), min(len(a), len(b) - s)
        if high - low <= best:
            continue
        same = np.concatenate([[False], a[low:high] == b[low + s : high + s], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        best = max(best, int((edge[1::2] - edge[::2]).max(initial=0)))
    return best


def aligned_words(a: np.ndarray, b: np.ndarray, c: LeakConfig) -> int:
    """The number of equal words in the best local alignment of the item a with the passage b."""
    n = len(b)
    score, count = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int64)
    best, found = 0.0, 0
    ramp = np.arange(n + 1) * -c.left_out
    for x in a:
        same = b == x
        diagonal = score[:-1] + np.where(same, c.match, c.replaced)
        up = score[1:] + c.left_out
        here = np.concatenate([[0.0], np.maximum(np.maximum(diagonal, up), 0)])
        counted = np.concatenate([[0], np.where(diagonal >= up, count[:-1] + same, count[1:])])
        counted = np.where(here > 0, counted, 0)
        # gaps along the passage: the best start to the left less the words left out since
        lifted = here + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        score = np.maximum(top - ramp, 0)
        count = np.where(score > here, counted[source], counted)
        k = int(score.argmax())
        if score[k] > best:
            best, found = float(score[k]), int(count[k])
    return found


def word_bits(a: np.ndarray) -> dict[int, int]:
    """Each word with a one at every place where it stands."""
    ones: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        ones[x] = ones.get(x, 0) | 1 << k
    return ones


def common_words(a: np.ndarray, b: np.ndarray, ones: dict[int, int] | None = None) -> int:
    """The most words that both hold in the same order. No alignment has more equal words, so what falls short by this needs none.

    Whole numbers hold a row of the table of longest common subsequences each, a bit a word of a: a zero where the length grows.
    ``ones`` is what ``word_bits`` gives for a, where it is at hand.
    """
    ones = word_bits(a) if ones is None else ones
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if x in ones:
            both = row & ones[x]
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def find(texts: list[str | None], items: Items, c: LeakConfig) -> list[tuple[int, int]]:
    """Pairs of the index of a text and an item of which it holds a passage."""
    hashes, starts = hash_words([words(t) for t in texts])
    keys, places = seeds(hashes, starts)
    maybe = items.present[(keys & np.uint64(len(items.present) - 1)).astype(np.int64)]
    keys, places = keys[maybe], places[maybe]
    low = np.searchsorted(items.keys, keys, side="left")
    hit = np.flatnonzero((low < len(items.keys)) & (items.keys[np.minimum(low, max(len(items.keys) - 1, 0))] == keys)) if len(items.keys) else np.empty(0, np.int64)
    order = np.argsort(places[hit], kind="stable")
    hit = hit[order]
    low, places = low[hit], places[hit]
    size = np.searchsorted(items.keys, keys[hit], side="right") - low
    # places are worked through in parts, whole texts each, so that what a common seed expands to is bounded
    text = np.searchsorted(starts, places, side="right") - 1
    total = np.cumsum(size)
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(hit):
        to = max(int(np.searchsorted(total, total[at] + EXPANDED)), at + 1)
        to = int(np.searchsorted(text, text[to - 1], side="right"))
        out += _find(hashes, starts, low[at:to], size[at:to], places[at:to], text[at:to], items, c)
        at = to
    return out


#: Pairs of a place and an item worked on at once.
EXPANDED = 2_000_000


def _find(hashes: np.ndarray, starts: np.ndarray, low: np.ndarray, size: np.ndarray, places: np.ndarray, text: np.ndarray, items: Items, c: LeakConfig) -> list[tuple[int, int]]:
    place, text = np.repeat(places, size), np.repeat(text, size)
    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(len(place))
    item, shift = items.item[at], place - starts[text] - items.place[at]
    pair = text * len(items.ids) + item
    order = np.lexsort((shift, pair))
    pair, shift = pair[order], shift[order]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (shift[1:] != shift[:-1])]))
    times = np.diff(np.concatenate([new, [len(pair)]]))
    pair, shift = pair[new], shift[new]
    text, item = pair // len(items.ids), pair % len(items.ids)
    sizes, docs = np.diff(items.starts), np.diff(starts)
    reach = _reach(sizes)
    # hits whose shifts lie close together belong to one passage; passages far apart are aligned each by itself
    begin = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (np.diff(shift) > reach[item[1:]])]))
    end = np.concatenate([begin[1:], [len(pair)]]) - 1
    i, t = item[begin], text[begin]
    lo, hi = np.maximum(shift[begin] - reach[i], 0), np.minimum(shift[end] + sizes[i] + reach[i], docs[t])
    enough = _enough(hashes, starts, t, lo, hi, i, items, c)
    ran = np.flatnonzero(times >= _of_run(c))
    out = {(int(text[k]), int(item[k])) for k in ran.tolist() if longest_run(items.words(int(item[k])), hashes[starts[text[k]] : starts[text[k] + 1]], shift[k : k + 1]) >= c.run}
    ones: dict[int, dict[int, int]] = {}
    for k in np.flatnonzero(enough).tolist():
        found = (int(t[k]), int(i[k]))
        if found in out:
            continue
        own = items.words(found[1])
        if found[1] not in ones:
            ones[found[1]] = word_bits(own)
        if aligned(own, hashes[starts[found[0]] + lo[k] : starts[found[0]] + hi[k]], ones[found[1]], c):
            out.add(found)
    return sorted((a, int(items.ids[b])) for a, b in out)


def _enough(hashes: np.ndarray, starts: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, items: Items, c: LeakConfig) -> np.ndarray:
    """Whether so many words of the passages ``lo .. hi`` are words of the item as an alignment needs: a bound that loses nothing."""
    need = needed(np.diff(items.starts), c)[item]
    out = np.zeros(len(text), dtype=bool)
    v = len(items.vocabulary)
    code = np.minimum(np.searchsorted(items.vocabulary, hashes), v - 1)
    code[items.vocabulary[code] != hashes] = v
    own, where = np.unique(item, return_inverse=True)
    step = max(1, (1 << 25) // (v + 1))  # items whose sets of words are held at once
    for k in range(0, len(own), step):
        few = own[k : k + step]
        member = np.zeros((len(few), v + 1), dtype=bool)
        n = np.diff(items.starts)[few]
        first = items.starts[:-1][few]
        member[np.repeat(np.arange(len(few)), n), items.code[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        mine = np.flatnonzero((where >= k) & (where < k + step))
        for part in np.array_split(mine, max(1, int((hi - lo)[mine].sum()) >> 21)):
            n = (hi - lo)[part]
            begin = np.cumsum(n) - n
            at = np.repeat(starts[text[part]] + lo[part] - begin, n) + np.arange(n.sum())
            held = np.concatenate([[0], np.cumsum(member[np.repeat(where[part] - k, n), code[at]])])
            out[part] = held[begin + n] - held[begin] >= need[part]
    return out


def _reach(length):
    """How far an alignment may stray from a hit: words left out cost more than half of an item's words could make good."""
    return length // 2 + 1


def _of_run(c: LeakConfig) -> int:
    """Hits at one shift that a run of ``run`` words has at least."""
    return sum(max(c.run - len(mask) + 1, 0) for mask in MASKS)


def aligned(own: np.ndarray, passage: np.ndarray, ones: dict[int, int], c: LeakConfig) -> bool:
    """Whether the passage has enough of the item's words in order. ``ones`` is what ``word_bits`` gives for the item."""
    need = float(needed(len(own), c))
    return common_words(own, passage, ones) >= need and aligned_words(own, passage, c) >= need


def leaked(own: np.ndarray, doc: np.ndarray, shifts: np.ndarray, c: LeakConfig) -> bool:
    """Whether a passage of the item's words stands in the document where seeds hit at these shifts (``place in doc - place in item``, in order)."""
    if longest_run(own, doc, shifts) >= c.run:
        return True
    reach, ones = _reach(len(own)), word_bits(own)
    cuts = [0, *(np.flatnonzero(np.diff(shifts) > reach) + 1).tolist(), len(shifts)]
    return any(aligned(own, doc[max(0, int(shifts[a]) - reach) : max(0, int(shifts[b - 1]) + len(own) + reach)], ones, c) for a, b in zip(cuts, cuts[1:]))


def item_words(items: DataFrame) -> DataFrame:
    """``item_id, words``: the hashes of the words of each item with an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, starts = hash_words([words(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(hashes.view(np.int64), starts)], names=["item_id", "words"])

    good = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where((F.col("text") != "") & F.col("item_id").isNotNull())
    return good.mapInArrow(run, "item_id bigint, words array<bigint>")


def _lists(flat: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))


def leaks(documents: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, item_id`` for every document that holds a passage of an item.

    A passage is at least ``run`` words in a row of the item, or at least the part ``most`` of its words (eight at least; all, where it has fewer)
    in order with odd words replaced or left out. Case, marks, spacing, line breaks, and invisible or
    variant characters don't count. Null and empty texts on either side match nothing; items of fewer
    than six words, which can't be told from a chance quotation, match nothing either, nor does a passage in which no six words fit a mask. Repeated documents are
    found each by itself, a pair comes out once a row, also where an item id has several rows; empty tables give no row, more columns are ignored.

    The corpus is read once. Up to ``broadcast_words`` words of all items, which are counted first, the items' seeds are broadcast and the corpus isn't shuffled;
    beyond, seeds of both sides are joined as rows. Both ways give the same pairs.
    """
    prepared = materialise(item_words(items))
    source = documents.select(F.col(key), F.col(text)).where(F.col(text) != "")
    total = prepared.agg(F.sum(F.size("words"))).first()[0] or 0
    if total > config.broadcast_words:
        return _joined(source, prepared, config, key, text)
    table = prepared.toArrow()
    hashes = table.column("words").combine_chunks()
    built = Items.of_words(table.column("item_id").to_numpy(), hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(hashes.offsets, dtype=np.int64))
    shared = documents.sparkSession.sparkContext.broadcast(built)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part = b.slice(low, 1000)
                found = sorted(set(find(part.column(1).to_pylist(), shared.value, config)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([t for t, _ in found], pa.int64())), pa.array([i for _, i in found], pa.int64())], names=[key, "item_id"])

    return source.mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, item_id bigint")


def _joined(source: DataFrame, prepared: DataFrame, c: LeakConfig, key: str, text: str) -> DataFrame:
    """The same pairs through a join of both sides' seeds. A seed of very many documents is split, and meets the items' seeds in each part."""
    spark, kind = source.sparkSession, source.schema[key].dataType.simpleString()
    low_bits = np.uint64((1 << c.bits) - 1)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = np.asarray(b.column(1).offsets, dtype=np.int64)
            values, places = seeds(b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), starts - starts[0], ITEM_MASKS)
            item = np.searchsorted(starts - starts[0], places, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(item)), pa.array((places - starts[item] + starts[0]).astype(np.int32)), pa.array(values.view(np.int64))], names=["item_id", "at", "seed"])

    of_item = materialise(prepared.mapInArrow(of_items, "item_id bigint, at int, seed bigint"))
    # the map of the items' seeds, of a fixed size: the words of 64 bits that hold any
    place = F.col("seed").bitwiseAND(F.lit(int(low_bits)))
    held = of_item.select(F.shiftright(place, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    filled = held.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (c.bits - 6), dtype=np.uint64)
    bits[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bits)

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for low in range(0, b.num_rows, 1000):
                part = b.slice(low, 1000)
                hashes, starts = hash_words([words(t) for t in part.column(1).to_pylist()])
                values, places = seeds(hashes, starts)
                slot = values & low_bits
                maybe = np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                maybe = maybe[np.argsort(places[maybe], kind="stable")]
                values, places = values[maybe], places[maybe]
                edge = np.searchsorted(places, starts)
                hits = pa.StructArray.from_arrays([pa.array(values.view(np.int64)), pa.array((places - np.repeat(starts[:-1], np.diff(edge))).astype(np.int32))], names=["seed", "place"])
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(hashes.view(np.int64), starts), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), hits)], names=[key, "words", "hits"])

    schema = f"`{key}` {kind}, words array<bigint>, hits array<struct<seed:bigint,place:int>>"
    docs = materialise(source.mapInArrow(of_documents, schema).where(F.size("hits") > 0).withColumn("row", F.monotonically_increasing_id()))
    flat = docs.select("row", F.inline("hits"))
    parts = F.ceil(F.col("n") / F.lit(c.hot_rows)).cast("int")
    hot = materialise(flat.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > c.hot_rows).select("seed", parts.alias("parts")))
    hot = broadcast_if_small(hot, 100_000)
    mine = flat.join(hot, "seed", "left").withColumn("part", F.pmod("row", F.coalesce("parts", F.lit(1)))).drop("parts")
    theirs = of_item.join(hot, "seed", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1))).drop("parts")
    shift = (F.col("place") - F.col("at")).alias("shift")
    met = mine.join(theirs, ["seed", "part"]).select("row", "item_id", shift).distinct()
    pairs = met.groupBy("row", "item_id", F.floor(F.col("shift") / c.span).alias("stretch")).agg(F.array_sort(F.collect_list("shift")).alias("shifts"))
    own = pairs.join(prepared.withColumnRenamed("words", "own"), "item_id")
    reach = F.floor(F.size("own") / 2).cast("int") + 1  # as in _reach
    begin = F.greatest(F.element_at("shifts", 1) - reach, F.lit(0))
    end = F.element_at("shifts", -1) + F.size("own") + reach
    passages = own.join(docs.select("row", key, "words"), "row").select(
        "row", F.col(key), "item_id", "own", F.transform("shifts", lambda x: x - begin).alias("shifts"), F.slice("words", begin + 1, end - begin).alias("passage")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for k in range(b.num_rows):
                mine, shifts, passage = (b.column(j)[k].values.to_numpy(zero_copy_only=False) for j in (3, 4, 5))
                good.append(leaked(mine.view(np.uint64), passage.view(np.uint64), shifts.astype(np.int64), c))
            yield b.select(["row", key, "item_id"]).filter(pa.array(good, pa.bool_()))

    found = passages.mapInArrow(verify, f"row bigint, `{key}` {kind}, item_id bigint")
    return found.dropDuplicates(["row", "item_id"]).select(F.col(key), "item_id")
