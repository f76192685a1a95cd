"""Encoding of whole corpora with a public byte-level BPE vocabulary.

The distinct pieces of a batch are put into numpy matrices by length, one row a piece, padded with
-1. Each round every row merges its leftmost pair of least rank; pair ranks come from an open-addressing
hash table over the vocabulary. Only the two pairs beside a merge are looked up again, the row is
compacted to the left, and rows without a further merge leave the matrix. A row of its own, as a very long piece is,
merges its pair of least rank in each round wherever it stands, as far as one merge can't bear on another.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern published with the vocabulary, which parts text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int64(1) << 40
#: Pieces longer than this many bytes are rows of their own.
LONG = 256
_WIDTHS = (2, 4, 8, 16, 32, 64, 128, LONG)
#: Characters of text worked on at once.
SLICE = 4_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of mergeable pairs in an open-addressing hash table with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, dtype=np.int64), np.full(size, NONE, dtype=np.int64)
        key, value = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            first = np.zeros(len(key), dtype=bool)  # one key a slot and round
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            key, value, slot = key[~put], value[~put], slot[~put]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & (size - 1), slot)
        # tokens that are part of one of less rank, which then goes first
        used = self.keys >= 0
        part = np.maximum(self.keys[used] >> 32, self.keys[used] & 0xFFFFFFFF)
        self.early = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.early[part[self.values[used] < part]] = True
        self.longest = max(map(len, ranks))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where they don't merge; -1 on either side never merges."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), (left << 32) | right).ravel()
        out, at = np.full(len(key), NONE, dtype=np.int64), np.flatnonzero(key >= 0)
        slot = self._slot(key[at])
        while len(at):
            seen = self.keys[slot]
            hit = seen == key[at]
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (seen >= 0)
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merges a padded matrix of byte ids; gives each row's final ids."""
        n = len(ids)
        done: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * n
        row, ids = np.arange(n), ids.copy()
        ranks = np.full(ids.shape, NONE, dtype=np.int64)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1)
            line = np.arange(len(row))
            best = ranks[line, at]
            over = best == NONE
            if over.any():
                for k in np.flatnonzero(over):
                    done[row[k]] = ids[k][ids[k] >= 0].astype(np.int32)
                keep = ~over
                row, ids, ranks, at, best = row[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not len(row):
                    break
                line = np.arange(len(row))
            # the merged pair takes the place of its left part; what stands right of it moves up
            width = ids.shape[1]
            column = np.arange(width)
            source = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            ids[line, at] = best
            ranks[line, at] = self.rank(best, np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], -1))
            before = np.maximum(at - 1, 0)
            ranks[line, before] = np.where(at > 0, self.rank(ids[line, before], best), ranks[line, before])
            used = int((ids >= 0).sum(axis=1).max())
            if used < width:
                ids, ranks = ids[:, : max(used, 1)], ranks[:, : max(used, 1)]
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges of one long piece: all pairs of least rank in a round, of overlapping ones every other from the left.

        Where the merged token is part of one of less rank, that one would go before the next merge. Then only the leftmost of those
        goes that are closer than the longest token, as what follows from a merge reaches no further.
        """
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) < NONE:
            at = np.flatnonzero(ranks == low)
            if self.early[low]:
                at = at[np.concatenate([[True], np.diff(at) > self.longest])]
            else:
                new = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
                at = at[(np.arange(len(at)) - np.repeat(new, np.diff(np.concatenate([new, [len(at)]])))) % 2 == 0]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            ids[at] = low
            ids, ranks = ids[keep], np.append(ranks, NONE)[keep][:-1]
            own = at - np.arange(len(at))
            near = np.concatenate([own - 1, own])
            near = near[(near >= 0) & (near < len(ranks))]
            ranks[near] = self.rank(ids[near], ids[near + 1])
        return ids.astype(np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, worked out bucket by bucket of length."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        out: list[np.ndarray] = [np.empty(0, dtype=np.int32)] * len(pieces)
        for k in np.flatnonzero(sizes == 1):
            out[k] = self.byte_ids[[pieces[k][0]]].astype(np.int32)
        low = 1
        for width in _WIDTHS:
            for part in np.array_split(own := np.flatnonzero((sizes > low) & (sizes <= width)), max(1, len(own) * width >> 22)):
                if len(part):
                    wide = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in part), dtype=np.uint8).reshape(len(part), width)
                    ids = np.where(np.arange(width)[None, :] < sizes[part][:, None], self.byte_ids[wide], -1)
                    for k, merged in zip(part, self.merge_rows(ids)):
                        out[k] = merged
            low = width
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self.merge_long(pieces[k])
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: A space between two characters that aren't white space always starts a piece, so text may be cut before it.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_AWKWARD = re.compile(r"\s |^ | \s| $")


def _segments(text: str) -> list[str]:
    if _AWKWARD.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


def _gather(lists: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that codes name, one after the other, and each one's length."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.concatenate(lists) if lists else np.empty(0, dtype=np.int32)
    starts = np.cumsum(sizes) - sizes
    own = sizes[codes]
    at = np.repeat(starts[codes] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return flat[at], own


def encode_texts(table: PairTable, texts: list[str | None], pattern=None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after the other, and the number of ids of each text."""
    pattern = pattern or regex.compile(PATTERN)
    parts = [_segments(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    codes, segments = pd.factorize(np.array(list(chain.from_iterable(parts)), dtype=object))
    if not len(codes):
        return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    words = [pattern.findall(s) for s in segments]
    in_segment = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    word_codes, vocabulary = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
    # lone surrogates can't come from Parquet; they're kept apart from an error here all the same
    encoded = table.encode_pieces([w.encode("utf-8", "surrogatepass") for w in vocabulary])
    ids, sizes = _gather(encoded, word_codes)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(in_segment)]
    per_segment = np.diff(np.concatenate([[0], ends]))
    flat, own = _gather(np.split(ids, ends[:-1]), codes) if len(ends) else (ids, per_segment)
    cuts = np.concatenate([[0], np.cumsum(own)])[np.cumsum(counts)]
    return flat, np.diff(np.concatenate([[0], cuts]))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, ids``: the ids of each text by the vocabulary, without special tokens.

    Null and empty texts give an empty list, blank ones are encoded as they stand; the strings of
    special tokens are ordinary text. One row goes out for each row that comes in, also for repeated
    or null keys; more columns are ignored. An empty table gives no row. The table of pairs is
    broadcast: its size is the vocabulary's. Nothing is shuffled.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(PairTable(read_ranks(vocabulary)))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(PATTERN)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _slices(texts):
                flat, sizes = encode_texts(shared.value, texts[low:high], pattern)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), ids], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
