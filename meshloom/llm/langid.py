"""Language of documents and of the stretches of mixed ones, by hierarchical discrimination.

Linear support vector machines over hashed letter n-grams of words decide first between language
families, one against one, and then, within a family, between its languages, again one against one.
Sentences are scored by their words; a path of least cost through a document's sentences, where a
change of language costs, gives its stretches. Where the outcome contradicts a row's label or mixes languages, a stretch is
none of the six languages if the function words of another explain it better, or its short words are in no list. The machines are trained on a bounded sample of
labelled rows; rows that the first round of training contradicts are left out of the second, so wrong
labels among them do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import function_words, other_script

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru")
#: Families of the languages: Germanic, Romance, Slavic.
FAMILIES = (("en", "de"), ("fr", "es", "pt"), ("ru",))

# Usual ways to write each label, in lower case and without a region.
LABELS = {
    "en": "en eng english englisch anglais inglés inglês английский",
    "de": "de deu ger german deutsch allemand alemán alemão немецкий",
    "fr": "fr fra fre french français francais französisch francés francês французский",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol испанский",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués португальский",
    "ru": "ru rus russian русский russisch russe ruso russo",
}
# Labels that say that the language isn't known.
UNKNOWN = "und undefined undetermined unknown n/a na none null ? ?? - mul mis zxx xx auto other"


@dataclass(frozen=True)
class LangConfig:
    """``sample_rows``: labelled rows the machines are trained on, at most this many of each language. ``sentences``: training
    sentences of each language. ``bits``: of the n-gram hash. ``switch``: cost of a change of language between sentences.
    ``stretch``: characters from which a further language counts. ``sure``: confidence that it takes to contradict a label."""

    sample_rows: int = 250
    sentences: int = 700
    bits: int = 15
    rounds: int = 40
    penalty: float = 1e-4
    switch: float = 6.0
    stretch: int = 80
    sure: float = 0.95


def label_language(label: Column) -> Column:
    """The language that a label names: one of the six, ``other``, or null where it is missing or says unknown."""
    bare = F.lower(F.regexp_replace(label, r"^[\s ]+|[\s ]+$", ""))
    main = F.regexp_replace(F.regexp_replace(bare, r"\s*\(.*$", ""), r"(?<=^[a-z]{2,3})[-_].*$", "")
    table = F.create_map(*[F.lit(x) for lang, names in LABELS.items() for name in names.split() for x in (name, lang)])
    missing = bare.isNull() | (bare == "") | bare.isin(UNKNOWN.split())
    return F.when(~missing, F.coalesce(F.try_element_at(table, main), F.lit("other")))


_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
_BOUNDARY = re.compile(r"(?:[.!?…]+[\"'»”)]*\s+|\n+)")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence or line with something on it; marks between digits don't end one."""
    out, at = [], 0
    for m in _BOUNDARY.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def word_features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter n-grams (1 to 4) of each word with marks at its ends, and the whole word: the word of each feature, and its bucket."""
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    codes = np.frombuffer(("".join(f"^{w}$" for w in words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    value, owners, buckets = mixed.copy(), [], []
    for n in range(1, 5):
        if n > 1:
            if len(codes) < n:
                break
            value = (value[:-1] * np.uint64(0xD6E8FEB86659FD93)) ^ mixed[n - 1 :]
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        h = (value[inside] * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift
        owners.append(owner[: len(owner) - n + 1][inside])
        buckets.append((h & mask).astype(np.int64))
    start = np.cumsum(lengths) - lengths
    sums = np.add.reduceat(mixed * (np.arange(len(codes), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), start) if len(words) else np.empty(0, np.uint64)
    base = start.astype(np.uint64) * np.uint64(2)  # the whole word's hash must not depend on where it stands
    plain = np.add.reduceat(mixed, start) if len(words) else sums
    whole = (sums - base * plain) * np.uint64(0xA24BAED4963EE407)
    owners.append(np.arange(len(words)))
    buckets.append(((whole >> shift) & mask).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def _hinge(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, size: int, c: LangConfig) -> np.ndarray:
    """A linear support vector machine: squared hinge loss, by gradient descent with momentum."""
    w, speed = np.zeros(size), np.zeros(size)
    pull = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))  # both sides weigh the same
    for _ in range(c.rounds):
        margin = y * np.bincount(rows, weights=vals * w[cols], minlength=len(y))
        slack = np.maximum(1 - margin, 0) * y * pull
        gradient = c.penalty * w - 2 * np.bincount(cols, weights=vals * slack[rows], minlength=size)
        speed = 0.9 * speed - 2.0 * gradient
        w = w + speed
    return w


class Machines:
    """The weights of all machines, one column each: first the pairs of families, then the pairs of languages within them."""

    def __init__(self, bits: int, weights: np.ndarray, scale: np.ndarray):
        self.bits, self.weights, self.scale = bits, weights, scale

    family_pairs = tuple(combinations(range(len(FAMILIES)), 2))
    language_pairs = tuple(p for family in FAMILIES for p in combinations(family, 2))

    @classmethod
    def train(cls, texts: list[str], langs: list[str], c: LangConfig) -> Machines:
        words = [[w.lower() for w in _WORD.findall(t)] for t in texts]
        codes, vocabulary = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
        count = np.array([len(ws) for ws in words])
        owner, bucket = word_features(list(vocabulary), c.bits)
        order = np.argsort(owner, kind="stable")
        owner, bucket = owner[order], bucket[order]
        starts = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
        per = np.diff(starts)[codes]
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(starts[:-1][codes], per)
        rows = np.repeat(np.repeat(np.arange(len(texts)), count), per)
        cell, inverse = np.unique(rows * (1 << c.bits) + bucket[at], return_inverse=True)
        rows, cols, vals = cell >> c.bits, cell & ((1 << c.bits) - 1), np.bincount(inverse).astype(float)
        vals /= np.sqrt(np.bincount(rows, weights=vals**2, minlength=len(texts)))[rows]
        lang = np.array(langs)
        family = np.array([next(k for k, f in enumerate(FAMILIES) if x in f) for x in langs])

        def machine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            own = a | b
            index = np.cumsum(own) - 1
            take = own[rows]
            return _hinge(index[rows[take]], cols[take], vals[take], np.where(a[own], 1.0, -1.0), 1 << c.bits, c)

        pairs = [machine(family == a, family == b) for a, b in cls.family_pairs] + [machine(lang == a, lang == b) for a, b in cls.language_pairs]
        out = cls(c.bits, np.array(pairs, dtype=np.float32).T.copy(), np.ones(len(pairs), dtype=np.float32))
        # margins are brought to one size: half of the training sentences lie beyond 1 a word
        codes_of, table = out.words([w for ws in words for w in ws])
        sums = np.add.reduceat(np.vstack([table[codes_of], np.zeros((1, len(pairs)), np.float32)]), np.minimum(np.cumsum(count) - count, len(codes_of)))
        own = np.abs(sums / np.maximum(count, 1)[:, None])
        out.scale = (1 / np.maximum(np.median(own, axis=0), 1e-6)).astype(np.float32)
        return out

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The code of each word, and for each code the margins of all machines."""
        codes, vocabulary = pd.factorize(np.array(words, dtype=object))
        owner, bucket = word_features(list(vocabulary), self.bits)
        table = np.stack([np.bincount(owner, weights=self.weights[bucket, k], minlength=len(vocabulary)) for k in range(self.weights.shape[1])], axis=1)
        return codes, (table * self.scale).astype(np.float32)

    def log_odds(self, margins: np.ndarray) -> np.ndarray:
        """Per sentence and language the logarithm of its probability, from summed margins: the family's, then the language's within it."""
        sigmoid = lambda x: -np.logaddexp(0, -x)
        family = np.zeros((len(margins), len(FAMILIES)))
        for k, (a, b) in enumerate(self.family_pairs):
            family[:, a] += sigmoid(margins[:, k])
            family[:, b] += sigmoid(-margins[:, k])
        family -= np.logaddexp.reduce(family, axis=1, keepdims=True)
        out = np.zeros((len(margins), len(LANGUAGES)))
        for f, names in enumerate(FAMILIES):
            own = np.zeros((len(margins), len(names)))
            for a, b in combinations(range(len(names)), 2):
                m = margins[:, len(self.family_pairs) + self.language_pairs.index((names[a], names[b]))]
                own[:, a] += sigmoid(m)
                own[:, b] += sigmoid(-m)
            own -= np.logaddexp.reduce(own, axis=1, keepdims=True)
            for k, name in enumerate(names):
                out[:, LANGUAGES.index(name)] = family[:, f] + own[:, k]
        return out


def _path(scores: np.ndarray, switch: float) -> np.ndarray:
    """The languages of a document's sentences: best total score, each change costing ``switch``."""
    n, k = scores.shape
    best, back = scores[0].copy(), np.zeros((n, k), dtype=np.int64)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(k), top)
        best = np.where(stay, best, best[top] - switch) + scores[i]
    out = np.empty(n, dtype=np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def stretches(machines: Machines, texts: list[str], c: LangConfig) -> list[list[tuple[int, int, int, float, int]]]:
    """Of each text its stretches: start, end, language, confidence, and the characters of those of its sentences that
    are of this language by themselves; texts without a letter have none."""
    bounds = [sentences(t) for t in texts]
    words, counts, weights = [], [], []
    for t, spans in zip(texts, bounds):
        hidden = _INVISIBLE.search(t) is not None
        for a, b in spans:
            own, weight = evidence(_INVISIBLE.sub("", t[a:b]) if hidden else t[a:b])
            words += own
            counts.append(len(own))
            weights.append(weight)
    per_text = [len(x) for x in bounds]
    if not words:
        return [[] for _ in texts]
    codes, table = machines.words(words)
    count, weight = np.array(counts), np.array(weights)
    ends = np.cumsum(count)
    sums = np.vstack([np.zeros((1, table.shape[1])), np.cumsum(table[codes], axis=0, dtype=np.float64)])
    scores = machines.log_odds((sums[ends] - sums[ends - count]) * weight[:, None])
    scores[count == 0] = 0
    first = scores.argmax(1)
    out, at = [], 0
    for t, spans, n in zip(texts, bounds, per_text):
        mine, says = scores[at : at + n], np.flatnonzero(count[at : at + n] > 0)
        seen = first[at : at + n][says]
        at += n
        if not len(says):
            out.append([])
            continue
        lang = np.full(n, seen[0]) if (seen == seen[0]).all() else _path(mine, c.switch)
        parts = []
        for a, b in _runs(lang):
            # sentences at the ends of a stretch that say nothing about language, such as tables, don't lengthen it
            own = says[(says >= a) & (says < b)]
            if not len(own):
                continue
            start, stop = spans[own[0]][0], spans[own[-1]][1]
            total = mine[a:b].sum(0)
            chars = sum(len(t[spans[k][0] : spans[k][1]].strip()) for k in own if mine[k].argmax() == lang[a])
            parts.append((start, start + len(t[start:stop].rstrip()), int(lang[a]), float(np.exp(total[lang[a]] - np.logaddexp.reduce(total))), chars))
        out.append(parts)
    return out


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:]))


_ADDRESS = re.compile(r"(?:\b[0-9a-fA-F]{16,64}:/\S*|\bhttps?://\S+|\S+@\S+)")


def evidence(sentence: str) -> tuple[list[str], float]:
    """The words, in lower case, by which a sentence is judged, and how far they're to be trusted.

    Addresses and names (capitals within a sentence) tell nothing, nor do lines that are mostly figures. Lines of few words
    besides names are trusted less.
    """
    if ":/" in sentence or "@" in sentence:
        sentence = _ADDRESS.sub(" ", sentence)
    words = _WORD.findall(sentence)
    if not words or 2 * sum(map(len, words)) < len(sentence) - sentence.count(" "):
        return [], 0.0
    small = [w for w in words if w[0].islower()]
    if len(words) >= 4 and 3 * len(small) <= len(words):  # all in capitals, or a capital on each word
        return [w.lower() for w in words], min(1.0, len(words) / 8)
    kept = small if words[0][0].islower() else [words[0].lower(), *small]
    return kept, min(1.0, (len(small) + 0.5) / 4)


def fit(pages: DataFrame, c: LangConfig = LangConfig()) -> Machines:
    """Trains on at most ``sample_rows`` labelled rows of each language, the same for the same rows whatever their order.

    Lists of function words stand in as sentences of each language, so a language without labelled rows can be told all the same.
    """
    from pyspark.sql import Window

    labelled = pages.select(label_language(F.col("lang")).alias("label"), "content", F.xxhash64("id", "content").alias("h")).where(F.col("label").isin(*LANGUAGES) & (F.length("content") >= 40))
    # each task keeps no more rows of a language than are wanted in all before any are gathered
    few = labelled.select("label", "h", F.row_number().over(Window.partitionBy("label").orderBy("h")).alias("rn")).where(F.col("rn") <= c.sample_rows)
    rows = labelled.join(F.broadcast(few.select("label", "h")), ["label", "h"], "left_semi").dropDuplicates(["h"]).orderBy("h").select("label", "content").limit(c.sample_rows * len(LANGUAGES)).collect()
    seeds = [(lang, " ".join(ws[k : k + 6])) for lang, ws in function_words(pages.sparkSession, LANGUAGES).items() for k in range(0, len(ws), 2)]

    def pick(kept: list[tuple[str, str]]) -> Machines:
        own: dict[str, list[str]] = {lang: [] for lang in LANGUAGES}
        for label, content in kept:
            clean = _INVISIBLE.sub("", content)
            own[label] += [s for a, b in sentences(clean) if len(_WORD.findall(s := clean[a:b])) >= 5]
        texts, langs = [s for _, s in seeds], [lang for lang, _ in seeds]
        for lang, found in own.items():
            step = max(1, len(found) // c.sentences)
            texts += found[::step][: c.sentences]
            langs += [lang] * len(found[::step][: c.sentences])
        return Machines.train(texts, langs, c)

    sample = [(r["label"], r["content"]) for r in rows]
    machines = pick(sample)
    for _ in range(1):
        guess = stretches(machines, [x for _, x in sample], c)
        agree = []
        for (label, content), parts in zip(sample, guess):
            size = {}
            for a, b, lang, *_ in parts:
                size[lang] = size.get(lang, 0) + b - a
            own = LANGUAGES.index(label)
            if size and max(size, key=size.get) == own:
                text = "\n".join(content[a:b] for a, b, lang, *_ in parts if lang == own)
                agree.append((label, text))
        machines = pick(agree)
    return machines


def is_other(text: str, lang: int, packed: dict[str, int], fields: int) -> bool:
    """Whether a stretch taken for a language is of none of the six: so many of its words are function words of another, or short words that no list of the language has.

    ``packed`` holds each function word with a one in the field of each of its languages, the six before the others.
    """
    if other_script(text):
        return True
    words = [w.lower() for w in _WORD.findall(text)]
    counts = sum(packed.get(w, 0) for w in words)
    field = lambda k: counts >> k * 24 & (1 << 24) - 1
    own, known = field(lang), max(field(k) for k in range(len(LANGUAGES)))
    if max(field(k) for k in range(len(LANGUAGES), fields)) > max(1.3 * known, 3):
        return True
    short = [w for w in words if len(w) <= 2 and not packed.get(w, 0) >> lang * 24 & 1]
    return len(short) >= 4 and len(set(short)) >= 3 and len(short) >= 0.1 * len(words) and own < 0.2 * len(words)


def segments(pages: DataFrame, machines: Machines, c: LangConfig = LangConfig()) -> DataFrame:
    """``id, label, parts`` of pages ``id, label, content``; ``parts`` are ``start, stop, lang, confidence, chars`` in characters from 0; ``lang`` is ``other`` for a stretch of none of the six languages."""
    lists = function_words(pages.sparkSession)
    order = [*LANGUAGES, *(k for k in lists if k not in LANGUAGES)]
    packed: dict[str, int] = {}
    for k, lang in enumerate(order):
        for w in lists[lang]:
            packed[w] = packed.get(w, 0) | 1 << k * 24
    shared = pages.sparkSession.sparkContext.broadcast((machines, packed))

    names = (*LANGUAGES, "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 2000):
                part = b.slice(low, 2000)
                texts, machines_there, words_there = [t or "" for t in part.column(2).to_pylist()], *shared.value
                found = stretches(machines_there, texts, c)
                for k, (label, parts) in enumerate(zip(part.column(1).to_pylist(), found)):
                    if any(LANGUAGES[p[2]] != label for p in parts):
                        found[k] = [(*p[:2], len(LANGUAGES), *p[3:]) if is_other(texts[k][p[0] : p[1]], p[2], words_there, len(order)) else p for p in parts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                columns = list(zip(*(p for x in found for p in x))) or [()] * 5
                rows = pa.StructArray.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array([names[k] for k in columns[2]], pa.string()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int32())],
                    names=["start", "stop", "lang", "confidence", "chars"],
                )
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), rows)], names=["id", "label", "parts"])

    return pages.select("id", "label", "content").mapInArrow(run, "id bigint, label string, parts array<struct<start:int,stop:int,lang:string,confidence:double,chars:int>>")


def labelled_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("ok") & F.col("content").isNotNull()).select("id", label_language(F.col("lang")).alias("label"), "content")


def document_languages(pages: DataFrame, c: LangConfig = LangConfig(), machines: Machines | None = None) -> DataFrame:
    """``id, label, main, langs, confidence`` of the good rows with a letter in their content.

    ``main`` is the language of most characters; ``langs`` holds it and each further language with a
    stretch of at least ``stretch`` characters; ``label`` is the language that the row's label names. Rows in none of the six languages give no row.
    Null, empty and blank contents and those without letters give no row. Repeated rows are judged each by itself.
    """
    machines = machines or fit(pages.where("ok"), c)
    known = F.filter("parts", lambda p: p["lang"] != "other").alias("parts")
    rows = segments(labelled_pages(pages), machines, c).select("id", "label", known).where(F.size("parts") > 0)
    size = lambda lang: F.aggregate(F.filter("parts", lambda p: p["lang"] == lang), F.lit(0), lambda s, p: s + p["chars"])
    sizes = F.array_sort(F.array(*[F.struct((-size(F.lit(x))).alias("n"), F.lit(x).alias("lang")) for x in LANGUAGES]))
    main = rows.withColumn("main", sizes[0]["lang"])
    long = F.transform(F.filter("parts", lambda p: p["chars"] >= c.stretch), lambda p: p["lang"])
    sure = F.aggregate(F.filter("parts", lambda p: p["lang"] == F.col("main")), F.lit(0.0), lambda s, p: F.greatest(s, p["confidence"]))
    return main.select("id", "label", "main", F.array_union(F.array("main"), long).alias("langs"), sure.alias("confidence"))


def wrong_or_mixed(pages: DataFrame, spam: DataFrame, c: LangConfig = LangConfig()) -> DataFrame:
    """``id, lang`` of the rows whose label is missing or wrong, and one for each language of the mixed ones; rows in ``spam`` are left out."""
    found = document_languages(pages, c).join(spam.select("id"), "id", "left_anti")
    wrong = (F.col("label") != F.col("main")) & (F.col("confidence") >= c.sure)
    case = (F.size("langs") > 1) | F.col("label").isNull() | wrong
    return found.where(case).select("id", F.explode("langs").alias("lang"))
