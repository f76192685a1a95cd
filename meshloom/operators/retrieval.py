"""Lexical and vector retrieval for a batch of queries over all pages.

Words are read from an index (``index``) where there is one. Without, each page's words are filtered against the queries' few words before
anything is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as X
from ..functions.analyzer import lexemes, simple, weighted_words
from ..functions.querylang import Query, parse


@dataclass(frozen=True)
class Request:
    """A search request. ``vector`` is the query's embedding, or none where the embedder is silent."""

    qid: int
    q: str
    ptype: str | None = None
    limit: int = 10
    offset: int = 0
    vector: tuple[float, ...] | None = None


def page_words(pages: DataFrame, lexeme: Callable[[str], str | None] = simple) -> DataFrame:
    """``url, type, words`` of the good pages. An analyzer other than the simple one replaces words by lexemes and drops those without, whose places stay taken."""
    fields = [F.col(c) for c in ("title", "headings", "anchors", "description", "content")]
    found = pages.where("ok").select("url", "type", weighted_words(*fields).alias("words"))
    if lexeme is simple:
        return found
    read = found.withColumn("lexemes", lexemes(F.transform("words", lambda x: x["lexeme"]), lexeme))
    put = F.zip_with("words", "lexemes", lambda x, n: F.struct(n.alias("lexeme"), x["pos"].alias("pos"), x["w"].alias("w")))
    return read.select("url", "type", F.filter(put, lambda x: x["lexeme"].isNotNull()).alias("words"))


def postings(pages: DataFrame, words: tuple[str, ...] | None = None) -> DataFrame:
    """``url, lexeme, pos, w`` of the good pages, of the given words only if any are given."""
    found = page_words(pages)
    if words is not None:
        wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
        found = found.withColumn("words", F.filter("words", lambda x: F.array_contains(wanted, x["lexeme"])))
    # an inner generator would add a filter on the array, which finds the words once more
    return found.select("url", F.inline_outer("words")).where(F.col("lexeme").isNotNull())


def rank_any(posts: DataFrame, *more: str) -> DataFrame:
    """``url, rel`` for alternatives of one word each: every occurrence is a cover by itself, so the weights add up. ``more`` columns are keys too."""
    return posts.groupBy("url", *more).agg(F.sum("w").alias("rel"))


def rank_two(posts: DataFrame, *more: str) -> DataFrame:
    """``url, rel`` for two words that must both occur: the covers are neighbouring occurrences of different words."""
    by_place = Window.partitionBy("url", *more).orderBy("pos")
    before = posts.select("url", *more, "lexeme", "pos", "w", F.lag("lexeme").over(by_place).alias("l0"), F.lag("pos").over(by_place).alias("p0"), F.lag("w").over(by_place).alias("w0"))
    covers = before.where(F.col("l0").isNotNull() & (F.col("l0") != F.col("lexeme")))
    return covers.groupBy("url", *more).agg(F.sum(F.lit(2.0) / (1 / F.col("w") + 1 / F.col("w0")) / (F.col("pos") - F.col("p0"))).alias("rel"))


def cover_rank(query: Query, lexemes: list[str], places: list[int], weights: list[float]) -> tuple[bool, float]:
    """Whether a document with these occurrences (in order of place) matches, and its cover density.

    A cover is a shortest stretch that satisfies an alternative's wanted factors; it counts its occurrences by
    their harmonic mean weight, divided by one plus the number of other words within it.
    """
    where: dict[str, set[int]] = {}
    for x, p in zip(lexemes, places):
        where.setdefault(x, set()).add(p)
    row = lambda words, p: all(p + k in where.get(w, ()) for k, w in enumerate(words))
    starts = {f: sorted(p for p in where.get(f.words[0], ()) if row(f.words, p)) for a in query.alternatives for f in a}
    holds = [a for a in query.alternatives if all(bool(starts[f]) != f.excluded for f in a)]
    if not holds:
        return False, 0.0
    wanted = set(query.wanted)
    events = [(p, w) for x, p, w in zip(lexemes, places, weights) if x in wanted]
    covers: set[tuple[int, int]] = set()
    for a in query.alternatives:
        need = [f for f in a if not f.excluded]
        if not need or not all(starts[f] for f in need):
            continue
        spots = sorted((s, s + len(f.words) - 1, k) for k, f in enumerate(need) for s in starts[f])
        latest: dict[int, int] = {}
        last = None
        for s, e, k in sorted(spots, key=lambda x: (x[1], x[0])):
            latest[k] = max(s, latest.get(k, s))
            if len(latest) == len(need):
                begin = min(latest.values())
                if last is None or begin > last:  # a later end with the same beginning isn't shortest
                    covers.add((begin, e))
                    last = begin
    shortest = [c for c in covers if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in covers)]
    rel = 0.0
    for begin, end in sorted(shortest):
        inside = [w for p, w in events if begin <= p <= end]
        rel += len(inside) / sum(1 / w for w in inside) / (1 + max(0, (end - begin) - (len(inside) - 1)))
    return True, rel


def lexical(pages: DataFrame, requests: list[Request], lexeme: Callable[[str], str | None] = simple, index=None) -> DataFrame:
    """``qid, url, rel`` of every page that a request's query matches, of the request's type if it names one.

    With an ``index`` of these pages, written with the same analyzer, only its postings of the queries' words are read. Blank requests match nothing. The match and the density of queries beyond plain words are worked out by
    workers over the occurrences of query words in one page, which no page has many of.
    """
    spark = pages.sparkSession
    queries = {r.qid: parse(r.q, lexeme) for r in requests}
    words = tuple(dict.fromkeys(w for q in queries.values() for w in q.words))
    if not words:
        return spark.createDataFrame([], "qid bigint, url string, rel double")
    wanted = F.array(*[F.lit(w) for w in words])
    types = {r.qid: r.ptype for r in requests}
    live = {qid: q for qid, q in queries.items() if q.alternatives}
    plain = all(q.simple != "other" for q in live.values())
    if index is not None:
        found = index.postings(spark, words).select("url", "type", "lexeme", F.inline("at"))
        if plain:
            return _plain(found, live, types)
        hits = found.groupBy("url").agg(F.first("type").alias("type"), F.array_sort(F.collect_list(F.struct("pos", "lexeme", "w"))).alias("words"))
        if any(all(f.excluded for f in a) for q in live.values() for a in q.alternatives):  # what holds none of the words can match too
            hits = index.pages(spark).join(hits.drop("type"), "url", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<pos:int,lexeme:string,w:double>>")))
    else:
        hits = page_words(pages, lexeme).select("url", "type", F.filter("words", lambda x: F.array_contains(wanted, x["lexeme"])).alias("words"))
        # a filter on the number of words found would be pushed below and find them a second time, so pages without any go on
        if plain:
            return _plain(hits.select("url", "type", F.inline_outer("words")), live, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qids, at, rels = [], [], []
            for k, (kind, codes, places, weights) in enumerate(zip(*(b.column(j).to_pylist() for j in range(1, 5)))):
                xs = [words[c] for c in codes]
                have = set(xs)
                for qid, q in live.items():
                    if (types[qid] is None or types[qid] == kind) and any(all(f.excluded or have.issuperset(f.words) for f in a) for a in q.alternatives):
                        match, rel = cover_rank(q, xs, places, weights)
                        if match:
                            qids.append(qid), at.append(k), rels.append(round(rel, 6))  # sums in another order must not reorder equals
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.int64()), b.column(0).take(pa.array(at, pa.int64())), pa.array(rels, pa.float64())], names=["qid", "url", "rel"])

    # words go to the workers as their numbers among the queries' words
    code = F.transform("words", lambda x: (F.array_position(wanted, x["lexeme"]) - 1).cast("int"))
    coded = hits.select("url", "type", code.alias("codes"), F.transform("words", lambda x: x["pos"]).alias("places"), F.transform("words", lambda x: x["w"]).alias("weights"))
    return coded.mapInArrow(run, "qid bigint, url string, rel double")


def _plain(posts: DataFrame, queries: dict[int, Query], types: dict[int, str | None]) -> DataFrame:
    """The closed forms for queries of plain words: sums of weights, and neighbours of different words. No worker is needed."""
    spark = posts.sparkSession
    parts = []
    for kind in ("any", "two"):
        terms = [(qid, w, types[qid]) for qid, q in queries.items() if q.simple == kind for w in q.wanted]
        if not terms:
            continue
        asked = F.broadcast(spark.createDataFrame(terms, "qid bigint, lexeme string, ptype string"))  # the words of the batch
        found = posts.join(asked, "lexeme").where(F.col("ptype").isNull() | (F.col("ptype") == F.col("type")))
        parts.append(rank_any(found, "qid") if kind == "any" else rank_two(found, "qid"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("qid", "url", F.round("rel", 6).alias("rel"))


def top(rows: DataFrame, by: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each query, with their place from 0. Each task keeps no more than ``n`` rows a query before the shuffle."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*by))
    return rows.withColumn(name, place).where(F.col(name) <= n).withColumn(name, F.col(name) - 1)


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine, in double precision."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    return F.lit(1.0) - product(a, b) / (F.sqrt(product(a, a)) * F.sqrt(product(b, b)))


def vector_candidates(pages: DataFrame, requests: list[Request], config: EngineConfig = DEFAULT) -> DataFrame:
    """``qid, url, distance, rank``: the nearest pages of each request with a vector, exactly.

    A request whose distances are all alike (three or more within ``uniform_eps``) has none: its embedder
    answers the same to everything. Queries are compared in blocks with each batch of pages, of which
    only the nearest leave the worker.
    """
    asked = [r for r in requests if r.vector is not None]
    schema = "qid bigint, url string, distance double"
    if not asked:
        return pages.sparkSession.createDataFrame([], schema + ", rank int")
    dim, k = len(asked[0].vector), config.vector_topk
    q = np.array([r.vector for r in asked], dtype=np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    qids = np.array([r.qid for r in asked])
    good = pages.where(F.col("ok") & (F.size("embedding") == dim)).select("url", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
            size = np.linalg.norm(x, axis=1)
            use = np.flatnonzero(np.isfinite(size) & (size > 0))
            if not len(use):
                continue
            distance = 1 - q @ (x[use] / size[use, None]).T
            n = min(k, len(use))
            near = np.argpartition(distance, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), b.column(0).take(pa.array(use[near].ravel())), pa.array(np.take_along_axis(distance, near, 1).ravel())], names=["qid", "url", "distance"])

    nearest = top(good.mapInArrow(run, schema), [F.col("distance"), F.col("url")], k)
    return uniform_guard(nearest, config)


def vector_neighbours(pages: DataFrame, asked: DataFrame, config: EngineConfig = DEFAULT, block: int = 1024, broadcast_blocks: int = 64) -> DataFrame:
    """``qid, url, distance, rank``: the nearest pages of every usable vector of ``asked`` (``qid, vector``), exactly, for any number of them.

    Pages and vectors are packed into blocks, each block of pages meets each of vectors, and only the nearest of a block go on. Few blocks of vectors are broadcast; more are joined by
    their number. Vectors whose distances are all alike have no neighbours, as in ``vector_candidates``.
    """
    spark, dim, k = pages.sparkSession, config.embedding_dim, config.vector_topk
    usable = X.usable_vector
    numbered = asked.where(usable(F.col("vector"), dim)).select("qid", "vector")
    blocks = max(1, -(-numbered.count() // block))
    queries = numbered.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("qid").alias("qids"), F.flatten(F.collect_list("vector")).alias("vectors"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                yield pa.RecordBatch.from_arrays([one(b.column(0)), one(b.column(1).flatten())], names=["urls", "embeddings"])

    good = pages.where(F.col("ok") & usable(F.col("embedding"), dim)).select("url", "embedding").mapInArrow(pack, "urls array<string>, embeddings array<float>")
    met = good.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(queries) if blocks <= broadcast_blocks else queries, "block")
    unit = lambda values: (m := np.asarray(values, dtype=np.float64).reshape(-1, dim)) / np.linalg.norm(m, axis=1, keepdims=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j in range(b.num_rows):
                urls, x, qids, q = (b.column(c)[j].values for c in (0, 1, 2, 3))
                distance = 1 - unit(q.to_numpy(zero_copy_only=False)) @ unit(x.to_numpy(zero_copy_only=False)).T
                n = min(k, distance.shape[1])
                near = np.argpartition(distance, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(np.repeat(np.arange(len(distance)), n))), urls.take(pa.array(near.ravel())), pa.array(np.take_along_axis(distance, near, 1).ravel())], names=["qid", "url", "distance"])

    found = met.select("urls", "embeddings", "qids", "vectors").mapInArrow(compare, "qid bigint, url string, distance double")
    return uniform_guard(top(found, [F.col("distance"), F.col("url")], k), config)


def uniform_guard(candidates: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Without the queries whose distances are all alike."""
    spread = candidates.groupBy("qid").agg((F.max("distance") - F.min("distance")).alias("spread"), F.count(F.lit(1)).alias("n"))
    alike = spread.where((F.col("n") >= 3) & (F.col("spread") < config.uniform_eps)).select("qid")
    return candidates.join(F.broadcast(alike), "qid", "left_anti")  # no more rows than requests


def fuse(lexical_ranks: DataFrame, vector_ranks: DataFrame, k: int = 60) -> DataFrame:
    """``qid, url, fused``: the sum over both lists of one over ``k + 1 + place``."""
    part = lambda df: df.select("qid", "url", (F.lit(1.0) / (F.lit(k + 1) + F.col("rank"))).alias("part"))
    return part(lexical_ranks).unionByName(part(vector_ranks)).groupBy("qid", "url").agg(F.sum("part").alias("fused"))


def lexicon(pages: DataFrame, min_df: int = 2, lexeme: Callable[[str], str | None] = simple) -> DataFrame:
    """``word, df`` of the words of three to thirty letters that at least ``min_df`` good pages hold in any field."""
    words = page_words(pages, lexeme).select(F.explode_outer(F.array_distinct(F.transform("words", lambda x: x["lexeme"]))).alias("word"))
    return words.where(F.col("word").rlike("^[a-z][a-z]{2,29}$")).groupBy("word").agg(F.count(F.lit(1)).cast("int").alias("df")).where(F.col("df") >= min_df)

