"""The most similar vectors of every vector, by cosine, through a hierarchical k-means tree.

The tree is fitted on a bounded sample, every vector is put into one of its leaves, and each query
visits leaves best bin first: a priority queue holds the branches not yet taken by their distance to
the query, and the nearest is opened next. How many leaves are visited is calibrated: a set of
queries is answered exactly over all rows, and visits are widened until the wanted share of their true
neighbours lies in the leaves visited.

Equal vectors are indexed once, so copies, however many, never meet each other in a leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise


@dataclass(frozen=True)
class TreeConfig:
    """``sample_rows``: rows the tree is fitted on. ``leaf_rows``: rows a leaf should hold; ``max_leaves`` bounds the leaves, and
    with them what is broadcast. ``first_visits``: leaves
    looked at first when visits are calibrated. ``cell_rows``: rows, at least, of a group of leaves searched together. ``queries``: rows answered exactly for the calibration. ``recall``: share of true
    neighbours to be reached. ``block_rows``, ``block_queries``: cells with more members or queries are
    split into blocks. ``broadcast_rows``: ids of spare copies broadcast at most; more are joined by a shuffle."""

    dim: int = 64
    k: int = 5
    sample_rows: int = 200_000
    leaf_rows: int = 200
    max_leaves: int = 12_000
    branching: int = 16
    queries: int = 400
    recall: float = 0.99
    first_visits: int = 64
    cell_rows: int = 4_096
    block_rows: int = 16_384
    block_queries: int = 65_536
    broadcast_rows: int = 500_000
    seed: int = 11


class Tree:
    """Nodes in arrays: the children of node n are ``first[n] .. first[n] + count[n]``; ``leaf[n]`` is its number, or -1."""

    def __init__(self, centres: np.ndarray, first: np.ndarray, count: np.ndarray, leaf: np.ndarray):
        self.centres, self.first, self.count, self.leaf = centres, first, count, leaf
        self.leaves = int(leaf.max()) + 1
        self.width = int(count.max()) if len(count) else 0

    def _near(self, x: np.ndarray, node: int) -> np.ndarray:
        own = slice(self.first[node], self.first[node] + self.count[node])
        c = self.centres[own]
        return (c * c).sum(1)[None, :] - 2 * (x @ c.T)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        at = np.zeros(len(x), dtype=np.int64)
        active = np.arange(len(x))
        while len(active := active[self.leaf[at[active]] < 0]):
            for node, rows in _groups(at[active]):
                rows = active[rows]
                at[rows] = self.first[node] + self._near(x[rows], node).argmin(1)
        return self.leaf[at]

    def visit(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """The first ``leaves`` leaves of each query, best bin first; -1 where there are no more."""
        n, leaves = len(x), min(leaves, self.leaves)
        out, found = np.full((n, leaves), -1, dtype=np.int32), np.zeros(n, dtype=np.int64)
        queue, nodes = np.zeros((n, 1), dtype=np.float32), np.zeros((n, 1), dtype=np.int64)
        active = np.arange(n)
        while len(active):
            line = np.arange(len(active))
            best = queue.argmin(1)
            bound, node = queue[line, best], nodes[line, best]
            queue[line, best] = np.inf
            leaf = self.leaf[node]
            hit = (leaf >= 0) & np.isfinite(bound)
            rows = active[hit]
            out[rows, found[rows]] = leaf[hit]
            found[rows] += 1
            opened = np.flatnonzero((leaf < 0) & np.isfinite(bound))
            if len(opened):
                room = np.full((len(active), self.width), np.inf, dtype=np.float32)
                child = np.zeros((len(active), self.width), dtype=np.int64)
                for one, part in _groups(node[opened]):
                    part = opened[part]
                    room[part, : self.count[one]] = self._near(x[active[part]], one)
                    child[part, : self.count[one]] = np.arange(self.first[one], self.first[one] + self.count[one])
                queue, nodes = np.concatenate([queue, room], 1), np.concatenate([nodes, child], 1)
                if queue.shape[1] > 8 * self.width:  # bins so far down are let go; the few that would still have come up are missed in the calibration too, which makes up for them
                    keep = np.argpartition(queue, min(leaves, queue.shape[1] - 1), axis=1)[:, : max(leaves, 4 * self.width)]
                    queue, nodes = np.take_along_axis(queue, keep, 1), np.take_along_axis(nodes, keep, 1)
            on = (found[active] < leaves) & np.isfinite(queue.min(1))
            if not on.all():
                active, queue, nodes = active[on], queue[on], nodes[on]
        return out


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(values)]):
        yield int(ordered[a]), order[a:b]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        own = ((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)
        order = np.argsort(own, kind="stable")
        size = np.bincount(own, minlength=k)
        full = size > 0
        sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[full], axis=0)
        centres[full] = sums / size[full, None]
    own = ((centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)).argmin(1)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


def fit_tree(x: np.ndarray, leaf_rows: float, branching: int, max_leaves: int, seed: int) -> Tree:
    """Splits the sample by k-means until a part has no more than ``leaf_rows`` rows."""
    rng = np.random.default_rng(seed)
    leaf_rows = max(leaf_rows, len(x) / max_leaves * 2, 2)
    centres, first, count, parts = [x.mean(0) if len(x) else np.zeros(x.shape[1], np.float32)], [0], [0], [x]
    at = 0
    while at < len(parts):
        own = parts[at]
        k = min(branching, math.ceil(len(own) / leaf_rows))
        if k > 1:
            made, member = _kmeans(own, k, rng)
            if len(made) > 1:
                first[at], count[at] = len(parts), len(made)
                for j in range(len(made)):
                    centres.append(made[j]), first.append(0), count.append(0), parts.append(own[member == j])
        parts[at] = None
        at += 1
    counts = np.array(count, dtype=np.int64)
    leaf = np.where(counts == 0, np.cumsum(counts == 0) - 1, -1)
    return Tree(np.array(centres, dtype=np.float32), np.array(first, dtype=np.int64), counts, leaf)


def usable(vectors: DataFrame, dim: int, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``id, vec`` (of length 1) of the usable vectors: not null, ``dim`` finite numbers, not all zero."""
    v = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.select(F.col(id_col).alias("id"), v.alias("raw")).where(F.col("id").isNotNull() & (F.size(v) == dim) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    names = ["id", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim).astype(np.float64)
            x = (x / np.abs(x).max(1, keepdims=True)) if len(x) else x
            x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(x)], names=names)

    return good.mapInArrow(run, "id bigint, vec array<float>")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(sims.shape[1]), (len(sims), 1))


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """``h, n, ids`` per distinct vector: its number of rows and its ``k + 1`` least ids, taken in two steps so that no task sees all copies."""
    part = Window.partitionBy("h", "salt").orderBy("id")
    salted = rows.select("h", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    first = salted.select("h", "id", F.row_number().over(part).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("h", "salt")).alias("n"))
    few = first.where(F.col("rn") <= k + 1).groupBy("h")
    least = few.agg(F.sum(F.when(F.col("rn") == 1, F.col("n"))).alias("n"), F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    return least


def nearest(vectors: DataFrame, config: TreeConfig = TreeConfig(), id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``id, neighbour, sim``: the ``k`` most similar other vectors of every usable vector, by cosine.

    Unusable vectors (null, of another length, with NaN, infinite or null numbers, or all zero) and
    null ids neither ask nor answer. A tie goes to the smaller id. Fewer than ``k`` come out only if
    there are fewer other vectors. Ids must be distinct; an empty table gives no row, more columns are
    ignored. Neighbours are found with the calibrated recall; every row is indexed and asked for.
    """
    c, spark = config, vectors.sparkSession
    rows = usable(vectors, c.dim, id_col, vector_col).withColumn("h", F.concat(F.hex(F.xxhash64("vec")), F.hex(F.hash("vec"))))
    rows = materialise(rows)
    classes = materialise(_classes(rows, c.k))
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "id bigint, neighbour bigint, sim float")
    several = classes.where("n > 1")
    spare = materialise(rows.select("id", "h").join(broadcast_if_small(several, c.broadcast_rows).select("h", F.col("ids")[0].alias("rep")), "h").where("id <> rep").select("id"))
    reps = rows.select("id", "vec").join(broadcast_if_small(spare, c.broadcast_rows), "id", "left_anti")

    # a cut of the hash first, so that no more than a little over the sample is sorted in one place
    part = math.ceil(min(1.0, (1.05 * c.sample_rows + 1000) / total) * (1 << 30))
    mixed = F.xxhash64("id", F.lit(c.seed))
    sample = reps.where(F.pmod(mixed, F.lit(1 << 30)) < part).orderBy(mixed).limit(c.sample_rows).toArrow()
    x, ids = _matrix(sample.column("vec"), c.dim), sample.column("id").to_numpy()
    order = np.argsort(ids)  # the order rows arrive in must not matter
    x, ids = x[order], ids[order]
    tree = fit_tree(x, c.leaf_rows * len(x) / total, c.branching, c.max_leaves, c.seed)
    picked = np.random.default_rng(c.seed).permutation(len(x))
    asked = picked[: c.queries]
    visits = _calibrate(reps, tree, x[asked], ids[asked], c) if tree.leaves > 1 else 1
    layout = _layout(tree, x, x[picked[:5000]], visits, total, c)
    shared = spark.sparkContext.broadcast((tree, layout))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, layout = shared.value
        for b in batches:
            if b.num_rows:
                yield layout.spread(tree, visits, b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), c.dim))

    def search(group: pa.Table) -> pa.Table:
        m, ids = _matrix(group.column("vec"), c.dim), group.column("id").to_numpy()
        return _search(ids, m, group.column("leaf").to_numpy(), group.column("leaves").combine_chunks(), c.k)

    placed = reps.mapInArrow(place, "cell int, m int, q int, id bigint, vec array<float>, leaf int, leaves array<int>")
    partial = placed.groupBy("cell", "m", "q").applyInArrow(search, "id bigint, near array<struct<far:float,neighbour:bigint>>")
    # a row has k neighbours from each group it was sent to, a number that doesn't grow with copies
    others = partial.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, c.k).alias("near"))
    return _with_copies(rows, classes, others, c.k)


@dataclass(frozen=True)
class Layout:
    """Which cell of neighbouring leaves each leaf is in, and into how many blocks of members and of queries each cell is split."""

    cell: np.ndarray
    m_blocks: np.ndarray
    q_blocks: np.ndarray

    def spread(self, tree: Tree, visits: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        """Each row once for each group that it belongs to as a member or asks as a query; in its own group one copy serves as both.

        ``leaf`` is the row's leaf where it is a member, else -1; ``leaves`` are those it asks there.
        """
        own = tree.assign(x)
        seen = tree.visit(x, visits).astype(np.int64)
        seen[~(seen == own[:, None]).any(1), -1] = own[~(seen == own[:, None]).any(1)]
        row, column = np.nonzero(seen >= 0)
        leaf = seen[row, column]
        cell = self.cell[leaf]
        order = np.lexsort((cell, row))
        row, leaf, cell = row[order], leaf[order], cell[order]
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])]))
        size = np.diff(np.concatenate([start, [len(row)]]))
        g_row, g_cell = row[start], cell[start]
        mixed = (ids[g_row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        nm, nq = self.m_blocks[g_cell], self.q_blocks[g_cell]
        my_m, my_q = (mixed % nm.astype(np.uint64)).astype(np.int64), ((mixed >> np.uint64(8)) % nq.astype(np.uint64)).astype(np.int64)
        home = g_cell == self.cell[own[g_row]]
        # as a query: every block of members; as a member, besides: every other block of queries
        copies = nm + np.where(home, nq - 1, 0)
        at = np.repeat(np.arange(len(start)), copies)
        k = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
        asks = k < nm[at]
        j = k - nm[at]
        m = np.where(asks, k, my_m[at])
        q = np.where(asks, my_q[at], j + (j >= my_q[at]))
        member = home[at] & (m == my_m[at])
        lengths = np.where(asks, size[at], 0)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = leaf[np.repeat(start[at], lengths) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)]
        i32 = lambda v: pa.array(v.astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [i32(g_cell[at]), i32(m), i32(q), pa.array(ids[g_row[at]]), _lists(x[g_row[at]]), i32(np.where(member, own[g_row[at]], -1)), pa.ListArray.from_arrays(i32(offsets), i32(flat))],
            names=["cell", "m", "q", "id", "vec", "leaf", "leaves"],
        )


def _layout(tree: Tree, x: np.ndarray, asking: np.ndarray, visits: int, total: int, c: TreeConfig) -> Layout:
    """Groups neighbouring leaves into cells of about ``cell_rows`` rows, by the sample's share of each leaf, and splits the large ones."""
    rows = np.bincount(tree.assign(x), minlength=tree.leaves) * (total / len(x))
    size = max(c.cell_rows, min(8 * c.cell_rows, total // 64))  # some dozens of cells at least, so that there's work for many tasks
    cell = (np.cumsum(rows) - rows / 2) // size
    cell = np.unique(cell, return_inverse=True)[1]
    seen = tree.visit(asking, visits)
    held = np.bincount(cell, weights=rows)
    asked = np.bincount(cell[seen[seen >= 0]], minlength=len(held)) * (total / len(asking))
    blocks = lambda n, most: np.maximum(np.ceil(n / most), 1).astype(np.int64)
    return Layout(cell, blocks(held, c.block_rows), blocks(asked, c.block_queries))


def _search(ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, leaves: pa.ListArray, k: int) -> pa.Table:
    """The k most similar members for each row that asks, leaf by leaf."""
    counts = np.diff(leaves.offsets.to_numpy())
    wanted = leaves.flatten().to_numpy(zero_copy_only=False)
    asker = np.repeat(np.arange(len(ids)), counts)
    member = np.flatnonzero(leaf >= 0)
    of_leaf = {one: member[rows] for one, rows in _groups(leaf[member])}
    rows_out, near_out, sims_out = [], [], []
    for one, rows in _groups(wanted):
        if one not in of_leaf:
            continue
        mine = of_leaf[one]
        for a in range(0, len(rows), 512):
            q = asker[rows[a : a + 512]]
            for part in np.array_split(mine, max(1, len(mine) >> 14)):
                sims = x[q] @ x[part].T
                sims[q[:, None] == part[None, :]] = -2
                best = _best(sims, k)
                own = np.take_along_axis(sims, best, 1)
                good = own > -2
                rows_out.append(np.repeat(q, good.sum(1)))
                near_out.append(part[best][good])
                sims_out.append(own[good])
    cat = lambda v, kind: np.concatenate(v) if v else np.empty(0, kind)
    q, near, sims = cat(rows_out, np.int64), ids[cat(near_out, np.int64)], cat(sims_out, np.float32)
    order = np.lexsort((near, -sims, q))
    q, near, sims = q[order], near[order], sims[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]]))) if len(q) else q
    top = place < k
    q, near, sims = q[top], near[top], sims[top]
    askers, size = np.unique(q, return_counts=True)
    pairs = pa.StructArray.from_arrays([pa.array(-sims), pa.array(near)], names=["far", "neighbour"])
    return pa.table({"id": pa.array(ids[askers]), "near": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pairs)})


def _with_copies(rows: DataFrame, classes: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """Neighbours of every row from those of one row a distinct vector: its own copies first, then the copies of the classes near by."""
    of_class = classes.select(F.col("ids")[0].alias("rep"), "ids")
    near = others.select(F.col("id").alias("asker"), F.inline("near")).join(of_class.withColumnRenamed("rep", "neighbour"), "neighbour")
    near = near.select("asker", "far", F.explode("ids").alias("neighbour"))
    near = near.groupBy("asker").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "neighbour"))), 1, k).alias("near"))
    full = classes.select(F.col("ids")[0].alias("asker"), "h", "n", "ids").join(near, "asker", "left")
    none = F.array().cast("array<struct<far:float,neighbour:bigint>>")
    single = full.where(F.col("n") == 1).select(F.col("asker").alias("id"), F.inline("near"))
    copied = full.where(F.col("n") > 1).select("h", "n", "ids", F.coalesce("near", none).alias("near"))
    # hot classes, of which each has over ``hot`` rows, are few: they're counted and broadcast; the rest are joined by shuffle
    hot = 100_000
    of = rows.select("id", "h")
    large = copied.where(F.col("n") > hot)
    both = of.join(copied.where(F.col("n") <= hot), "h").unionByName(of.join(F.broadcast(large) if classes.where(F.col("n") > hot).count() <= hot else large, "h"))
    mine = F.filter("ids", lambda i: i != F.col("id"))
    own = F.transform(mine, lambda i: F.struct(F.lit(-1.0).cast("float").alias("far"), i.alias("neighbour")))
    multiple = both.select("id", F.inline(F.slice(F.concat(own, F.col("near")), 1, k)))
    return single.unionByName(multiple).select("id", "neighbour", (-F.col("far")).alias("sim"))


def _calibrate(reps: DataFrame, tree: Tree, x: np.ndarray, ids: np.ndarray, c: TreeConfig) -> int:
    """The fewest leaves to visit that hold the wanted share of the true neighbours, found over all rows."""
    shared = reps.sparkSession.sparkContext.broadcast((tree, x, ids))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, q, qid = shared.value
        for b in batches:
            m, mid = _matrix(b.column(1), c.dim), b.column(0).to_numpy(zero_copy_only=False)
            if not len(m):
                continue
            sims = q @ m.T
            sims[qid[:, None] == mid[None, :]] = -2
            best = _best(sims, c.k)
            leaf = np.full(len(m), -1)
            used = np.unique(best)
            leaf[used] = tree.assign(m[used])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), best.shape[1])), pa.array(np.take_along_axis(sims, best, 1).ravel()), pa.array(leaf[best].ravel())], names=["q", "sim", "leaf"])

    top = F.slice(F.sort_array(F.collect_list(F.struct("sim", "leaf")), asc=False), 1, c.k)
    found = reps.mapInArrow(exact, "q bigint, sim float, leaf bigint").where("sim > -2").groupBy("q").agg(top.alias("top")).collect()  # one row a calibration query
    width = c.first_visits
    while True:  # widened until the recall is reached, at the latest by all leaves
        order = tree.visit(x, width)
        where = {q: {int(leaf): k for k, leaf in enumerate(row) if leaf >= 0} for q, row in enumerate(order)}
        ranks = np.array([where[r["q"]].get(int(t["leaf"]), tree.leaves) for r in found for t in r["top"]])
        if not len(ranks):
            return 1
        need = int(np.sort(ranks)[int(np.ceil(c.recall * len(ranks))) - 1]) + 1
        if need <= min(width, tree.leaves) or width >= tree.leaves:
            return min(need, tree.leaves)
        width *= 4


def similar_pairs(vectors: DataFrame, config: TreeConfig = TreeConfig()) -> DataFrame:
    """``id_a, id_b``, the smaller first: pairs of which one is among the ``k`` nearest of the other."""
    near = nearest(vectors, config)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
