"""Similar vectors against brute force."""

import numpy as np
from compare import ROOT

from meshloom.llm import vectors as V

SCHEMA = "id long, embedding array<float>, vec string"


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in near[i] if s[i, j] > -2}


def test_recall_on_random_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(150, 64))
    x = np.repeat(centres, 12, axis=0) + rng.normal(size=(1800, 64)) * 0.3
    x *= rng.uniform(0.5, 3, size=(1800, 1))
    df = spark.createDataFrame([(i, [float(v) for v in row], "clash") for i, row in enumerate(x)], SCHEMA)
    config = V.TreeConfig(leaf_rows=40, cell_rows=200, block_rows=64, block_queries=100)
    got, want = {tuple(r) for r in V.similar_pairs(df, config).collect()}, brute(range(len(x)), x)
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_recall_on_the_tables(spark):
    from meshloom.sources.tables import read

    pages = read(spark, f"{ROOT}/sf0.01", "pages")
    rows = [(r.id, r.embedding) for r in V.usable(pages, 64).withColumnRenamed("vec", "embedding").collect()]
    want = brute([i for i, _ in rows], np.array([e for _, e in rows], dtype=float))
    got = {tuple(r) for r in V.similar_pairs(pages).collect()}
    assert len(got & want) / len(want) > 0.95


def test_unusable_and_copies(spark):
    rng = np.random.default_rng(2)
    base = [[float(v) for v in rng.normal(size=64)] for _ in range(8)]
    rows = [(i, e, "") for i, e in enumerate(base)]
    rows += [(100 + i, base[0], "") for i in range(40)]  # more copies than neighbours
    rows += [(200, [2 * v for v in base[1]], ""), (300, None, ""), (301, [0.0] * 64, ""), (302, [float("nan")] * 64, ""), (303, [1.0] * 63, ""), (304, [float("inf")] + [1.0] * 63, ""), (None, base[2], "")]
    near = V.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in near:
        by.setdefault(r.id, []).append((r.neighbour, r.sim))
    assert set(by) == {*range(8), *range(100, 140), 200}
    assert all(len(v) == 5 and r not in [n for n, _ in v] for r, v in by.items())
    assert {n for n, _ in by[0]} == {100, 101, 102, 103, 104} and {n for n, _ in by[139]} == {0, 100, 101, 102, 103}
    assert by[1][0][0] == 200 or 200 in [n for n, _ in by[1]]


def test_few_and_none(spark):
    assert V.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64, "")], SCHEMA)
    assert V.similar_pairs(one).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 64, ""), (2, [1.0] * 63 + [2.0], "")], SCHEMA)
    assert [tuple(r) for r in V.similar_pairs(two).collect()] == [(1, 2)]


def test_best_bin_first_reaches_every_leaf():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    tree = V.fit_tree(x, 20, 6, 1000, 1)
    seen = tree.visit(x[:50], tree.leaves)
    assert all(sorted(row) == list(range(tree.leaves)) for row in seen.tolist())


def test_the_shuffle_join_gives_the_same(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(30, 64)), 4, axis=0)
    x[::2] += rng.normal(size=(60, 64)) * 0.1
    df = spark.createDataFrame([(i, [float(v) for v in row], "") for i, row in enumerate(x)], SCHEMA)
    a = {tuple(r) for r in V.nearest(df).select("id", "neighbour").collect()}
    assert a == {tuple(r) for r in V.nearest(df, V.TreeConfig(broadcast_rows=-1)).select("id", "neighbour").collect()}
