import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import mtree


def brute(vectors, queries, k):
    out = set()
    for q, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in vectors if c != q))[:k]
        out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)}
    return out


@pytest.mark.parametrize("spread,tree_rows", [(1000, 64), (3, 40), (1000, 8192), (10**7, 64)])
def test_against_brute_force(spark, monkeypatch, spread, tree_rows):
    monkeypatch.setattr(mtree, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(mtree, "LEAF", 8)
    monkeypatch.setattr(mtree, "FANOUT", 4)
    monkeypatch.setattr(mtree, "GROUP_ROWS", 100)
    rng = random.Random(spread + tree_rows)
    centers = [[rng.randrange(-spread, spread) for _ in range(6)] for _ in range(5)]
    vectors = [(i, [c + rng.randrange(-spread // 9 - 1, spread // 9 + 2) for c in rng.choice(centers)]) for i in range(300)] + [(300 + i, [spread] * 6) for i in range(20)] + [(400, [0] * 6)]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, vector array<long>, id int, mark string").repartition(3)
    got = {tuple(r) for r in mtree.top_k(df, df.where("vec_id % 20 = 0"), k=5).collect()}
    assert got == brute(vectors, [x for x in vectors if x[0] % 20 == 0], 5)


def test_quantize_and_rows_that_take_no_part(spark):
    rows = [(0, [0.5, -0.25]), (1, None), (2, [1.0, None]), (3, [math.nan, 0.0]), (4, [math.inf, 0.0]), (5, [0.0009765624, -0.0001]), (None, [1.0, 1.0]), (0, [0.5, -0.25]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("vector", mtree.quantize(F.col("embedding")))
    assert [r.vector for r in df.orderBy("vec_id").where("vec_id >= 1").collect()] == [None, None, None, None, [0, -1], []]
    got = {tuple(r) for r in mtree.top_k(df, df.where("vec_id % 100 = 0")).collect()}
    assert got == {(0, 1, 5, 256), (0, 2, 6, 0)}
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0
    assert mtree.top_k(df, df.where("vec_id = 1")).count() == 0


def test_scores_beyond_doubles(spark):
    big = 1 << 29
    df = spark.createDataFrame([(0, [big + 1, 1]), (1, [big, 3]), (2, [big, 2])], "vec_id long, vector array<long>")
    got = [(r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, (big + 1) * big + 3), (2, (big + 1) * big + 2)]


def test_repeated_rows_and_queries(spark):
    rows = [(i % 3, [i % 3 + 1, 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(df, df.where("vec_id = 0"), k=30).collect())
    assert got == [(0, i + 1, 2, 7) for i in range(20)] + [(0, i + 21, 1, 6) for i in range(10)]


@pytest.mark.parametrize("dimensions,clusters,most", [(8, 60, 0.5), (64, 60, 0.5), (64, 0, 1.02)])
def test_bounds_spare_computations(dimensions, clusters, most):
    """Clustered vectors spare at least half of all products; even noise in 64 dimensions spares none."""
    rng = np.random.default_rng(1)
    noise = rng.standard_normal((8192, dimensions))
    centers = rng.standard_normal((clusters, dimensions)) if clusters else None
    x = centers[rng.integers(0, clusters, 8192)] + 0.1 * noise if clusters else noise
    points = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    tree = mtree.MTree.build(np.arange(8192), points)
    for i in range(0, 8192, 100):
        best = mtree.Best(10)
        tree.search(i, points[i], best)
        scores = points @ points[i]
        order = [j for j in np.lexsort((np.arange(8192), -scores)) if j != i][:10]
        assert best.ids.tolist() == order
    assert tree.computed < most * 8192 * 82
    if not clusters:
        assert tree.computed > 0.9 * 8192 * 82
