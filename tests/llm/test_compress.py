import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import compress
from corvane.llm.mtree import quantize


def brute(rows, parts, entries, rounds):
    """rows: (key, label, vector); the contract, vector by vector."""
    width = -(-max((len(v) for _, _, v in rows), default=0) // parts)
    cut = lambda v, p: (list(v) + [0] * (parts * width - len(v)))[p * width : (p + 1) * width]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in ordered] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda x, p: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, _, v in rows:
                own[near(cut(v, p), p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(xs) for c in zip(*xs)] if xs else old for xs, old in zip(own, books[p])]
    out = []
    for key, label, v in rows:
        found = [near(cut(v, p), p) for p in range(parts)]
        out.append((key, label, [e for _, e in found], min(sum(d for d, _ in found), compress.LONG_MAX)))
    return out, books


@pytest.mark.parametrize("seed,spread,size,dimensions", [(1, 40, 150, 16), (2, 2, 200, 13), (3, 1 << 24, 60, 8), (4, 5, 9, 8)])
def test_against_brute_force(spark, seed, spread, size, dimensions):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, 7, None]), rng.choice([0, 1, None]), [rng.randrange(-spread, spread) for _ in range(rng.choice([dimensions, dimensions, 3]))]) for i in range(size)]
    rows += [rows[0]] * 40
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, vector array<long>, part string, value int").repartition(4)
    got, books = compress.compress(df, parts=4, entries=5, rounds=4)
    want, entries = brute(rows, 4, 5, 4)
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert books.values.tolist() == entries


def test_far_components(spark):
    rows = [(0, 0, [1 << 62, 0]), (1, 0, [-(1 << 62), 0]), (2, 0, [-(1 << 63), 1]), (3, None, [0, 0])]
    got, books = compress.compress(spark.createDataFrame(rows, "vec_id long, label int, vector array<long>"), parts=2, entries=2, rounds=3)
    want, entries = brute(rows, 2, 2, 3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and books.values.tolist() == entries


def test_rows_that_take_no_part(spark):
    rows = [(1, 1, None), (2, 1, [1.0, None]), (3, 1, [float("nan"), 0.0]), (4, 1, [float("inf"), 0.0]), (5, 1, [0.5, -0.0001]), (6, None, []), (None, None, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").select("vec_id", "label", quantize(F.col("embedding"), 4096).alias("vector"))
    got, books = compress.compress(df)
    assert {(r.vec_id, r.error) for r in got.collect()} == {(5, 0), (6, 0), (None, 0)} and books.values.shape == (8, 3, 1)
    nothing, books = compress.compress(df.limit(0))
    assert nothing.count() == 0 and books.values.size == 0
    blank, books = compress.compress(df.where("vec_id = 6"))
    assert [(r.code, r.error) for r in blank.collect()] == [([0] * 8, 0)]


def test_each_distinct_part_once(spark):
    """A vector that a third of all rows repeat is one weighted row a part."""
    rows = [(i, 0, [1, 2, 3, 4, 5, 6, 7, 8]) for i in range(100)] + [(100 + i, 1, [i] * 8) for i in range(20)]
    seen = []
    plain = compress.lloyd

    def lloyd(distinct, book, rounds):
        seen.append((distinct.count(), distinct.agg(F.sum("n")).first()[0]))
        return plain(distinct, book, rounds)

    compress.lloyd, kept = lloyd, compress.lloyd
    try:
        compress.compress(spark.createDataFrame(rows, "vec_id long, label int, vector array<long>"))
    finally:
        compress.lloyd = kept
    assert seen == [(160, 960)]
