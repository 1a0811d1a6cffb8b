"""Exact top-k by inner product with M-trees searched best first.

Vectors are integers x.  With M the greatest norm of a tree, the point
(x, sqrt(M^2 - |x|^2)) has norm M for all, so the squared distance to a query
(q, 0) is |q|^2 + M^2 - 2 <q, x>: the nearest points have the greatest inner
products, in a metric space.  A tree holds up to TREE_ROWS vectors in paged
nodes; an entry has a routing point, a covering radius and the distance to its
parent, all stored.  Bounds take a slack above rounding; scores are exact.

Candidates are dealt to groups of some GROUP_ROWS; every group also gets all
queries, which are few beside the candidates.  A task streams a group: it builds
the trees from the candidates as they come, then searches each query in them.
So there is one plan for any number of queries, nothing is broadcast or passes
through the driver, and a task holds one group's trees.  The k best of each
query and group are merged by a window that keeps k per task first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm import store
from corvane.llm.kernel import runs, tidy

#: Vectors in a tree, entries in a leaf and in an inner node.
TREE_ROWS, LEAF, FANOUT = 8192, 128, 16
#: Candidates of a group, unless fewer keep all cores busy: 131072 * 64 longs are 64 MB.
GROUP_ROWS = 131_072
#: Greatest component for which double products of 1024 dimensions are whole.
SAFE = 1 << 21


def quantize(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null where the vector is null or a component is null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with one vector; beyond the range of a long, its end."""
    if not len(x) or max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) < SAFE:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = x.astype(object) @ q.astype(object)
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in exact], dtype=np.int64)


class MTree:
    """Pages of entries over points; arrays only."""

    @classmethod
    def build(cls, ids: np.ndarray, points: np.ndarray) -> MTree:
        self = cls()
        self.ids, self.points = ids, points
        real = points.astype(np.float64)
        squares = np.einsum("nd,nd->n", real, real)
        self.largest = np.array(squares.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.largest - squares, 0.0))
        self.real, self.whole, self.computed = real, np.abs(points).max(initial=0) < SAFE, 0
        lifted = np.column_stack((real, self.lift))
        pages: list[tuple] = []
        rng = np.random.default_rng(7)

        def far(rows: np.ndarray, router: int) -> np.ndarray:
            if router < 0:
                return np.zeros(len(rows))
            return np.sqrt(np.maximum(((lifted[rows] - lifted[router]) ** 2).sum(axis=1), 0.0))

        def page(rows: np.ndarray, router: int) -> int:
            place = len(pages)
            pages.append(None)
            if len(rows) <= LEAF:
                pages[place] = (router, rows, np.zeros(len(rows)), far(rows, router), np.full(len(rows), -1))
                return place
            k = min(FANOUT, -(-len(rows) // LEAF) + 1)
            pivots = rows[rng.choice(len(rows), k, replace=False)]
            centers = lifted[pivots]
            near = ((centers**2).sum(axis=1)[None, :] - 2 * lifted[rows] @ centers.T).argmin(axis=1)
            parts = [rows[near == i] for i in range(k)]
            if max(map(len, parts)) == len(rows):  # all points alike
                parts, pivots = np.array_split(rows, k), np.array([x[0] for x in np.array_split(rows, k)])
            entries = [(p, far(part, p).max(initial=0.0), page(part, p)) for p, part in zip(pivots, parts) if len(part)]
            routers = np.array([e[0] for e in entries])
            pages[place] = (router, routers, np.array([e[1] for e in entries]), far(routers, router), np.array([e[2] for e in entries]))
            return place

        page(np.arange(len(ids)), -1)
        self.page_start = np.concatenate(([0], np.cumsum([len(p[1]) for p in pages])))
        self.entry_point, self.entry_radius, self.entry_up, self.entry_child = (np.concatenate([p[i] for p in pages]) for i in (1, 2, 3, 4))
        return self

    def search(self, query_id: int, q: np.ndarray, best: Best) -> None:
        """Adds this tree's candidates for the query to ``best``; stops when no page can hold a better one.  ``computed`` counts the products."""
        real = q.astype(np.float64)
        base = float(real @ real) + float(self.largest)
        slack = 1e-6 + 1e-9 * np.sqrt(base)
        whole = self.whole and np.abs(q).max(initial=0) < SAFE

        def limit() -> float:
            worst = best.worst()
            return np.inf if worst is None else np.sqrt(max(base - 2.0 * worst, 0.0)) + slack

        queue = [(0.0, 0, -1.0)]
        while queue:
            low, page, up = heapq.heappop(queue)
            reach = limit()
            if low > reach:
                break
            a, b = self.page_start[page], self.page_start[page + 1]
            point, radius, child = self.entry_point[a:b], self.entry_radius[a:b], self.entry_child[a:b]
            if up >= 0:  # spares the distances that the stored one to the parent rules out
                some = np.abs(up - self.entry_up[a:b]) - radius <= reach
                point, radius, child = point[some], radius[some], child[some]
            if not len(point):
                continue
            self.computed += len(point)
            product = self.real[point] @ real
            if child[0] < 0:
                score = product.astype(np.int64) if whole else _scores(self.points[point], q)
                best.add(self.ids[point], score, query_id)
            else:
                distance = np.sqrt(np.maximum(base - 2.0 * product, 0.0))
                least = np.maximum(distance - radius - slack, 0.0)
                for i in np.flatnonzero(least <= reach):
                    heapq.heappush(queue, (float(least[i]), int(child[i]), float(distance[i])))


class Best:
    """The k highest scores, ties to smaller ids."""

    __slots__ = ("k", "scores", "ids")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def worst(self):
        return float(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, ids: np.ndarray, scores: np.ndarray, own: int) -> None:
        good = ids != own
        if len(self.scores) == self.k:
            good &= scores >= self.scores[-1]
        if not good.any():
            return
        scores, ids = np.concatenate((self.scores, scores[good])), np.concatenate((self.ids, ids[good]))
        by = np.lexsort((ids, -scores.astype(np.float64), ))[: self.k] if np.abs(scores).max() < 1 << 52 else np.array(sorted(range(len(ids)), key=lambda i: (-int(scores[i]), int(ids[i])))[: self.k])
        self.scores, self.ids = scores[by], ids[by]


def _matrix(vectors, width: int) -> np.ndarray:
    """The vectors as rows; missing trailing components are 0."""
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    row = np.repeat(np.arange(len(vectors)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat[offsets[0] : offsets[-1]]
    return out


def _searcher(width: int, k: int, schema: pa.Schema):
    """Streams rows sorted by group, candidates first: builds trees, then answers queries."""

    def run(batches):
        current, trees, held, size = None, [], [], 0

        def plant():
            nonlocal held, size
            if size:
                trees.append(MTree.build(*(np.concatenate(x) for x in zip(*held))))
            held, size = [], 0

        for batch in batches:
            group, asks, mark, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            points = _matrix(batch.column(4), width)
            start, length = runs(group * 2 + asks)
            for a, n in zip(start.tolist(), length.tolist()):
                if group[a] != current:
                    current, trees, held, size = group[a], [], [], 0
                if not asks[a]:
                    i = a
                    while i < a + n:
                        j = min(i + TREE_ROWS - size, a + n)
                        held.append((ids[i:j], points[i:j]))
                        size += j - i
                        i = j
                        if size == TREE_ROWS:
                            plant()
                    continue
                plant()
                found = []
                for i in range(a, a + n):
                    best = Best(k)  # a query's bound carries over from tree to tree
                    for tree in trees:
                        tree.search(int(ids[i]), points[i], best)
                    found.append(best)
                counts = [len(x.ids) for x in found]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mark[a : a + n], counts)), pa.array(np.repeat(ids[a : a + n], counts)), pa.array(np.concatenate([x.ids for x in found])), pa.array(np.concatenate([x.scores for x in found]))], schema=schema)

    return run


def top_k(candidates: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "vector", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all candidates, ties to the smaller id.

    Both tables have an integer id and an array of longs; other columns play no
    part.  Rows with a null id or vector take no part.  A query never meets rows
    of its own id; queries that repeat are asked once.  Missing trailing
    components count as 0.  Scores beyond the range of a long are its end.
    """
    spark = candidates.sparkSession
    store.ship(spark)
    take = lambda df: df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL").withColumn("mark", F.xxhash64("v"))
    rows, asked = take(candidates), take(queries).distinct()
    count, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(int(longest or 0), int(asked.agg(F.max(F.size("v"))).first()[0] or 0))
    groups = max(1, -(-count // GROUP_ROWS), min(-(-count // TREE_ROWS), 2 * spark.sparkContext.defaultParallelism))
    group = F.pmod(F.xxhash64("id", "mark", F.spark_partition_id()), F.lit(groups)).cast("int")  # equal rows of several partitions too are dealt apart
    row = lambda df, group, asks: df.select(group.alias("group"), F.lit(asks).alias("asks"), "mark", "id", "v")
    stream = row(rows, group, 0).union(row(asked, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), 1))
    dealt = stream.repartition(groups, "group").sortWithinPartitions("group", "asks")
    schema = T.StructType().add("mark", T.LongType()).add("query_id", T.LongType()).add("vec_id", T.LongType()).add("score", T.LongType())
    found = dealt.mapInArrow(tidy(_searcher(width, k, to_arrow_schema(schema))), schema)
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantize(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

QUERIES = {"op4_top_k": query}
ORACLES = {"op4_top_k": _SQL}
