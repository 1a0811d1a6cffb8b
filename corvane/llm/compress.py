"""Vector codes by part: distinct integer parts, weighted Lloyd, codes joined back.

Vectors of whole numbers are cut into equal consecutive parts.  Equal parts at
one position are one weighted row, so Lloyd's rounds read each distinct value
once, however often it occurs.  A round sums in tasks, then by (position, entry,
component); the driver holds the codebooks alone.  Codes and errors of the
distinct parts are joined back to the vectors at the end.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.llm import store
from corvane.llm.kernel import tidy
from corvane.llm.mtree import quantize

#: Parts of a vector, entries of a codebook, Lloyd rounds.
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Greatest component for which squared distances of 1024 components are whole in doubles.
SAFE = 1 << 20
LONG_MAX = (1 << 63) - 1

_SUMS = T.StructType().add("part", T.IntegerType()).add("entry", T.IntegerType()).add("at", T.IntegerType()).add("total", T.DecimalType(38, 0))


@dataclass
class Codebooks:
    """``values[part, entry, component]``: whole numbers."""

    values: np.ndarray

    def sha256(self) -> str:
        """Of all components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.values.ravel()).encode()).hexdigest()


def _largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and its squared distance (at most the end of a long)."""
    if max(_largest(x), _largest(entries)) < SAFE:
        real, centers = x.astype(np.float64), entries.astype(np.float64)
        far = (real**2).sum(axis=1)[:, None] - 2.0 * (real @ centers.T) + (centers**2).sum(axis=1)[None, :]
    else:
        far = ((x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(axis=2)
        if not x.shape[1]:
            far = np.zeros(far.shape)
    code = far.argmin(axis=1)
    least = far[np.arange(len(x)), code]
    return code, least.astype(np.int64) if least.dtype != object else np.array([min(int(d), LONG_MAX) for d in least], dtype=np.int64)


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    values = batch.column(1)
    flat = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width) if width else np.zeros((len(values), 0), dtype=np.int64)
    return batch.column(0).to_numpy(), flat


def _summer(book: np.ndarray):
    """Weighted sums (component -1: weights) of the distinct parts nearest to each entry; one set of rows a task."""
    parts, entries, width = book.shape

    def run(batches):
        total = np.zeros((parts, entries, width + 1), dtype=object)
        for batch in batches:
            part, x = _columns(batch, width)
            n = batch.column(2).to_numpy()
            small = (_largest(x) + 1) * (int(n.sum()) + 1) < 1 << 62
            for p in np.unique(part).tolist():
                own = part == p
                code, _ = nearest(x[own], book[p])
                weighted = np.column_stack((x[own], np.ones(int(own.sum()), dtype=np.int64))).astype(np.int64 if small else object) * n[own, None]
                sums = np.zeros((entries, width + 1), dtype=weighted.dtype)
                np.add.at(sums, code, weighted)
                total[p] += sums.astype(object)
        some = np.argwhere(np.broadcast_to(total[:, :, -1:] != 0, total.shape))
        if len(some):
            at = np.where(some[:, 2] == width, -1, some[:, 2]).astype(np.int32)
            sums = pa.array([Decimal(int(total[tuple(i)])) for i in some], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 0].astype(np.int32)), pa.array(some[:, 1].astype(np.int32)), pa.array(at), sums], names=["part", "entry", "at", "total"])

    return run


def _assigner(book: np.ndarray):
    """Adds each distinct part's entry and squared distance."""

    def run(batches):
        for batch in batches:
            part, x = _columns(batch, book.shape[2])
            code, error = np.zeros(len(part), dtype=np.int32), np.zeros(len(part), dtype=np.int64)
            for p in np.unique(part).tolist():
                own = part == p
                code[own], error[own] = nearest(x[own], book[p])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error)], names=["part", "value", "entry", "error"])

    return run


def lloyd(distinct: DataFrame, book: np.ndarray, rounds: int = ROUNDS) -> Codebooks:
    """Weighted Lloyd over (part int, value array<long>, n long), from the given entries; each becomes its parts' floored mean, unused ones stay.

    A round without a change is the last, as all later ones would be the same.
    """
    for _ in range(rounds):
        sums = distinct.select("part", "value", "n").mapInArrow(tidy(_summer(book)), _SUMS).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
        found = {(r.part, r.entry, r.at): int(r.total) for r in sums.collect()}  # at most parts x entries x (components + 1) rows
        after = book.copy()
        for (p, e, j), total in found.items():
            if j >= 0:
                after[p, e, j] = total // found[p, e, -1]
        if np.array_equal(after, book):
            break
        book = after
    return Codebooks(book)


def _saturated(error: Column) -> Column:
    """A sum of longs that stops at the end of a long."""
    return F.least(F.sum(error.cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "vector", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(key, label, code array<int>, error long) of each row, and the codebooks.

    ``vector`` is an array of longs.  Rows whose vector is null or holds a null
    are dropped; repeated rows and null keys or labels stay.  Missing trailing
    components, up to a multiple of ``parts``, count as 0.  Codebooks start as the parts of the
    rows with the smallest keys (nulls last, ties by vector); fewer rows give
    fewer entries, and an empty table gives none.  Errors beyond a long are its
    end.  Other columns play no part, whatever their names.
    """
    spark = vectors.sparkSession
    store.ship(spark)
    q = F.col(vector).cast("array<long>")
    kept = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), q.alias("q")).where(F.col("q").isNotNull() & F.forall("q", lambda x: x.isNotNull()))
    rows = store.publish(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    width = -(-int(rows.agg(F.max(F.size("q"))).first()[0] or 0) // parts)
    padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("q")))
    cut = rows.select("row", "key", "label", F.posexplode(F.array(*(F.slice(padded, i * width + 1, width) for i in range(parts)))).alias("part", "value"))
    distinct = store.publish(cut.groupBy("part", "value").agg(F.count("*").alias("n")), "distinct-parts")

    first = rows.orderBy(F.col("key").asc_nulls_last(), "q").limit(entries).select(padded.alias("v")).collect()
    start = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = lloyd(distinct, start, rounds)

    schema = distinct.select("part", "value").schema.add("entry", T.IntegerType()).add("error", T.LongType())
    assigned = distinct.select("part", "value").mapInArrow(tidy(_assigner(books.values)), schema)
    coded = cut.join(assigned, ["part", "value"]).groupBy("row").agg(
        F.first("key").alias(key), F.first("label").alias(label),
        F.transform(F.array_sort(F.collect_list(F.struct("part", "entry"))), lambda s: s["entry"]).alias("code"), _saturated(F.col("error")).alias("error"),
    )
    out = store.publish(coded.drop("row"), "vector-codes")
    for table in (rows, distinct):
        store.discard(table)
    return out, books


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", quantize(F.col("embedding"), 4096).alias("vector"))
    coded, books = compress(rows)
    by_label = coded.groupBy("label").agg(_saturated(F.col("error")).alias("label_error")).withColumnRenamed("label", "__label")
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    whole = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return whole.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """Every round over all parts, without weights."""
    far = "(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, part, any_value(v) AS v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, part, v, e, {far} AS d FROM p JOIN c{i} USING (part)) GROUP BY r, part)")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT part, e, list(floor(s / n) ORDER BY j) AS c FROM (
  SELECT part, e, j, sum(x) AS s, count(*) AS n FROM (SELECT part, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY part, e, j) GROUP BY part, e),
c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, b.c) AS c FROM c{i} b LEFT JOIN m{i} m USING (part, e))""")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
w AS (SELECT ceil(max(len(q)) / {PARTS}.0)::BIGINT AS w FROM k),
p AS MATERIALIZED (SELECT r, part, list_resize(q, w * {PARTS}, 0.0)[part * w + 1:part * w + w] AS v FROM k, w, range({PARTS}) AS t(part)),
s AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS e FROM k QUALIFY e < {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, e, v AS c FROM p JOIN s USING (r)),
{", ".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, e, j)) AS codebooks_sha256 FROM (SELECT part, e, unnest(c) AS x, generate_subscripts(c, 1) AS j FROM c{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h"""


QUERIES = {"op13_vector_codes": query}
ORACLES = {"op13_vector_codes": _sql()}
