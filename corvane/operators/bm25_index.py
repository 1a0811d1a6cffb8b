"""A persisted inverted index for BM25, whose blocks' greatest weights spare top-k most of them.

Chunks are dealt to ranges of RANGE, chunks of like terms side by side.  A
block holds one term's postings in one range, each a place and a count in one
number, and the greatest weight without idf.  Blocks lie in folders by a hash of the term, sorted by it,
so a search reads the folders of asked terms only.  The greatest weights give a
bound for each query and range; the ranges of the highest bounds are
scored first, and of the others those whose bound reaches the k-th score found.
The result is that of scoring all chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

from corvane.operators.retrieval import EPSILON, K1, B, top_per_query
from corvane.runtime import discard, exists, fresh_path, move, publish, ship

#: Chunks of a range, folders of terms, ranges of each query that are scored first.
RANGE, BUCKETS, FIRST = 64, 32, 4
#: Rows that are counted together; tokens for each further file of a folder.
TOGETHER, FILE_TOKENS = 1024, 1 << 26
#: What stands between terms on their way to a task; a term that holds it is refused.
BETWEEN = "\x1f"
#: The folder of the ranges' keys and sizes.
HEADS = -1
BLOCKS = "term string, range bigint, posts array<int>, n int, top double, bucket int"
#: Of the tables in a folder; kept indexes of another one are not read.
FORMAT = "4"
#: (query, term) weights that are searched together; more are dealt to turns by query.
TURN = 500_000
#: Scores are rounded to six places before they are ranked.
DIGITS, SLACK = 6, 2e-6


def _weight(k1: float, b: float, average: float):
    """The weight without idf of a term that occurs ``tf`` times in a chunk of ``dl`` terms."""
    return lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))


def _indexer(weight, schema: pa.Schema):
    """Streams sorted (part, key, terms joined by BETWEEN, their number, and with nulls): for each range a row of its keys and sizes (term null), and a row for each term.

    Terms are counted by sorting numbers of (range, term, place), some TOGETHER chunks at once.
    """
    # Closures, as tasks don't see a changed RANGE of the module.
    def column(name, values):
        return pa.array(values, schema.field(name).type)

    def counted(part, at, rows):
        first = (part << 33) + at
        keys, joined, held = rows.column("key"), pc.fill_null(rows.column("joined"), ""), rows.column("held").to_numpy()
        size = rows.column("size").to_numpy()
        ranges = -(-len(rows) // RANGE)
        cuts = pa.array(np.minimum(np.arange(ranges + 1) * RANGE, len(rows)), pa.int32())
        heads = {"range": column("range", first + np.arange(ranges)), "keys": pa.ListArray.from_arrays(cuts, keys), "sizes": pa.ListArray.from_arrays(cuts, pa.array(size, pa.int32()))}
        yield pa.RecordBatch.from_arrays([heads[f.name].cast(f.type) if f.name in heads else pa.nulls(ranges, f.type) for f in schema], schema=schema)
        some = np.flatnonzero(held > 0)
        lists = pc.split_pattern(joined.take(pa.array(some)), BETWEEN)
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        if (n != held[some]).any():
            raise ValueError("a term holds the character U+001F")
        if not len(n):
            return
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(some, n)
        number = (row // RANGE * len(coded.dictionary) + coded.indices.to_numpy()) * RANGE + row % RANGE
        number, tf = np.unique(number, return_counts=True)
        block, place = number // RANGE, number % RANGE
        start = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1))
        ends = np.concatenate((start, [len(block)])).astype(np.int32)
        of, code = np.divmod(block[start], len(coded.dictionary))
        top = np.maximum.reduceat(weight(tf, size[block // len(coded.dictionary) * RANGE + place]), start)
        made = {"range": column("range", first + of), "term": coded.dictionary.take(pa.array(code)), "posts": pa.ListArray.from_arrays(pa.array(ends), pa.array((place + RANGE * tf).astype(np.int32))), "n": column("n", np.diff(ends)), "top": column("top", top)}
        yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(len(start), f.type) for f in schema], schema=schema)

    def run(batches):
        kept, part, at = None, 0, 0
        step = max(1, TOGETHER // RANGE) * RANGE
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            rows, part = rows.combine_chunks(), batch.column(0)[0].as_py()
            whole = len(rows) // step * step
            for i in range(0, whole, step):
                yield from counted(part, at, rows.slice(i, step).combine_chunks().to_batches()[0])
                at += step // RANGE
            kept = rows.slice(whole)
        if kept is not None and len(kept):
            yield from counted(part, at, kept.combine_chunks().to_batches()[0])

    return run


class _Asked:
    """Weights of a turn's queries by term."""

    def __init__(self, terms: pa.Array, q: np.ndarray, w: np.ndarray):
        coded = terms.dictionary_encode()
        column = coded.indices.to_numpy()
        by = np.argsort(column, kind="stable")
        self.q, self.w = q[by], w[by]
        self.start = np.searchsorted(column[by], np.arange(len(coded.dictionary) + 1))
        self.place = dict(zip(coded.dictionary.to_pylist(), range(len(coded.dictionary))))
        self.queries = int(q.max(initial=-1)) + 1

    def matrix(self, columns: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and presence, chosen queries by terms."""
        place = np.full(self.queries, -1)
        place[chosen] = np.arange(len(chosen))
        n = self.start[columns + 1] - self.start[columns]
        ends = np.cumsum(n)
        at = np.repeat(self.start[columns] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        row, column = place[self.q[at]], np.repeat(np.arange(len(columns)), n)
        weights, there = np.zeros((len(chosen), len(columns))), np.zeros((len(chosen), len(columns)), dtype=np.float32)
        weights[row[row >= 0], column[row >= 0]] = self.w[at][row >= 0]
        there[row[row >= 0], column[row >= 0]] = 1
        return weights, there


def _scorer(asked, k: int, weight, schema: pa.Schema):
    """Streams (range, term, posts, queries, sizes), sorted by range; a range's first row names its queries and the sizes of its chunks.

    A range's scores are one product of (queries x terms) and (terms x places);
    each query keeps the best places, those that rounding may lift among the k best too.
    """

    def scores(number, chosen, dl, parts):
        columns, sizes, posts = (np.concatenate(x) for x in zip(*parts))
        held = np.zeros((len(columns), RANGE))
        tf, places = np.divmod(posts, RANGE)
        held[np.repeat(np.arange(len(columns)), sizes), places] = weight(tf, dl[places])
        for a in range(0, len(chosen), 1024):
            asks, there = asked.value.matrix(columns, chosen[a : a + 1024])
            s = np.where(there @ (held > 0).astype(np.float32) > 0, asks @ held, -np.inf)
            least = np.partition(s, -k, axis=1)[:, [-k]] - SLACK if k < RANGE else -np.inf
            row, place = np.nonzero((s >= least) & (s > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), number)), pa.array(chosen[a + row]), pa.array(place.astype(np.int32)), pa.array(s[row, place])], schema=schema)

    def run(batches):
        current, chosen, dl, parts = None, None, None, []
        for batch in batches:
            numbers, terms = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            columns = np.array([-1 if t is None else asked.value.place[t] for t in terms])
            lists = batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            posts = lists.flatten().to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if numbers[i] != current:
                    if parts:
                        yield from scores(current, chosen, dl, parts)
                    current, parts = int(numbers[i]), []
                    chosen, dl = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                    i += 1
                if i < j:
                    parts.append((columns[i:j], sizes[i:j], posts[offsets[i] : offsets[j]]))
        if parts:
            yield from scores(current, chosen, dl, parts)

    return run


@dataclass
class Search:
    """``rows``: (query key, rank, key, score). ``bounds`` and ``read`` have the (query, range) pairs with a shared term, and those whose blocks are read, by turn."""

    rows: DataFrame
    bounds: list[DataFrame]
    read: list[DataFrame]

    def share(self) -> float:
        """The share of pairs whose blocks are read."""
        total = sum(x.count() for x in self.bounds)
        return sum(x.count() for x in self.read) / total if total else 0.0


class Bm25Index:
    """An index in a folder: ``blocks``, ``terms`` (term, df, idf), ``keys``, ``sizes`` and, written last, ``stats``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        ship(spark)
        self.terms, self.keys, self.sizes = (spark.read.parquet(f"{path}/{x}") for x in ("terms", "keys", "sizes"))
        self.blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")  # no file says it of an empty corpus

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> Bm25Index | None:
        """The index of a folder; none where none was finished."""
        return cls(spark, path) if exists(spark, f"{path}/stats/_SUCCESS") else None

    @classmethod
    def build(cls, chunks: DataFrame, terms: Column, key: str, path: str, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> Bm25Index:
        """Indexes the chunks; texts are read and cut into terms once. Chunks with null terms count as empty; repeated keys stay apart.

        A negative idf becomes epsilon times the mean idf over all terms. The
        folder appears when the index is whole; an index that another session
        finished there meanwhile is taken. Terms go to tasks as one string a chunk, and
        blocks come from them once, straight into their folders.
        """
        spark, goal = chunks.sparkSession, path
        ship(spark)
        path = fresh_path(spark, "bm25-index")
        like = F.array_min(F.transform("terms", lambda t: F.xxhash64(t)))
        number = lambda c: F.when(F.col("terms").isNull(), 0).otherwise(F.size(c))
        cut = chunks.select(F.col(key).alias("key"), terms.alias("terms"))
        cut = cut.select("key", like.alias("like"), F.array_join("terms", BETWEEN).alias("joined"), number(F.array_compact("terms")).alias("held"), number("terms").alias("size"))
        rows = publish(cut, "bm25-terms")  # dealing to ranges reads it twice
        n, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        average = tokens / n if tokens else 1.0
        ordered = rows.repartitionByRange("like", "key").sortWithinPartitions("like", "key").select(F.spark_partition_id().cast("bigint").alias("part"), "key", "joined", "held", "size")
        ints = T.ArrayType(T.IntegerType())
        schema = T.StructType([T.StructField("range", T.LongType()), T.StructField("term", T.StringType()), T.StructField("posts", ints), T.StructField("n", T.IntegerType()), T.StructField("top", T.DoubleType()), T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)), T.StructField("sizes", ints)])
        made = ordered.mapInArrow(_indexer(_weight(k1, b, average), to_arrow_schema(schema)), schema).withColumn("bucket", F.when(F.col("term").isNull(), F.lit(HEADS)).otherwise(_bucket(F.col("term"))))
        dealt = made.repartition("bucket", F.pmod(F.xxhash64("term", "range"), F.lit(1 + tokens // FILE_TOKENS))).sortWithinPartitions("bucket", "term", "range")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        written = spark.read.schema(T.StructType([*schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{path}/blocks")
        heads = written.where(F.col("bucket") == HEADS)
        heads.select("range", F.posexplode("keys").alias("place", "key")).write.mode("overwrite").parquet(f"{path}/keys")
        heads.select("range", "sizes").write.mode("overwrite").parquet(f"{path}/sizes")
        df = publish(written.where(F.col("bucket") != HEADS).groupBy("term").agg(F.sum("n").alias("df")), "bm25-df")
        idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = df.agg(F.avg(idf)).first()[0]
        df.withColumn("bucket", _bucket(F.col("term"))).withColumn("idf", F.when(idf < 0, F.lit(epsilon * (mean or 0.0))).otherwise(idf)).write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(int(n), float(average), float(k1), float(b))], "n bigint, average double, k1 double, b double").write.mode("overwrite").parquet(f"{path}/stats")
        discard(df)
        discard(rows)
        move(spark, path, goal)
        return cls(spark, goal)

    def top(self, queries: DataFrame, query_key: str, k: int, first: int = FIRST) -> Search:
        """Each query's k best chunks that share a term with it; ties to the larger key.

        queries: (query_key, term); repeated terms count again. A query without
        a known term has no rows. ``first``: ranges a query scores before its
        others are compared with the k-th score. Beyond TURN weights, queries are
        searched in turns of some TURN, which tasks and the driver hold.
        """
        asked = queries.where("term IS NOT NULL").groupBy(query_key, "term").agg(F.count("*").alias("qtf")).join(self.terms, "term")
        asked = asked.select(F.col(query_key).alias("key"), "term", "bucket", (F.col("qtf") * F.col("idf")).alias("w"))
        small = asked.limit(TURN + 1).toArrow()
        if small.num_rows <= TURN:
            turns = [small]
        else:
            asked = publish(asked, "bm25-asked")
            n = -(-asked.count() // TURN)
            turns = [asked.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toArrow() for i in range(n)]
        stats = self.spark.read.parquet(f"{self.path}/stats").first()
        weight = _weight(stats.k1, stats.b, stats.average)
        found = [self._turn(turn, query_key, k, first, weight) for turn in turns]
        rows = found[0][0]
        for more, _, _ in found[1:]:
            rows = rows.unionByName(more)
        return Search(rows, [x[1] for x in found], [x[2] for x in found])

    def _turn(self, asked: pa.Table, query_key: str, k: int, first: int, weight) -> tuple[DataFrame, DataFrame, DataFrame]:
        spark = self.spark
        keys = asked.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        fields = T.StructType([T.StructField("asked_by", from_arrow_type(keys.dictionary.type)), T.StructField("q", T.LongType())])
        numbers = spark.createDataFrame(pa.table({"asked_by": keys.dictionary, "q": pa.array(np.arange(len(keys.dictionary)))}), fields)
        q, w = keys.indices.to_numpy().astype(np.int64), asked.column("w").to_numpy()
        terms = asked.column("term").combine_chunks()
        weights = F.broadcast(spark.createDataFrame(pa.table({"term": terms, "q": q, "w": w}), "term string, q bigint, w double"))  # at most some TURN rows
        buckets = sorted(set(asked.column("bucket").to_pylist()))
        blocks = self.blocks.where(F.col("bucket").isin(buckets))
        bound = F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("top")).alias("bound")
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "range")
        bounds = publish(blocks.select("term", "range", "top").join(weights, "term").groupBy("q", "range").agg(bound).withColumn("place", F.row_number().over(order)), "bm25-bounds")
        held = spark.sparkContext.broadcast(_Asked(terms, q, w))
        blocks = blocks.join(weights.select("term").distinct(), "term", "left_semi")
        before = bounds.where(F.col("place") <= first).select("q", "range")
        early = publish(self._scored(blocks, held, before, k, weight), "bm25-early")
        worst = top_per_query(early, "q", "key", k, DIGITS).where(F.col("rank") == k).select("q", F.col("score").alias("worst"))
        later = bounds.where(F.col("place") > first).join(worst, "q", "left").where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst") - SLACK)).select("q", "range")
        rows = top_per_query(early.unionByName(self._scored(blocks, held, later, k, weight)), "q", "key", k, DIGITS).join(numbers, "q")
        return rows.select(F.col("asked_by").alias(query_key), "rank", "key", "score"), bounds, before.unionByName(later)

    def _scored(self, blocks: DataFrame, asked, pairs: DataFrame, k: int, weight) -> DataFrame:
        """(q, key, score) of the best chunks of (q, range) pairs."""
        heads = pairs.groupBy("range").agg(F.collect_list("q").alias("queries")).join(self.sizes, "range")  # a turn's queries at most
        met = blocks.join(heads.select("range"), "range", "left_semi").select("range", "term", "posts", F.lit(None).cast("array<bigint>").alias("queries"), F.lit(None).cast("array<int>").alias("sizes"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("posts", "array<int>"))]
        stream = met.unionByName(heads.select("range", *none, "queries", "sizes")).repartition(F.xxhash64("range")).sortWithinPartitions("range", F.col("term").asc_nulls_first())
        schema = T.StructType([T.StructField("range", T.LongType()), T.StructField("q", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("score", T.DoubleType())])
        scores = stream.mapInArrow(_scorer(asked, k, weight, to_arrow_schema(schema)), schema)
        return scores.join(self.keys, ["range", "place"]).select("q", "key", "score")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")
