"""BM25 and cosine retrieval, top-k per query, and reassembly in source order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corvane.runtime import ship

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Fixed value: what stands where chunks were left out.
OMITTED = "\n\n...<omitted chunks>...\n\n"
#: Vectors, and queries, of one product of cosine top-k; offers that a task holds back.
TILE, HELD = 1024, 1 << 20


def document_frequency(chunks: DataFrame, terms: Column) -> DataFrame:
    """(term, df): in how many chunks each term occurs, counted from distinct terms, so tasks sum up before the shuffle.

    An outer explode infers no filter on the terms' number, which would make them twice.
    """
    return chunks.select(F.explode_outer(F.array_distinct(terms)).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))


def bm25(chunks: DataFrame, terms: Column, queries: DataFrame, key: str, query_key: str, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(query_key, key, score) of chunks that share a term with the query, Okapi weights.

    queries: (query_key, term); repeated terms count again. A negative idf
    becomes epsilon times the mean idf over all terms. One plan without jobs of
    its own: postings of asked terms are dealt by chunk, so no term is a hot
    key, and all sums of a chunk stay where its postings are; the weights join
    by broadcast where Spark finds them small.
    """
    df = document_frequency(chunks, terms)
    size = chunks.agg(F.count("*").alias("n"), F.avg(F.size(terms)).alias("avgdl"))
    same = df.groupBy("df").agg(F.count("*").alias("c"))  # terms of equal frequency, few rows
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = same.join(F.broadcast(size), how="cross").agg((F.sum(F.col("c") * idf) / F.sum("c")).alias("mean_idf"))
    whole = F.broadcast(size.join(F.broadcast(mean), how="cross"))  # one row
    asked = queries.groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    weighed = asked.join(df, "term").join(whole, how="cross")
    weights = weighed.select(query_key, "term", (F.col("qtf") * F.when(idf < 0, epsilon * F.col("mean_idf")).otherwise(idf)).alias("w"), "avgdl")
    held = chunks.select(key, terms.alias("terms")).select(key, F.size("terms").alias("dl"), F.explode_outer("terms").alias("term"))
    postings = held.join(queries.select("term").distinct(), "term").groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("w") * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    return postings.repartition(key).join(weights, "term").groupBy(query_key, key).agg(F.sum(part).alias("score"))


def top_per_query(scores: DataFrame, query_key: str, key: str, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query, with rank from 1; scores rounded before ranking, ties to the larger key."""
    rounded = scores.withColumn("score", F.round("score", digits))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.desc(key))
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def reassemble(chosen: DataFrame, query_key: str, source: str, idx: str, chunk: str, separator: str = OMITTED, context: str | None = None) -> DataFrame:
    """(query_key, source, text): chosen chunks in source order, a separator where ones were left out.

    context: a column whose text chunks are left out if it holds them already.
    """
    rows = chosen if context is None else chosen.where(~F.contains(F.coalesce(F.col(context), F.lit("")), F.col(chunk)))
    w = Window.partitionBy(query_key, source).orderBy(idx)
    gap = F.when(F.col(idx) != F.lag(idx).over(w) + 1, F.lit(separator)).otherwise(F.lit(""))
    piece = rows.withColumn("__piece", F.concat(gap, F.col(chunk)))
    ordered = piece.groupBy(query_key, source).agg(F.array_sort(F.collect_list(F.struct(idx, "__piece"))).alias("p"))
    return ordered.select(query_key, source, F.array_join(F.transform("p", lambda x: x["__piece"]), "").alias("text"))


def as_tool(requests: DataFrame, chunks: DataFrame, terms, key: str, source: str, idx: str, chunk: str, k: int, tool: str = "retrieve") -> DataFrame:
    """(idx, tool, success, error, response) of retrieval requests (idx, input): the k best chunks of each in source order.

    terms gives the terms of a text column. A request that no chunk shares a
    term with succeeds with an empty response; one without terms is an error.
    """
    asked = requests.select(F.col("idx").alias("__q"), F.explode(terms(F.col("input"))).alias("term"))
    best = top_per_query(bm25(chunks, terms(F.col(chunk)), asked, key, "__q"), "__q", key, k).join(chunks, key)
    texts = reassemble(best, "__q", source, idx, chunk)
    found = texts.groupBy("__q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(source, "text"))), lambda x: x["text"]), "\n\n").alias("__r"))
    has = F.size(terms(F.col("input"))) > 0
    out = requests.join(found, requests["idx"] == found["__q"], "left")
    return out.select("idx", F.lit(tool).alias("tool"), F.coalesce(has, F.lit(False)).alias("success"), F.when(~F.coalesce(has, F.lit(False)), "nothing asked").alias("error"), F.when(has, F.coalesce("__r", F.lit(""))).alias("response"))


def _products(asked, k: int, slack: float, schema: pa.Schema):
    """(query_id, key, score) of a task's best vectors for each query: products of TILE vectors with TILE queries.

    What a batch offers is held back until all of it is seen, in portions of HELD, so memory doesn't grow with queries or vectors.
    """

    def run(batches):
        names, units = asked.value
        unknown = {x: i for i, x in enumerate(names.to_pylist())}
        best = np.full((len(units), k), -np.inf)

        def offers(s, first, own):
            """Places and scores of a tile that may be among the k best so far."""
            s[np.isnan(s)] = -np.inf
            if own:
                s[tuple(zip(*own))] = -np.inf
            seen = best[first : first + len(s)]
            low = seen[:, 0]
            if s.shape[1] > k:
                top = np.partition(s, -k, axis=1)[:, -k:]
                low = np.maximum(low, top[:, 0])
            else:
                top = s
            row, column = np.nonzero((s >= low[:, None] - slack) & (s > -np.inf))
            best[first : first + len(s)] = np.sort(np.concatenate((seen, top), axis=1), axis=1)[:, -k:]
            return first + row, column, s[row, column]

        def handed(keys, held):
            row, column, score = (np.concatenate(x) for x in zip(*held))
            kept = score >= best[row, 0] - slack
            row, column, score = row[kept], column[kept], score[kept]
            if len(row):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), keys.take(pa.array(column)), pa.array(score)], schema=schema)

        for batch in batches:
            size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(size == units.shape[1])
            keys, lists = (batch.column(i).take(pa.array(fit)) for i in range(2))
            known = [(unknown[x], j) for j, x in enumerate(keys.to_pylist()) if x in unknown]
            held, n = [], 0
            for at in range(0, len(fit), TILE):
                vectors = lists[at : at + TILE].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, units.shape[1])
                with np.errstate(invalid="ignore", divide="ignore"):
                    vectors = (vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]).T
                for first in range(0, len(units), TILE):
                    with np.errstate(invalid="ignore"):
                        s = units[first : first + TILE] @ vectors
                    own = [(i - first, j - at) for i, j in known if 0 <= i - first < TILE and 0 <= j - at < TILE]
                    row, column, score = offers(s, first, own)
                    held.append((row, at + column, score))
                    n += len(row)
                    if n > HELD:
                        yield from handed(keys, held)
                        held, n = [], 0
            if held:
                yield from handed(keys, held)

    return run


def cosine_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 4096, digits: int = 5) -> DataFrame:
    """(query_id, key, score): each query's k best other vectors; ties to the larger key.

    queries: (query_id, q), a stated set of vectors of one length. They are broadcast in
    blocks of some ``block``, each with a pass over the vectors; a task multiplies its
    batches with a block in tiles and hands on what may be among the k best of
    what it has seen. Null vectors, those of zeros, with null or NaN components or of
    another length have no score and are left out.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(vectors.sparkSession)
    whole = F.forall("q", lambda x: x.isNotNull())
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where(F.col("q").isNotNull() & whole)
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    n = max(1, -(-asked.count() // block))
    schema = StructType([asked.schema["query_id"], rows.schema[key], StructField("score", DoubleType())])
    out = None
    for i in range(n):
        part = (asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toArrow()
        lists = part.column("q").combine_chunks()
        width = len(lists[0]) if len(lists) else 0
        q = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)
        with np.errstate(invalid="ignore", divide="ignore"):
            units = q / np.sqrt((q**2).sum(axis=1))[:, None]
        held = vectors.sparkSession.sparkContext.broadcast((part.column("query_id").combine_chunks(), units))
        found = rows.mapInArrow(_products(held, k, 2 * 10.0**-digits, to_arrow_schema(schema)), schema)
        out = found if out is None else out.unionByName(found)
    return top_per_query(out, "query_id", key, k, digits)
