"""Elements from messages, greedy packing into sequences of fixed length, and collation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.runtime import publish, ship

#: Elements of a range that one task folds.
RANGE_ROWS = 1_000_000
#: Marker tokens by model family and role (start, end, after the end).
MARKERS = (
    ("llama", "user", [128006, 882, 128007, 271], [128009], []),
    ("llama", "assistant", [128006, 78191, 128007, 271], [128009], []),
    ("llama", "system", [128006, 9125, 128007, 271], [128009], []),
    ("qwen", "user", [151644, 872, 198], [151645], [198]),
    ("qwen", "assistant", [151644, 77091, 198], [151645], [198]),
    ("qwen", "system", [151644, 8948, 198], [151645], [198]),
)


def markers(spark: SparkSession) -> DataFrame:
    """(family, role, start_ids, end_ids, extra_ids)."""
    return spark.createDataFrame(list(MARKERS), "family string, role string, start_ids array<int>, end_ids array<int>, extra_ids array<int>")


def build_elements(messages: DataFrame, family: str, key: str = "conv_id") -> DataFrame:
    """(key, input_ids, targets): one element a conversation from (key, turn, role, token_ids).

    Each message is its markers around its tokens. Tokens of the assistant and
    the end marker are targets: array<struct<token_idx, token_id>> by place.
    """
    spark = messages.sparkSession
    table = F.broadcast(markers(spark).where(F.col("family") == family))  # three rows
    parts = messages.join(table, "role").select(key, "turn", "role", F.concat("start_ids", "token_ids", "end_ids", "extra_ids").alias("ids"), F.size("start_ids").alias("head"), (F.size("token_ids") + F.size("end_ids")).alias("body"))
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum(F.size("ids")).over(w), F.lit(0)).cast("int"))
    own = F.transform(F.slice("ids", F.col("head") + 1, F.col("body")), lambda t, i: F.struct((F.col("offset") + F.col("head") + i).alias("token_idx"), t.alias("token_id")))
    parts = parts.withColumn("own", F.when(F.col("role") == "assistant", own).otherwise(F.array().cast("array<struct<token_idx:int,token_id:int>>")))
    ordered = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "ids", "own"))).alias("m"))
    return ordered.select(key, F.flatten(F.transform("m", lambda x: x["ids"])).alias("input_ids"), F.flatten(F.transform("m", lambda x: x["own"])).alias("targets"))


def cut_system_prompt(tokens: Column, most: int) -> Column:
    """At most ``most`` tokens, of which the last stays the end marker."""
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, most - 1), F.array(F.element_at(tokens, -1))))


def _numbered(schema: pa.Schema):
    """Adds to a sorted range's rows their place in it and the tokens before them."""

    def run(batches):
        at, used = 0, 0
        for batch in batches:
            size = batch.column(1).to_numpy()
            before = used + np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + len(size))), pa.array(before)], schema=schema)
            at, used = at + len(size), used + int(size.sum())

    return run


def _following(start: np.ndarray, size: np.ndarray, index: np.ndarray, own: int, length: int, truncate: bool) -> np.ndarray:
    """For each of the first ``own`` elements, were it a batch's first, the index of the next batch's first; -1 at the end of all.

    ``start``: tokens before each element. The first element that goes beyond the
    length is deferred, or admitted by ``truncate``; where nothing but elements
    without tokens precede it, it stands alone with them.
    """
    beyond = np.searchsorted(start + size, start[:own] + length, side="right")
    e = np.minimum(beyond, len(start) - 1)
    joins = truncate | (start[e] == start[:own])
    return np.where(beyond == len(start), -1, index[e] + joins)


def _streamed(run_range):
    """Calls ``run_range(range, columns)`` for each range of a stream sorted by range."""

    def run(batches):
        current, held = None, []
        for batch in batches:
            ranges = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if ranges[a] != current:
                    if held:
                        yield from run_range(pa.Table.from_batches(held))
                    current, held = ranges[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield from run_range(pa.Table.from_batches(held))

    return run


def _exits(length: int, truncate: bool, total: int):
    """(at, to, n): for each element where a batch may begin that an earlier range's batch precedes, the first batch start beyond its range (null at the end of all) and the batches before it."""

    def run_range(rows: pa.Table):
        ahead, index, start, size = (rows.column(i).to_numpy() for i in (1, 2, 3, 4))
        own = int((ahead == 0).sum())
        low, begin = int(index[0]), int(start[0])
        to = _following(start, size, index, own, length, truncate)
        to = np.where(to >= total, -1, to).tolist()
        count = [1] * own
        for s in range(own - 1, -1, -1):
            if 0 <= to[s] < low + own:
                n = to[s] - low
                to[s], count[s] = to[n], count[n] + 1
        # an exit follows or is an element that starts at most one length beyond its range
        head = np.flatnonzero(np.concatenate(([True], start[: own - 1] <= begin + length)))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(head), int(rows.column(0)[0].as_py()))), pa.array(low + head),
            pa.array([to[s] if to[s] >= 0 else None for s in head], pa.int64()), pa.array([count[s] for s in head], pa.int64()),
        ], names=["range", "at", "to", "n"])

    return _streamed(run_range)


def _numbers(length: int, truncate: bool, schema: pa.Schema):
    """(key, batch) of each range's elements, given the batches that begin before it and its first start."""

    def run_range(rows: pa.Table):
        index, start, size, entry, before = (rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 6, 7))
        own = len(index)
        low = int(index[0])
        begins = np.zeros(own, dtype=np.int64)
        s = int(entry[0]) - low if entry[0] >= 0 else own
        to = (_following(start, size, index, own, length, truncate) - low).tolist()
        while 0 <= s < own:
            begins[s] = 1
            s = to[s]
        batch = int(before[0]) - 1 + np.cumsum(begins)
        yield from pa.table([rows.column(5), pa.chunked_array([batch])], schema=schema).to_batches()

    return _streamed(run_range)


def _on_the_way(nodes: DataFrame) -> DataFrame:
    """(at, before) of the batch starts that lead from the first element through the ranges, by pointer doubling; before: batches that begin earlier.

    Rounds are as many as the logarithm of the ranges passed.
    """
    jumps = nodes.select("at", "to", "n").where("to IS NOT NULL")
    seen = nodes.where("at = 0").select("at", F.lit(0).cast("bigint").alias("before"))
    while True:
        jumps, seen = publish(jumps, "jumps"), publish(seen, "starts")
        if jumps.isEmpty():
            return seen
        seen = seen.unionByName(seen.join(jumps, "at").select(F.col("to").alias("at"), (F.col("before") + F.col("n")).alias("before")))
        on = jumps.select(F.col("at").alias("to"), F.col("to").alias("further"), F.col("n").alias("more"))
        jumps = jumps.join(on, "to").select("at", F.col("further").alias("to"), (F.col("n") + F.col("more")).alias("n"))


def pack(elements: DataFrame, order: Column, size: Column, key: str, length: int, mode: str = "pad") -> DataFrame:
    """(key, batch): greedy packing in a total order, the same as one fold over all elements, however they are partitioned.

    An element longer than a sequence stands alone. Where the next element
    doesn't fit, ``pad`` defers it and ``truncate`` admits it and closes the
    batch. Null and negative sizes count as 0; ties of the order go by key, then
    size. Repeated rows stay.

    Elements are dealt to sorted ranges of some RANGE_ROWS. Where a batch begins
    decides where the next one does; so each range tells, for each element that an earlier
    range's last batch may end before, where the batches from there leave the range and
    how many they are. These few steps are composed by pointer doubling, which
    gives each range its first start, and then every range is folded on its own.
    The driver holds one row a range.
    """
    if mode not in ("pad", "truncate"):
        raise ValueError(mode)
    truncate, spark = mode == "truncate", elements.sparkSession
    ship(spark)
    rows = elements.select(F.col(key), F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0)).alias("size"), order.alias("order"), F.monotonically_increasing_id().alias("tie"))
    total = elements.count()
    n, by = max(1, -(-total // RANGE_ROWS)), ["order", key, "size", "tie"]
    ranged = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).select(key, "size", F.spark_partition_id().cast("bigint").alias("range"))
    plain = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("size", T.LongType()), T.StructField("range", T.LongType())])
    schema = T.StructType([*plain.fields]).add("at", T.LongType()).add("start", T.LongType())
    placed = ranged.toDF("key", "size", "range").mapInArrow(_numbered(to_arrow_schema(schema)), schema)
    out = T.StructType([rows.schema[key], T.StructField("batch", T.LongType())])
    fold = _numbers(length, truncate, to_arrow_schema(out))
    columns = lambda df: df.select("range", F.lit(0).cast("bigint").alias("ahead"), (F.col("i0") + F.col("at")).alias("index"), (F.col("p0") + F.col("start")).alias("start"), "size", "key", "entry", "before")
    if n == 1:
        one = placed.select("*", *(F.lit(0).cast("bigint").alias(c) for c in ("i0", "p0", "entry", "before")))
        return columns(one).mapInArrow(fold, out)

    placed = publish(placed, "packed-ranges")
    sums = {r["range"]: (r["n"], r["tokens"]) for r in placed.groupBy("range").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).collect()}
    begin, index, bounds = 0, 0, []
    for r in sorted(sums):
        bounds.append((r, index, begin, begin + sums[r][1]))
        index, begin = index + sums[r][0], begin + sums[r][1]
    earlier, first = [], 0
    for i, (_, _, p0, _) in enumerate(bounds):  # ranges that look ahead into this one, with the tokens between
        while bounds[first][3] + length < p0:
            first += 1
        earlier.append([(b[0], p0 - b[3]) for b in bounds[first:i]])
    info = spark.createDataFrame([(*b, e) for b, e in zip(bounds, earlier)], "range bigint, i0 bigint, p0 bigint, p1 bigint, earlier array<struct<r: bigint, gap: bigint>>")
    known = placed.join(info, "range").select("range", (F.col("i0") + F.col("at")).alias("index"), (F.col("p0") + F.col("start")).alias("start"), "size", F.col("start").alias("own_start"), "earlier")
    looked = known.where("size > 0").select("index", "start", "size", "own_start", F.explode("earlier").alias("e")).where(F.col("own_start") + F.col("e.gap") <= length)
    stream = known.select("range", F.lit(0).cast("bigint").alias("ahead"), "index", "start", "size").unionByName(looked.select(F.col("e.r").alias("range"), F.lit(1).cast("bigint").alias("ahead"), "index", "start", "size"))
    node = T.StructType([T.StructField(c, T.LongType()) for c in ("range", "at", "to", "n")])
    nodes = publish(stream.repartition(n, F.xxhash64("range")).sortWithinPartitions("range", "ahead", "index").mapInArrow(_exits(length, truncate, total), node), "range-exits")
    passed = _on_the_way(nodes).join(nodes.select("at", "range", "n"), "at").collect()  # one row a range at most
    entry = {r["range"]: (r["at"], r["before"], r["n"]) for r in passed}
    known_starts, before = [], 0
    for r, i0, p0, _ in bounds:
        at, before, begun = entry.get(r, (-1, before, 0))
        known_starts.append((r, i0, p0, at, before))
        before += begun
    starts = spark.createDataFrame(known_starts, "range bigint, i0 bigint, p0 bigint, entry bigint, before bigint")
    return columns(placed.join(starts, "range").repartition(n, "range").sortWithinPartitions("range", "at")).mapInArrow(fold, out)


def collate(packed: DataFrame, length: int, key: str, by: tuple[str, ...] = ("batch",)) -> DataFrame:
    """(by, key, element_id, offset, kept): where each element lies in its sequence, cut at ``length``.

    packed has the columns that name a sequence, position (the order within all elements), n_tokens.
    """
    w = Window.partitionBy(*by).orderBy("position", key)
    placed = packed.withColumns({"element_id": (F.row_number().over(w) - 1).cast("bigint"), "offset": (F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")).cast("bigint")})
    return placed.select(*by, key, "element_id", "offset", F.greatest(F.lit(0), F.least(F.col("n_tokens"), length - F.col("offset"))).cast("bigint").alias("kept"))


def positions(collated: DataFrame, length: int) -> DataFrame:
    """(batch, pos, element_id, position_id) of all places of a sequence; padding has zeros, as in the first element's start."""
    real = collated.where("kept > 0").select("batch", "element_id", "offset", F.explode(F.expr("sequence(0L, kept - 1)")).alias("position_id")).select("batch", (F.col("offset") + F.col("position_id")).alias("pos"), "element_id", "position_id")
    grid = collated.groupBy("batch").agg(F.sum("kept").alias("used")).where(F.col("used") < length).select("batch", F.explode(F.sequence(F.col("used"), F.lit(length - 1).cast("bigint"))).alias("pos"))
    return real.unionByName(grid.select("batch", "pos", F.lit(0).cast("bigint").alias("element_id"), F.lit(0).cast("bigint").alias("position_id")))


def visible_pairs(tokens: DataFrame, cache_tokens: int) -> DataFrame:
    """(batch, q, k) that attention may see: cache places (negative k), and earlier places of the same element.

    tokens: (batch, pos, element_id). An equi-join on batch and element, so no pair of two elements arises.
    """
    q = tokens.select("batch", F.col("pos").alias("q"), F.col("element_id").alias("e"))
    k = tokens.select("batch", F.col("pos").alias("k"), F.col("element_id").alias("e"))
    own = q.join(k, ["batch", "e"]).where("k <= q").select("batch", "q", "k")
    cache = q.select("batch", "q", F.explode(F.sequence(F.lit(-cache_tokens).cast("bigint"), F.lit(-1).cast("bigint"))).alias("k")) if cache_tokens else own.limit(0)
    return own.unionByName(cache.select("batch", "q", "k"))
