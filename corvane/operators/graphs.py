"""Import levels and call chains on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.sampling import below, uniform
from corvane.runtime import discard, materialize, publish


def _followed(links: DataFrame, nodes: int) -> DataFrame:
    """(node, to, b, d) with every ``to`` moved to the end of its chain of links, by pointer doubling.

    A link says level(node) = max(b, level(to) + d); two in a row are one of the same form.
    """

    def doubled(rows):
        on = rows.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("b").alias("b2"), F.col("d").alias("d2"))
        far = F.coalesce(F.col("d2"), F.lit(0))
        return rows.join(on, "to", "left").select("node", F.coalesce("to2", "to").alias("to"), F.greatest("b", F.col("b2") + F.col("d")).alias("b"), (F.col("d") + far).alias("d"))

    reach = 1
    while True:
        links = publish(links, "level-links")
        if links.join(links.select(F.col("node").alias("to")), "to", "left_semi").isEmpty():
            return links
        if reach > nodes:
            raise ValueError("the graph has a cycle")
        links, reach = doubled(doubled(links)), reach * 4


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without dependencies in the set, else one more than the deepest dependency.

    edges: (node, needs); edges to nodes outside the set don't count, nor do
    repeated ones. A node with one need is as deep as that and one more, so chains of such
    nodes are contracted by pointer doubling; nodes without needs are then
    settled, and what they say to others is a least level of these. Both leave fewer
    needs, so more nodes have one or none. Rounds are as many as nodes of
    several needs lie on top of each other, each with the logarithm of its longest
    chain; there is no bound on levels. A cycle raises an error.
    """
    names = publish(nodes.where("node IS NOT NULL").select("node").distinct(), "level-nodes")
    needs = edges.join(names.select(F.col("node").alias("needs")), "needs", "left_semi").join(names, "node", "left_semi").select("node", "needs").distinct()
    zero, n = F.lit(0).cast("bigint"), names.count()
    open_ = publish(names.join(needs, "node", "left").select("node", "needs", zero.alias("b"), F.lit(1).cast("bigint").alias("d")), "level-open")  # a row a need, one without any
    settled, deferred = [], []
    while not open_.isEmpty():
        counted = open_.groupBy("node").agg(F.count("needs").alias("n"), F.max("b").alias("b"), F.first("needs", ignorenulls=True).alias("to"), F.max("d").alias("d"))
        counted = publish(counted, "level-counts")
        ready = counted.where("n = 0").select("node", F.col("b").alias("level"))
        links = _followed(counted.where("n = 1").select("node", "to", "b", "d"), n)
        settled.append(ready)
        deferred.append(links)
        rest = open_.join(counted.where("n > 1").select("node"), "node", "left_semi")
        to = links.select(F.col("node").alias("needs"), F.col("to").alias("far"), F.col("b").alias("lb"), F.col("d").alias("ld"))
        moved = rest.join(to, "needs", "left").select("node", F.coalesce("far", "needs").alias("needs"), F.greatest("b", F.col("lb") + F.col("d")).alias("b"), (F.col("d") + F.coalesce("ld", F.lit(0))).alias("d"))
        told = moved.join(ready.select(F.col("node").alias("needs"), "level"), "needs", "left")
        after = told.select("node", F.when(F.col("level").isNull(), F.col("needs")).alias("needs"), F.greatest("b", F.col("level") + F.col("d")).alias("b"), "d")
        merged = after.groupBy("node", "needs").agg(F.max("b").alias("b"), F.max("d").alias("d"))
        least = merged.groupBy("node").agg(F.max("b").alias("least"), F.count("needs").alias("k"))
        left = merged.join(least, "node").where(F.col("needs").isNotNull() | (F.col("k") == 0)).select("node", "needs", F.col("least").alias("b"), "d")
        before, open_ = open_, publish(left, "level-open")
        if ready.isEmpty() and links.isEmpty():
            raise ValueError("the graph has a cycle")
        discard(before)
    out = names.limit(0).select("node", zero.alias("level"))
    for ready, links in zip(reversed(settled), reversed(deferred)):
        out = out.unionByName(ready)  # later rounds' nodes are known; so are these now, and the chains that end at either
        ends = out.select(F.col("node").alias("to"), "level")
        out = publish(out.unionByName(links.join(ends, "to").select("node", F.greatest("b", F.col("level") + F.col("d")).alias("level"))), "levels")
    return out.select("node", F.col("level").cast("int").alias("level"))


def call_chain(spark, calls: DataFrame, starts: DataFrame, follow_argument: bool = True) -> DataFrame:
    """(start, input, literal, depth) of each start's chain of calls.

    calls: (method, input, kind, target, arg, literal), one row a method and
    input. A call goes on with the stored argument, or with the first input if
    ``follow_argument`` is off. Each round doubles how far a call points, so a
    chain takes log2 of its depth rounds; chains that end without a literal
    have no row, and a start that runs into a cycle raises an error.
    """
    following = "arg" if follow_argument else "input"
    call = F.col("kind") == "call"
    start = calls.select("method", "input", "kind", F.when(call, F.col("target")).alias("to"), F.when(call, F.col(following)).alias("to_input"), "literal", F.when(call, 1).otherwise(0).alias("depth"))
    links = materialize(start.where(call | (F.col("kind") == "literal")))
    n, reach = links.count(), 1
    while reach <= n and not links.where(call).isEmpty():
        ends = links.select(F.col("method").alias("to"), F.col("input").alias("to_input"), F.col("kind").alias("end_kind"), F.col("to").alias("next"), F.col("to_input").alias("next_input"), F.col("literal").alias("end"), F.col("depth").alias("more"))
        on = links.where(call).join(ends, ["to", "to_input"]).select("method", "input", F.col("end_kind").alias("kind"), F.col("next").alias("to"), F.col("next_input").alias("to_input"), F.col("end").alias("literal"), (F.col("depth") + F.col("more")).alias("depth"))
        links, reach = materialize(links.where(~call).unionByName(on)), reach * 2
    found = starts.join(links, ["method", "input"])
    if not found.where(call).isEmpty():
        raise ValueError("a chain of calls has a cycle")
    return found.select(F.col("method").alias("start"), "input", "literal", "depth")


def random_calls(spark, programs: int, methods: int, words: list[str], seed: int, calls: float = 0.6) -> DataFrame:
    """(program, method, input, kind, target, arg, literal): methods of random programs, each with an answer to every word.

    Method m calls, by the share ``calls``, an earlier method of its program
    with a drawn word, or gives a drawn literal; the first gives literals only,
    so every chain ends. All draws are hashes, so any row can be made anywhere.
    """
    rows = spark.range(programs * methods).select((F.col("id") / methods).cast("long").alias("program"), (F.col("id") % methods).alias("m"), F.explode(F.array(*map(F.lit, words))).alias("input"))
    key = ("program", "m", "input")
    word = lambda s: F.element_at(F.array(*map(F.lit, words)), below(uniform(s, *key), len(words)) + 1)
    call = (F.col("m") > 0) & (uniform(seed, *key) < calls)
    name = lambda m: F.concat(F.lit("p"), F.col("program").cast("string"), F.lit("m"), m.cast("string"))
    target = below(uniform(seed + 1, *key), F.greatest(F.lit(1), F.col("m").cast("int")))
    return rows.select("program", name(F.col("m")).alias("method"), "input", F.when(call, "call").otherwise("literal").alias("kind"), F.when(call, name(target)).alias("target"), F.when(call, word(seed + 2)).alias("arg"), F.when(~call, word(seed + 3)).alias("literal"))


def module_levels(modules: DataFrame, imports: DataFrame, most: int | None = None) -> DataFrame:
    """(module, level) of modules that import each other, (module, imports) the edges; those above ``most`` are left out."""
    found = levels(modules.select(F.col("module").alias("node")), imports.select(F.col("module").alias("node"), F.col("imports").alias("needs")))
    found = found.select(F.col("node").alias("module"), "level")
    return found if most is None else found.where(F.col("level") <= most)
