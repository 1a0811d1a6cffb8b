"""Long-context probes: needles in a haystack, and chains of variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions.sampling import below, uniform
from corvane.functions.text import assignment_sentence


def build(sentences: DataFrame, needles: DataFrame, sample: str = "sample_id") -> DataFrame:
    """(sample, text): sentences (sample, i, sentence) with each needle (sample, depth, needle) put in at depth percent."""
    n = sentences.groupBy(sample).agg(F.count("*").alias("n"))
    at = needles.join(n, sample).select(sample, (F.floor(F.col("n") * F.col("depth") / 100) - 0.5).alias("place"), F.col("needle").alias("piece"))
    rows = sentences.select(sample, F.col("i").cast("double").alias("place"), F.col("sentence").alias("piece")).unionByName(at)
    ordered = rows.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    return ordered.select(sample, F.array_join(F.transform("p", lambda x: x["piece"]), ". ").alias("text"))


def fitting(sizes: DataFrame, by: list[str], order: list[str], tokens: str, budget: int) -> DataFrame:
    """(by, n, total): the most leading pieces whose tokens stay within a budget; 0 if the first is too large."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = sizes.withColumn("total", F.sum(tokens).over(w))
    inside = F.col("total") <= budget
    return run.groupBy(*by).agg(F.count(F.when(inside, 1)).alias("n"), F.coalesce(F.max(F.when(inside, F.col("total"))), F.lit(0)).cast("bigint").alias("total"))


def chains(keys: DataFrame, key: str, hops: int, seed: int) -> DataFrame:
    """(key, hop, name, value, sentence): a variable chain; hop 0 holds a number, each later one the variable before."""
    rows = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(hops))).alias("hop"))
    name = lambda hop: F.concat(F.lit("V"), F.upper(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), hop.cast("string")).cast("binary")), 1, 5)))
    number = (F.lit(1_000_000) + below(uniform(seed, key), 9_000_000)).cast("string")
    value = F.when(F.col("hop") == 0, number).otherwise(name(F.col("hop") - 1))
    form = below(uniform(seed, key, "hop"), 4)
    return rows.withColumns({"name": name(F.col("hop")), "value": value}).withColumn("sentence", assignment_sentence(F.col("name"), F.col("value"), form))
