"""Exact percentiles of groups of any size.

A sketch of each group brackets every percentile; one more pass counts what lies
below a bracket and keeps the values inside it, counted by value.  So no task
holds the values of a group, however many rows one group has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.runtime import publish

#: Groups whose brackets are sent to every task; with more, rows are joined by their group.
SENT_GROUPS = 100_000


def exact_percentiles(df: DataFrame, by: list[str], value: str | Column, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(by, n, percentiles): of each group the number of values and the array of percentiles, by straight lines between neighbours.

    shares: each from 0 to 1. Null and NaN values take no part, and a group of none has no
    row; null groups are groups. A bracket holds some 8 / ``accuracy`` of a
    group's rows, as distinct values. A group that a bracket missed is computed whole.
    """
    if not shares or min(shares) < 0 or max(shares) > 1:
        raise ValueError("shares lie between 0 and 1")
    source = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    margin, k = 4.0 / accuracy, len(shares)
    probes = [x for p in shares for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = source.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__v", probes, accuracy).alias("__e"))
    low = lambda i: F.lit(float("-inf")) if shares[i] <= margin else F.col("__e")[2 * i]
    high = lambda i: F.lit(float("inf")) if shares[i] >= 1 - margin else F.col("__e")[2 * i + 1]
    groups = publish(sketch.select(*by, "n", F.array(*map(low, range(k))).alias("__low"), F.array(*map(high, range(k))).alias("__high")), "brackets")
    keyed = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    sides = groups.select(*keyed, "__low", "__high")
    if groups.count() <= SENT_GROUPS:
        sides = F.broadcast(sides)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    rows = source.join(sides, same).select(*by, "__v", "__low", "__high")
    below = rows.groupBy(*by).agg(F.array(*(F.sum(F.when(F.col("__v") < F.col("__low")[i], 1).otherwise(0)) for i in range(k))).alias("__below"))
    places = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.col("__v") >= F.get("__low", i)) & (F.col("__v") <= F.get("__high", i)))
    inside = rows.select(*by, "__v", F.explode(places).alias("__q")).groupBy(*by, "__q", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__q").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = _along(_along(inside.withColumn("__to", upto), below, by), groups.select(*by, "n"), by)
    ranked = ranked.withColumn("__to", F.col("__to") + F.get("__below", F.col("__q"))).withColumn("__at", F.get(F.array(*map(F.lit, map(float, shares))), F.col("__q")) * (F.col("n") - 1))
    at = lambda rank: F.max(F.when((F.col("__to") - F.col("__c") <= rank) & (rank < F.col("__to")), F.col("__v")))
    ends = ranked.groupBy(*by, "n", "__q").agg(at(F.floor("__at")).alias("a"), at(F.ceil("__at")).alias("b"), F.first(F.col("__at") - F.floor("__at")).alias("f"))
    one = F.when(F.col("f") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("f")) + F.col("b") * F.col("f"))
    listed = ends.where(one.isNotNull()).groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("__q", one.alias("x")))), lambda s: s["x"]).alias("percentiles"))
    done = publish(listed.where(F.size("percentiles") == k), "percentiles")
    if done.count() == groups.count():
        return done
    known = done.select(*keyed).distinct()
    missed = source.join(known, same, "left_anti")
    return done.unionByName(missed.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("__v", list(map(float, shares))).alias("percentiles")))


def _along(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the other columns of their group's row."""
    named = groups.withColumnsRenamed({c: f"__h{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(named[f"__h{i}"])
    return rows.join(named, same).drop(*(f"__h{i}" for i in range(len(by))))
