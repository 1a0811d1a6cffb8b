"""Draws from hashes of stable keys.

A draw depends on the seed and the row's key only, never on partitioning or
order, and any engine with MD5 gives the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform on [0, 1) from the first 52 bits of md5(seed:key:...)."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def below(u: Column, n: Column | int) -> Column:
    """An integer in 0..n-1 from a uniform draw."""
    return F.floor(u * n).cast("int")


def choose(df: DataFrame, seed: int, keys: list[str], by: list[str] | None = None, k: int = 1) -> DataFrame:
    """k rows at random (of each group), without replacement; ties in the draw by key."""
    order = [uniform(seed, *keys), *keys]
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def rank_by_draw(df: DataFrame, draw: Column, ties: list[str], name: str = "position", bucket_rows: int = 100_000) -> DataFrame:
    """The place of each row, from 0, in the order of a draw on [0, 1), then ``ties``.

    Rows are ranked within buckets of the draw, of some ``bucket_rows`` each; the
    counts of the buckets before (a row a bucket) give the offset, so no task
    sorts everything. Counts the rows first.
    """
    buckets = max(1, -(-df.count() // bucket_rows))
    rows = df.withColumn("__draw", draw).withColumn("__bucket", F.floor(F.col("__draw") * buckets))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__bucket").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__bucket").orderBy("__draw", *ties))
    placed = rows.join(offsets, "__bucket").withColumn(name, F.col("__before") + local - 1)
    return placed.drop("__draw", "__bucket", "__before")


def shuffled(df: DataFrame, seed: int, keys: list[str], name: str = "position") -> DataFrame:
    """The place of each row in a seeded permutation, from 0."""
    return rank_by_draw(df, uniform(seed, *keys), keys, name)


def weighted_choice(df: DataFrame, weight: Column, seed: int, keys: list[str], k: int = 1) -> DataFrame:
    """k rows without replacement with chances in proportion to their weights, by an exponential race."""
    race = -F.log(1 - uniform(seed, *keys)) / weight
    return df.where(weight > 0).orderBy(race, *keys).limit(k)


def decay(age: Column, rate: float | None = None, half_life: float | None = None) -> Column:
    """exp(-rate * age), or 0.5 ** (age / half_life)."""
    return F.exp(-age * rate) if rate is not None else F.exp(-age * (0.6931471805599453 / half_life))
