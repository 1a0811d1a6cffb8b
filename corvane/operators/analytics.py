"""Aggregates, windows and tables of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def arg_best(df: DataFrame, by: list[str], value: str, ties: list[str]) -> DataFrame:
    """The row of each group with the greatest value, null and NaN left out; ties by ``ties``, ascending."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def macro_mean(df: DataFrame, group: str, value: str, by: list[str]) -> DataFrame:
    """(by, micro, macro): the mean over rows, and the mean of group means."""
    per = df.groupBy(*by, group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return per.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("micro"), F.avg(F.col("s") / F.col("n")).alias("macro"))


def pivot_mean(df: DataFrame, index: list[str], column: str, values: list[str], value: str, digits: int = 6) -> DataFrame:
    """Means by index (rows) and column; the values are named, so no extra pass finds them."""
    out = df.groupBy(*index).pivot(column, values).agg(F.round(F.avg(value), digits))
    return out


def row_mean(names: list[str], skip: str = "memorization") -> Column:
    """Mean over the columns of a row that aren't null, names with ``skip`` left out."""
    used = [F.col(n) for n in names if skip not in n]
    some = F.filter(F.array(*used), lambda x: x.isNotNull())
    return F.aggregate(some, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(some), F.lit(0))


def step_bin(step: Column, width: int) -> Column:
    """ceil(step / width)."""
    return F.ceil(step / width).cast("bigint")


def bin_center(number: Column, width: int) -> Column:
    """Where a bin is drawn: number * width + width / 2, 0 at least."""
    return F.greatest(F.lit(0.0), number * float(width) + width / 2)


def rolling(df: DataFrame, by: list[str], order: list[str], value: str, size: int) -> DataFrame:
    """Population variance, deviation and mean of the last ``size`` values, where there are so many."""
    w = Window.partitionBy(*by).orderBy(*order)
    frame = w.rowsBetween(-(size - 1), 0)
    out = df.withColumns({"n": F.count(value).over(frame), "var": F.var_pop(value).over(frame), "std": F.stddev_pop(value).over(frame), "mean": F.avg(value).over(frame)})
    return out.where(F.col("n") >= size)


def mode_of(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("neg"), value))[value].alias("mode"), F.max("n").alias("n"))


def last_written(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The value of each group's last row."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest(df: DataFrame, by: list[str], recency: list) -> DataFrame:
    """Upsert: the most recent row of each key."""
    w = Window.partitionBy(*by).orderBy(*recency)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def changed(current: DataFrame, stored: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of ``current`` that ``stored`` lacks or has in another version."""
    known = stored.select(F.col(key).alias("__k"), F.col(version).alias("__v"))
    return current.join(known, current[key] == known["__k"], "left").where(F.col("__k").isNull() | (F.col(version) != F.col("__v"))).drop("__k", "__v")


def expired(checkpoints: DataFrame, by: list[str], step: Column, keep: int) -> DataFrame:
    """Checkpoints beyond the last ``keep`` steps."""
    w = Window.partitionBy(*by).orderBy(F.desc("__step"))
    return checkpoints.withColumn("__step", step).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") > keep).drop("__rn", "__step")


def number_in(name: Column, default: int = 0) -> Column:
    """The last run of digits in a name as a number."""
    found = F.regexp_extract(name, r"(\d+)\D*$", 1)
    return F.when(found != "", found.cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def slices(df: DataFrame, predicates: dict[str, Column], metrics: list[Column]) -> DataFrame:
    """(slice, metrics): one row for each named predicate, in one pass."""
    tagged = df.withColumn("slice", F.explode(F.filter(F.array(*(F.when(p, F.lit(n)) for n, p in predicates.items())), lambda x: x.isNotNull())))
    return tagged.groupBy("slice").agg(*metrics)


def slice_union(df: DataFrame, predicates: list[Column]) -> DataFrame:
    """Distinct rows that any active slice takes."""
    return df.where(reduce(lambda a, b: a | b, predicates, F.lit(False))).distinct()


def matches(filters: dict) -> Column:
    """A predicate of nested filters: {column: value or {$in, $regex, $gte, $lte, $ne}}, $and, $or."""
    parts = []
    for name, wanted in filters.items():
        if name in ("$and", "$or"):
            inner = [matches(f) for f in wanted]
            parts.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), inner))
        elif isinstance(wanted, dict):
            ops = {"$in": lambda c, v: c.isin(*v), "$regex": lambda c, v: c.rlike(v), "$gte": lambda c, v: c >= v, "$lte": lambda c, v: c <= v, "$ne": lambda c, v: c != v}
            parts += [ops[op](F.col(name), v) for op, v in wanted.items()]
        else:
            parts.append(F.col(name) == wanted)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def select_like(names: list[str], include: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names that match a pattern and none of the excluded ones."""
    import re

    return [n for n in names if re.search(include, n) and not any(re.search(x, n) for x in exclude)]


def in_order(column: Column, order: list[str]) -> Column:
    """Sort key of an explicit order; values outside it come last."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), column)
    return F.when(place > 0, place).otherwise(len(order) + 1)
