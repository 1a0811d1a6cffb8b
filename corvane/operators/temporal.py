"""Time-ordered batches of events or mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.arithmetic import estimate_tokens


def rank_batches(df: DataFrame, time: str, key: str, size: int, most: int | None = None, unit: str = "day") -> DataFrame:
    """batch_id: every ``size`` rows in time order, rows without a time dropped, ``most`` batches at most.

    Rows are ranked within each ``unit`` of time; the counts of the units before
    (a row a unit) give the offset, so no task sorts everything.
    """
    rows = df.where(F.col(time).isNotNull()).withColumn("__unit", F.date_trunc(unit, F.col(time)))
    before = Window.orderBy("__unit").rowsBetween(Window.unboundedPreceding, -1)
    units = rows.groupBy("__unit").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    placed = rows.join(units, "__unit").withColumn("__rn", F.row_number().over(Window.partitionBy("__unit").orderBy(time, key)))
    out = placed.withColumn("batch_id", F.floor((F.col("__before") + F.col("__rn") - 1) / size).cast("bigint"))
    out = out if most is None else out.where(F.col("batch_id") < most)
    return out.drop("__unit", "__rn", "__before")


def batch_metadata(batched: DataFrame, time: str, key: str, user: str) -> DataFrame:
    """(batch_id, n, start, end, paths, users): keys in time order, distinct users in order."""
    return batched.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.min(time).alias("start"), F.max(time).alias("end"),
        F.transform(F.array_sort(F.collect_list(F.struct(time, key))), lambda x: x[key]).alias("paths"), F.array_sort(F.collect_set(user)).alias("users"),
    )


def later_batches(batches: DataFrame, key: str = "batch_id") -> DataFrame:
    """(key, later): the ids of all batches after each one; a row a batch, so the table is small."""
    w = Window.orderBy(key).rowsBetween(1, Window.unboundedFollowing)
    return batches.select(key, F.collect_list(key).over(w).alias("later"))


def numbered(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """i and n: the place of each row in its group and the group's size."""
    w = Window.partitionBy(*by)
    return df.withColumns({"i": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})


def joined_text(df: DataFrame, by: list[str], order: list[str], piece: Column, separator: str) -> DataFrame:
    """(by, text): the pieces of each group in order."""
    rows = df.withColumn("__piece", piece).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "__piece"))).alias("p"))
    return rows.select(*by, F.array_join(F.transform("p", lambda x: x["__piece"]), separator).alias("text"))


def chat_included(name: Column, n: Column, least: int, groups: bool = True, single: bool = True, allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> Column:
    """Chats with enough messages, of the wanted kinds and contacts; a name with ``+``, ``;`` or ``chat`` is a group."""
    group = F.contains(name, F.lit("+")) | F.contains(name, F.lit(";")) | F.contains(F.lower(name), F.lit("chat"))
    out = (n >= least) & ((group & F.lit(groups)) | (~group & F.lit(single)))
    if allow:
        out = out & F.exists(F.array(*map(F.lit, allow)), lambda x: F.contains(name, x))
    if deny:
        out = out & ~F.exists(F.array(*map(F.lit, deny)), lambda x: F.contains(name, x))
    return out


def request_windows(df: DataFrame, by: list[str], time: str, seconds: int, most: int) -> DataFrame:
    """(by, window_start, n, over): windows of ``seconds`` that begin with the first request at or after the last one's end.

    over: requests beyond ``most`` in a window, which a limiter would put off.
    The fold is over one key's times, an array of a row.
    """
    times = df.where(F.col(time).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.unix_micros(F.col(time).cast("timestamp")))).alias("__t"))
    opened = F.aggregate("__t", F.array().cast("array<bigint>"), lambda s, t: F.when((F.size(s) == 0) | (t - F.element_at(s, -1) >= seconds * 1_000_000), F.concat(s, F.array(t))).otherwise(s))
    starts = times.withColumn("__s", opened).withColumn("__w", F.explode("__s"))
    n = F.size(F.filter("__t", lambda t: (t >= F.col("__w")) & (t - F.col("__w") < seconds * 1_000_000)))
    return starts.select(*by, F.timestamp_micros("__w").alias("window_start"), n.cast("bigint").alias("n"), F.greatest(F.lit(0), n - most).cast("bigint").alias("over"))


def batch_prompt(batch: DataFrame, context: DataFrame, later: DataFrame, key: str = "batch_id") -> DataFrame:
    """(key, prompt): a batch's context with a note on how many batches come after it; batches without a context have an empty one."""
    n = F.coalesce(F.size("later"), F.lit(0))
    note = F.when(n > 0, F.concat(F.lit("What comes after batch "), F.col(key).cast("string"), F.lit(" isn't known yet: "), n.cast("string"), F.lit(" more."))).otherwise(F.lit("This is the last batch."))
    return batch.select(key).join(context, key, "left").join(later, key, "left").select(key, F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), note).alias("prompt"))


def text_sizes(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_chars and n_tokens (a quarter of the code points, and one)."""
    return texts.withColumns({"n_chars": F.length(text).cast("bigint"), "n_tokens": estimate_tokens(F.col(text))})
