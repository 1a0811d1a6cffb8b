"""Sparse and dense top-k log-probabilities in long form (msg_id, token_idx, k, token_id, logprob), k from 0 by falling logprob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sparsify(dense: DataFrame, mass: float = 0.99, key: tuple[str, ...] = ("msg_id", "token_idx")) -> DataFrame:
    """Per token the alternatives up to the one at which the cumulative probability reaches ``mass``.

    Where it never does, the first alternative only.
    """
    if not 0 < mass <= 1:
        raise ValueError("mass must be in (0, 1]")
    w = Window.partitionBy(*key).orderBy("k")
    run = dense.withColumn("cum", F.sum(F.exp("logprob")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("cut", F.coalesce(F.min(F.when(F.col("cum") >= mass, F.col("k"))).over(Window.partitionBy(*key)), F.lit(0)))
    return run.where("k <= cut").drop("cum", "cut")


def densify(sparse: DataFrame, tokens: DataFrame, width: int, fill: float = -1000.0, key: tuple[str, ...] = ("msg_id", "token_idx")) -> DataFrame:
    """A full grid of ``width`` places for each row of ``tokens`` (the key): kept entries to the left, then fill and id -1."""
    w = Window.partitionBy(*key).orderBy("k")
    left = sparse.withColumn("k", (F.row_number().over(w) - 1).cast("int"))
    grid = tokens.select(*key, F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    return grid.join(left, [*key, "k"], "left").select(*key, "k", F.coalesce("token_id", F.lit(-1)).alias("token_id"), F.coalesce("logprob", F.lit(fill)).alias("logprob"))


def cross_entropy(teacher: Column, student: Column) -> Column:
    """-p log q of one kept target."""
    return -F.exp(teacher) * student


def perplexity(targets: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_targets, loss, perplexity) of (teacher, student) log-probabilities: the sum over kept targets by their number."""
    return targets.groupBy(*by).agg(F.count("*").alias("n_targets"), (F.sum(cross_entropy(F.col("teacher"), F.col("student"))) / F.count("*")).alias("loss")).withColumn("perplexity", F.exp("loss"))


def group_alternatives(sparse: DataFrame, key: tuple[str, ...] = ("msg_id", "token_idx")) -> DataFrame:
    """(key, alternatives): array<struct<logprob, token_id>> by falling logprob, then token."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("logprob")).alias("neg"), "token_id", "logprob")))
    return sparse.groupBy(*key).agg(order.alias("a")).select(*key, F.transform("a", lambda x: F.struct(x["logprob"].alias("logprob"), x["token_id"].alias("token_id"))).alias("alternatives"))


def chosen_probability(tokens: DataFrame, sparse: DataFrame, key: tuple[str, ...] = ("msg_id", "token_idx"), low: float = 0.1) -> DataFrame:
    """(key, probability): of each token its own alternative, else the first one, clamped to [low, 1]; null without any."""
    own = tokens.join(sparse.select(*key, "token_id", F.col("logprob").alias("own")), [*key, "token_id"], "left")
    first = sparse.groupBy(*key).agg(F.min_by("logprob", "k").alias("first"))
    p = F.exp(F.coalesce("own", "first"))
    return own.join(first, list(key), "left").select(*key, F.greatest(F.lit(low), F.least(F.lit(1.0), p)).alias("probability"))
