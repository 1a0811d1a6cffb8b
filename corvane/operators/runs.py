"""Training and evaluation runs: wide tables of them, their tables, pages of them, and evaluation drivers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions.nested import flatten_json
from corvane.operators import benchmarks, scoring
from corvane.operators.analytics import matches
from corvane.operators.logprobs import perplexity


def wide_runs(runs: DataFrame, key: str, parts: list[str], filters: dict | None = None, most: int = 2000) -> DataFrame:
    """One row a run from JSON texts: a column ``part.path`` for each leaf of each part (config, summary, ...) that any chosen run has.

    filters: as of ``matches``, over the other columns. Columns that are null in
    all chosen runs are left out; more than ``most`` columns raise an error.
    """
    chosen = runs.where(matches(filters or {}))
    leaves = None
    for part in parts:
        flat = flatten_json(chosen.where(F.col(part).isNotNull()), part, [key], separator=".")
        flat = flat.select(key, F.when(F.col("path") == "", F.lit(part)).otherwise(F.concat(F.lit(part + "."), "path")).alias("path"), "value")
        leaves = flat if leaves is None else leaves.unionByName(flat)
    told = leaves.where("value <> 'null' AND value NOT IN ('{}', '[]')")
    names = [r[0] for r in told.select("path").distinct().orderBy("path").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    others = [c for c in chosen.columns if c not in parts]
    if not names:
        return chosen.select(*others)
    return chosen.select(*others).join(told.groupBy(key).pivot("path", names).agg(F.first("value")), key, "left")


def stacked_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of the tables of several artifacts with ``artifact_id``; columns that one lacks are null."""
    out = None
    for name, table in sorted(tables.items()):
        part = table.withColumn("artifact_id", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def resolve_version(versions: DataFrame, by: list[str], version: str, wanted: str = "latest") -> DataFrame:
    """The rows of one version of each collection: v<n>, an alias (array column ``aliases``), or the greatest number for ``latest``."""
    if wanted != "latest":
        return versions.where((F.col(version) == wanted) | F.array_contains("aliases", wanted))
    number = F.regexp_extract(version, r"^v(\d+)$", 1).try_cast("bigint")
    w = Window.partitionBy(*by)
    return versions.withColumn("__n", number).where(F.col("__n").isNotNull()).withColumn("__top", F.max("__n").over(w)).where("__n = __top").drop("__n", "__top")


def page_of_runs(runs: DataFrame, page: int, per_page: int, time: str, key: str) -> DataFrame:
    """(*, total, page, per_page, has_more): one page, newest first; ties by key. Only the rows up to its end are kept by any task."""
    total = runs.agg(F.count("*").alias("total"))  # one row
    end = (page + 1) * per_page
    head = runs.orderBy(F.desc(time), key).limit(end).withColumn("__rn", F.row_number().over(Window.orderBy(F.desc(time), key)))
    rows = head.where(F.col("__rn") > page * per_page).join(F.broadcast(total), how="cross")
    return rows.withColumns({"page": F.lit(page), "per_page": F.lit(per_page), "has_more": F.lit(end) < F.col("total")}).drop("__rn")


def step_throughput(steps: DataFrame, by: list[str], tokens: str, start: str, end: str) -> DataFrame:
    """(by, tokens, seconds, tokens_per_second) of each step from the tokens and times of its ranks: all tokens over the time from the first start to the last end; null where that is none."""
    seconds = F.max(end).cast("double") - F.min(start).cast("double")
    out = steps.groupBy(*by).agg(F.sum(tokens).alias("tokens"), seconds.alias("seconds"))
    return out.withColumn("tokens_per_second", F.when(F.col("seconds") > 0, F.col("tokens") / F.col("seconds")))


def loss_eval(sets: dict[str, DataFrame], step: int | None = None, every: int | None = None) -> DataFrame:
    """(eval_set, step, n_targets, loss, perplexity) over named sets of (teacher, student) log-probabilities; none if ``every`` doesn't divide the step."""
    due = every is None or step is None or step % every == 0
    out = None
    for name, targets in sorted(sets.items()):
        part = targets.withColumn("eval_set", F.lit(name)).select("eval_set", "teacher", "student")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no evaluation sets")
    return perplexity(out.where(F.lit(due)), ["eval_set"]).withColumn("step", F.lit(step).cast("bigint"))


def generation_eval(items: DataFrame, key: str, answers: str, samples: int, client: Callable, score: Callable, step: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The result rows and their means: every item ``samples`` times through the client, scored, with the step.

    score(pred, answer) gives a column; failed rows count with a null score, so
    means are over answered rows, beside the number of failures.
    """
    asked = scoring.replicate(items.select(key, "prompt"), samples)
    made = benchmarks.generate(asked, key, client).join(items.select(key, answers), key)
    rows = made.withColumn("score", F.when(F.col("error").isNull(), score(F.col("pred"), F.col(answers)).cast("double"))).withColumn("step", F.lit(step).cast("bigint"))
    means = rows.groupBy("step").agg(F.count("*").alias("n"), F.count("error").alias("n_failed"), F.avg("score").alias("mean_score"))
    return rows, means
