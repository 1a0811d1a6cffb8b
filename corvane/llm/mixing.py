"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked until the tokens
kept of each value meet its goal: its target share of the token budget, or all
its tokens where it has fewer, the rest of the dimension taking what it leaves.
No cell can give more than it has: those that raking would take beyond stay
whole, and each cycle rakes the others to what the whole ones leave of the
goals.  A document is then kept with its cell's kept share as its probability.
Draws are hashes of the document id, so they depend on no partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm import store

DIMENSIONS = ("source", "lang", "topic")
#: Cycles over the marginals.
CYCLES = 24
#: Relative error up to which a value of whole cells meets its goal.
SLACK = 1e-9
#: Cells that the driver rakes (more are raked by aggregates of a table), and those that are broadcast (some 100 bytes each).
DRIVER_CELLS, BROADCAST_CELLS = 1_000_000, 50_000
#: Values of a dimension that the driver holds.
MAX_VALUES = 1_000_000
#: Share of all tokens to keep, seed of the draws.
BUDGET, SEED = 0.5, 17
#: Target of a value: its share of all tokens to this power, normalised. Smaller powers level more.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """The kind of a text, by the first rule that holds."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike("[Ll]icensed under|[Rr]eleased under"), "legal")
        .when(F.contains(text, F.lit("@")), "contact")
        .otherwise("prose")
    )


def describe(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", topics: Column | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with cv_source, cv_lang, cv_topic (never null) and cv_tokens; null text has none.

    topics: the topic of a row, by the rules of ``topic`` unless given.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({
        "cv_source": F.coalesce(F.col(source).cast("string"), F.lit("(none)")),
        "cv_lang": F.coalesce(F.col(lang).cast("string"), F.lit("(none)")),
        "cv_topic": F.coalesce(topics.cast("string"), F.lit("(none)")) if topics is not None else topic(body),
        "cv_tokens": F.regexp_count(body, F.lit(WORD)).cast("long"),
    })


def power_targets(totals: dict[str, float], power: float) -> dict[str, float]:
    raised = {k: v**power if v > 0 else 0.0 for k, v in totals.items()}
    whole = sum(raised.values()) or 1.0
    return {k: v / whole for k, v in raised.items()}


def goals(totals: np.ndarray, shares: np.ndarray, budget: float) -> np.ndarray:
    """Tokens to keep of each value: its share of the budget, none above its total, and what one can't give from the others."""
    ratio = np.divide(shares, totals, out=np.zeros(len(totals)), where=totals > 0)
    by = np.argsort(-ratio, kind="stable")
    t, f = totals[by], shares[by]
    before_t, rest_f = np.cumsum(t) - t, f.sum() - (np.cumsum(f) - f)
    scale = np.divide(budget * totals.sum() - before_t, rest_f, out=np.zeros(len(t)), where=rest_f > 1e-15)
    fits = np.flatnonzero(scale * ratio[by] <= 1)  # the values before the first of these are kept whole
    return totals * np.minimum(1.0, (scale[fits[0]] if len(fits) else 1 / max(ratio[ratio > 0].min(initial=1.0), 1e-300)) * ratio)


def factor(goal, whole, part, weight):
    """What the weights of a value are multiplied by: whole is the tokens of its whole cells, part the weight of its others, weight that of all."""
    fits, met = (goal > whole) & (part > 0), (part == 0) & (goal >= whole * (1 - SLACK))
    return np.where(met, 1.0, np.where(fits, np.divide(goal - whole, part, out=np.ones(len(goal)), where=fits), np.divide(goal, weight, out=np.zeros(len(goal)), where=weight > 0)))


def rake(tokens: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], budget: float = BUDGET, cycles: int = CYCLES) -> np.ndarray:
    """Weight of each cell, of which as much as its tokens is kept; codes[i] is each cell's value of dimension i, wanted[i] the goal of each value."""
    weight = tokens * budget
    for _ in range(cycles):
        for code, goal in zip(codes, wanted):
            full = weight >= tokens
            sums = (np.bincount(code, x, minlength=len(goal)) for x in (tokens * full, weight * ~full, weight))
            weight = weight * factor(goal, *sums)[code]
    return weight


def _rake_table(cells: DataFrame, names: list[str], wanted: list[DataFrame], budget: float) -> DataFrame:
    """The same over a table of cells; every cycle is a table, so lineage stays short."""
    cells = cells.withColumn("w", F.col("t") * budget)
    for _ in range(CYCLES):
        for name, goal in zip(names, wanted):
            full = F.col("w") >= F.col("t")
            sums = cells.groupBy(name).agg(F.sum(F.when(full, F.col("t")).otherwise(0.0)).alias("whole"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("part"), F.sum("w").alias("weight")).join(goal, name)
            met = (F.col("part") == 0) & (F.col("goal") >= F.col("whole") * (1 - SLACK))
            by = F.when(met, 1.0).when((F.col("goal") > F.col("whole")) & (F.col("part") > 0), (F.col("goal") - F.col("whole")) / F.col("part")).when(F.col("weight") > 0, F.col("goal") / F.col("weight")).otherwise(0.0)
            cells = cells.join(sums.select(name, by.alias("by")), name).withColumn("w", F.col("w") * F.col("by")).drop("by")
        before, cells = cells, store.publish(cells, "cells")
    return cells


def draw(key: Column, text: Column, seed: int = SEED) -> Column:
    """Uniform on [0, 1) from the id, or from the text where that is null."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


class Mixture:
    """Probabilities of the cells of a table of documents, and the tokens that its marginals aim at."""

    def __init__(self, docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", targets: Callable[[str, dict[str, float]], dict[str, float]] | None = None, budget: float = BUDGET, topics: Column | None = None):
        self.budget = budget
        self.names = names = [f"cv_{d}" for d in DIMENSIONS]
        docs = docs.drop(*names, "cv_tokens", "cv_probability", "cv_sampled")
        self.described = describe(docs, text, source, lang, topics)
        #: (cv_source, cv_lang, cv_topic, t) of all cells with tokens.
        self.cells = store.publish(self.described.groupBy(*names).agg(F.sum("cv_tokens").cast("double").alias("t")).where("t > 0"), "cells")
        #: Of each dimension the values, their tokens, target shares and goals.
        self.marginals = []
        for dimension, name in zip(DIMENSIONS, names):
            totals = {r[0]: r[1] for r in self.cells.groupBy(name).agg(F.sum("t")).limit(MAX_VALUES + 1).collect()}
            if len(totals) > MAX_VALUES:
                raise ValueError(f"more than {MAX_VALUES} values of {dimension}; merge rare ones first")
            totals = dict(sorted(totals.items()))
            share = targets(dimension, totals) if targets else power_targets(totals, POWERS[dimension])
            aim = np.array([max(0.0, share.get(v, 0.0)) for v in totals])
            aim = aim / aim.sum() if aim.sum() else aim
            self.marginals.append((list(totals), np.array(list(totals.values())), aim, goals(np.array(list(totals.values())), aim, budget)))
        self.n_cells = self.cells.count()

    def probabilities(self) -> DataFrame:
        """(cv_source, cv_lang, cv_topic, t, cv_probability) of the cells."""
        spark = self.cells.sparkSession
        if self.n_cells <= DRIVER_CELLS:
            cells = sorted(self.cells.collect())
            codes = []
            for name, (values, *_) in zip(self.names, self.marginals):
                code = {v: i for i, v in enumerate(values)}
                codes.append(np.array([code[r[name]] for r in cells], dtype=np.int64))
            tokens = np.array([r["t"] for r in cells])
            kept = np.minimum(tokens, rake(tokens, codes, [m[3] for m in self.marginals], self.budget)) / tokens
            return spark.createDataFrame([(*r, float(p)) for r, p in zip(cells, kept)], ", ".join(f"{n} string" for n in self.names) + ", t double, cv_probability double")
        wanted = [spark.createDataFrame(list(zip(values, map(float, goal))), f"{name} string, goal double") for name, (values, _, _, goal) in zip(self.names, self.marginals)]
        raked = _rake_table(self.cells, self.names, wanted, self.budget)
        return raked.select(*self.names, "t", F.least(F.lit(1.0), F.col("w") / F.col("t")).alias("cv_probability"))

    def report(self) -> DataFrame:
        """(dimension, value, tokens, target, feasible, reached): shares of the kept tokens that were asked for, that the value's tokens allow, and that are expected."""
        spark, parts = self.cells.sparkSession, None
        found = store.publish(self.probabilities(), "probabilities")
        for dimension, name, (values, totals, aim, goal) in zip(DIMENSIONS, self.names, self.marginals):
            whole = max(goal.sum(), 1e-300)
            rows = [(dimension, v, float(t), float(a), float(g / whole)) for v, t, a, g in zip(values, totals, aim, goal)]
            table = spark.createDataFrame(rows, "dimension string, value string, tokens double, target double, feasible double")
            kept = found.groupBy(F.col(name).alias("value")).agg((F.sum(F.col("t") * F.col("cv_probability"))).alias("kept"))
            kept = kept.crossJoin(F.broadcast(found.agg(F.sum(F.col("t") * F.col("cv_probability")).alias("whole")))).select("value", (F.col("kept") / F.col("whole")).alias("reached"))
            part = table.join(kept, "value", "left").select("dimension", "value", "tokens", "target", "feasible", "reached")
            parts = part if parts is None else parts.union(part)
        return parts

    def sample(self, key: str = "doc_id", text: str = "text") -> DataFrame:
        table = self.probabilities().drop("t")
        joined = self.described.join(F.broadcast(table) if self.n_cells <= BROADCAST_CELLS else table, self.names, "left")
        p = F.when(F.col("cv_tokens") > 0, F.coalesce("cv_probability", F.lit(0.0))).otherwise(0.0)
        return joined.withColumn("cv_probability", p).withColumn("cv_sampled", draw(F.col(key), F.col(text)) < F.col("cv_probability"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", targets: Callable[[str, dict[str, float]], dict[str, float]] | None = None, budget: float = BUDGET, topics: Column | None = None) -> DataFrame:
    """The rows and columns of ``docs`` with cv_source, cv_lang, cv_topic, cv_tokens, cv_probability and cv_sampled.

    topics: a column with each row's topic, such as a classifier's; by default
    the kind of text that ``topic``'s rules tell.
    targets(dimension, token totals) gives the share of each value; a value
    without tokens can't get any.  Goals that contradict each other across
    dimensions can't all be met: ``Mixture.report`` gives what each value asked
    for, could give and gets.  Null sources and languages are the value
    ``(none)``; texts without words have no tokens and are never sampled;
    rows of the same id share a draw, rows without one of the same text; an
    empty table stays empty.
    """
    return Mixture(docs, text, source, lang, targets, budget, topics).sample(key, text)


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", F.col("cv_source").alias("source"), F.col("cv_lang").alias("lang"), F.col("cv_topic").alias("topic"), F.col("cv_tokens").alias("n_tokens"), F.round("cv_probability", 6).alias("probability"), F.col("cv_sampled").alias("sampled"))


def _sql() -> str:
    """The cycles unrolled as one query each."""
    steps, last = [], "f0"
    for d in DIMENSIONS:
        steps.append(f"""v_{d} AS (SELECT {d}, sum(t) AS t, sum(t) ^ {POWERS[d]} / sum(sum(t) ^ {POWERS[d]}) OVER () AS s FROM c GROUP BY {d}),
o_{d} AS (SELECT s / t AS ratio, ({BUDGET} * sum(t) OVER () - coalesce(sum(t) OVER (ORDER BY s / t DESC, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(s) OVER (ORDER BY s / t DESC, {d} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM v_{d}),
g_{d} AS MATERIALIZED (SELECT {d}, t * least(1, (SELECT arg_max(scale, ratio) FROM o_{d} WHERE scale * ratio <= 1) * s / t) AS goal FROM v_{d})""")
    for i in range(CYCLES):
        for d in DIMENSIONS:
            name = f"f{i}_{d}"
            steps.append(f"""{name} AS MATERIALIZED (SELECT source, lang, topic, t, w * CASE WHEN part = 0 AND goal >= whole * {1 - SLACK!r}::DOUBLE THEN 1 WHEN goal > whole AND part > 0 THEN (goal - whole) / part ELSE goal / weight END AS w
  FROM (SELECT *, sum(CASE WHEN w >= t THEN t ELSE 0 END) OVER p AS whole, sum(CASE WHEN w >= t THEN 0 ELSE w END) OVER p AS part, sum(w) OVER p AS weight FROM {last} WINDOW p AS (PARTITION BY {d})) JOIN g_{d} USING ({d}))""")
            last = name
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN regexp_matches(coalesce(text, ''), '[Ll]icensed under|[Rr]eleased under') THEN 'legal'
       WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens,
  ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
f0 AS (SELECT source, lang, topic, t, t * {BUDGET} AS w FROM c),
{", ".join(steps)},
p AS (SELECT source, lang, topic, least(1.0::DOUBLE, w / t) AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN n_tokens > 0 THEN p ELSE 0 END, 6) AS probability, n_tokens > 0 AND u < coalesce(p, 0) AS sampled
FROM d LEFT JOIN p USING (source, lang, topic)"""


QUERIES = {"op10_mixing": query}
ORACLES = {"op10_mixing": _sql()}
