"""Scores of predictions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType

from corvane.functions.nested import same_set
from corvane.functions.text import list_answers, tagged_answer


def set_scores(expected: Column, predicted: Column) -> dict[str, Column]:
    """tp, fp, fn, precision, recall and f1 of two value sets; 0 where a denominator is."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    tp = F.size(F.array_intersect(e, p))
    fp, fn = F.size(F.array_except(p, e)), F.size(F.array_except(e, p))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = over(tp, tp + fp), over(tp, tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "precision": precision, "recall": recall, "f1": over(2 * precision * recall, precision + recall)}


def tagged_variables(prediction: Column) -> Column:
    """Lower-case lines of all <answer> blocks, blank ones dropped, each once."""
    blocks = F.regexp_extract_all(prediction, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1))
    lines = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def listed_exactly(prediction: Column, answers: Column) -> Column:
    """Whether the list after the last colon is the set of answers."""
    return same_set(list_answers(prediction), answers)


#: The steps of ``qa_match`` that count as right.
RIGHT = ("exact", "substring", "reverse_substring", "token_overlap")


def qa_match(prediction: Column, answer: Column) -> Column:
    """The first that holds: exact, answer in prediction, prediction (over 5 code points) in answer, 60 % of the answer's words; else none."""
    p, a = F.lower(F.trim(prediction)), F.lower(F.trim(answer))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    share = F.size(F.array_intersect(words(p), words(a))) / F.nullif(F.size(words(a)), F.lit(0))
    return (
        F.when(p == a, "exact").when(F.contains(p, a), "substring")
        .when((F.length(p) > 5) & F.contains(a, p), "reverse_substring")
        .when(share >= 0.6, "token_overlap").otherwise("none")
    )


def judge_verdict(reply: Column) -> Column:
    """Boolean of a judge's JSON ``correct``; of other text CORRECT without INCORRECT is true, INCORRECT false; else null."""
    parsed = F.try_variant_get(F.try_parse_json(reply), "$.correct", "boolean")
    upper = F.upper(reply)
    plain = F.when(F.contains(upper, F.lit("INCORRECT")), False).when(F.contains(upper, F.lit("CORRECT")), True)
    return F.coalesce(parsed, plain)


def ngrams(text: Column, n: int) -> Column:
    """All runs of n code points of the text without white space."""
    bare = F.regexp_replace(text, r"\s+", "")
    starts = F.sequence(F.lit(1), F.length(bare) - n + 1)
    return F.when(F.length(bare) >= n, F.transform(starts, lambda s: F.substring(bare, s, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def chrf(pairs: DataFrame, hypothesis: str, reference: str, key: str, orders: int = 6, beta: float = 2.0) -> DataFrame:
    """(chrf): corpus character F-score in percent over n-grams of 1 to 6 code points.

    For each order matches, hypothesis and reference n-grams are summed over
    the corpus; precision and recall are averaged over orders that occur.
    """
    def grams(column: str, name: str) -> DataFrame:
        def order(n: int) -> Column:
            return F.transform(ngrams(F.col(column), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))

        each = F.flatten(F.array(*(order(n) for n in range(1, orders + 1))))
        return pairs.select(key, F.explode(each).alias("x")).groupBy(key, "x.n", "x.g").agg(F.count("*").alias(name))

    met = grams(hypothesis, "h").join(grams(reference, "r"), [key, "n", "g"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = met.groupBy("n").agg(F.sum(F.least(zero("h"), zero("r"))).alias("m"), F.sum(zero("h")).alias("h"), F.sum(zero("r")).alias("r"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = per.agg(F.avg(rate("m", "h")).alias("p"), F.avg(rate("m", "r")).alias("q"))
    b2 = beta * beta
    return both.select(F.when(F.col("p") + F.col("q") > 0, 100 * (1 + b2) * F.col("p") * F.col("q") / (b2 * F.col("p") + F.col("q"))).otherwise(0.0).alias("chrf"))


@F.pandas_udf(IntegerType())
def nearest_option(answer: pd.Series, options: pd.Series) -> pd.Series:
    """Index of the option most like the answer by matching blocks (Ratcliff-Obershelp), the first of equals; 0 without an answer."""

    def pick(a, many):
        if many is None or not len(many):
            return None
        ratios = [difflib.SequenceMatcher(None, a or "", o or "").ratio() for o in many]
        return max(range(len(ratios)), key=lambda i: (ratios[i], -i)) if a else 0

    return pd.Series([pick(a, m) for a, m in zip(answer, options)], dtype="Int32")


def multiple_choice(prediction: Column, options: Column, right: Column) -> Column:
    """Whether the option nearest to the tagged answer is the right one."""
    return F.get(options, nearest_option(tagged_answer(prediction), options)) == right


def mean_scores(results: DataFrame) -> DataFrame:
    """One row: the mean of every column whose name ends in ``score``."""
    return results.agg(*(F.avg(c).alias(f"mean_{c}") for c in results.columns if c.endswith("score")))


def replicate(items: DataFrame, n: int) -> DataFrame:
    """Each item with sample_idx 0..n-1."""
    return items.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def score_series(results: DataFrame, by: list[str], step: str, score: str) -> DataFrame:
    """(by, step, n, mean) in order of step within each slice."""
    w = Window.partitionBy(*by).orderBy(step)
    return results.groupBy(*by, step).agg(F.count("*").alias("n"), F.avg(score).alias("mean")).withColumn("place", F.row_number().over(w))
