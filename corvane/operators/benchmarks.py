"""Items, prompts and result rows of evaluation sets."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corvane.functions.sampling import rank_by_draw, uniform
from corvane.operators.synthesis import Client
from corvane.operators.temporal import joined_text


def sample_queries(samples: DataFrame, wanted: int) -> DataFrame:
    """(context, i, query, answers): the queries of one sample of a list of {context, queries}."""
    s = samples.select(F.element_at("samples", wanted + 1).alias("s"))
    return s.select(F.col("s.context").alias("context"), F.posexplode("s.queries").alias("i", "q")).select("context", "i", "q.query", "q.answers")


def render_sections(names: Column, paragraphs: Column) -> Column:
    """Section names with their paragraphs, one blank line between; the lists must be of one length."""
    body = F.zip_with(names, paragraphs, lambda n, p: F.concat(n, F.lit("\n"), F.array_join(p, "\n")))
    return F.when(F.size(names) == F.size(paragraphs), F.array_join(body, "\n\n")).otherwise(F.raise_error(F.lit("sections and paragraphs of two lengths")))


def word_lines(word: Column, values: Column) -> Column:
    """``word: a, b`` of a word list's entry."""
    return F.concat(word, F.lit(": "), F.array_join(values, ", "))


def mail_text(sender: Column, to: Column, date: Column, subject: Column, body: Column) -> Column:
    """One mail with its header lines."""
    lines = [F.concat(F.lit(f"{h}: "), F.coalesce(c, F.lit(""))) for h, c in (("From", sender), ("To", to), ("Date", date), ("Subject", subject))]
    return F.concat_ws("\n", *lines, F.lit(""), F.coalesce(body, F.lit("")))


def corpus_text(pieces: DataFrame, order: list[str], piece: Column, separator: str = "\n\n") -> DataFrame:
    """(text): a small corpus as one string, in one row."""
    return joined_text(pieces.withColumn("__all", F.lit(1)), ["__all"], order, piece, separator).select("text")


def first_shuffled(items: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """The first items of a seeded shuffle."""
    return items.orderBy(uniform(seed, key), key).limit(most)


def interleave(df: DataFrame, group: str, order: str, key: list[str], seed: int) -> DataFrame:
    """place: a uniformly random merge that keeps the order within each group.

    The i-th row of a group takes the i-th smallest of the group's draws.
    """
    own = Window.partitionBy(group)
    draw = uniform(seed, *key)
    placed = df.withColumn("__i", F.row_number().over(own.orderBy(order)))
    draws = df.select(F.col(group).alias("__g"), F.col(order).alias("__o"), draw.alias("__u"))
    draws = draws.select("__g", "__u", F.row_number().over(Window.partitionBy("__g").orderBy("__u", "__o")).alias("__i"))
    drawn = placed.join(draws, placed[group].eqNullSafe(draws["__g"]) & (placed["__i"] == draws["__i"])).drop("__g", "__i")
    return rank_by_draw(drawn, F.col("__u"), [group, order], "place").drop("__u")


def result_rows(results: DataFrame, scores: Column) -> DataFrame:
    """One row a score: a scalar is ``score``, named ones are ``<name>_score``. scores: map<string, double>, the scalar under ''."""
    each = results.select("*", F.explode(scores).alias("__k", "value"))
    return each.withColumn("metric", F.when(F.col("__k") == "", "score").otherwise(F.concat("__k", F.lit("_score")))).drop("__k")


def generate(items: DataFrame, key: str, client: Callable[[], Client], batch: int = 32) -> DataFrame:
    """(key, sample_idx, pred, error): what a client answers to (key, sample_idx, prompt); a failing batch is rows with the error.

    A task holds an Arrow batch and the texts of ``batch`` prompts, no copy of all.
    """
    schema = StructType([items.schema[key], StructField("sample_idx", IntegerType()), StructField("pred", StringType()), StructField("error", StringType())])
    asked = items.select(key, F.col("sample_idx").cast("int").alias("sample_idx"), "prompt")
    return asked.mapInArrow(_answers(client, batch, to_arrow_schema(schema)), schema)


def _answers(client: Callable[[], Client], batch: int, schema: pa.Schema):
    def run(batches):
        model = client()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part, error = rows.slice(at, batch), None
                try:
                    pred = model.chat([[{"role": "user", "content": p}] for p in part.column(2).to_pylist()])
                except Exception as e:  # noqa: BLE001  a client may fail in any way
                    pred, error = [None] * part.num_rows, str(e)
                answered = [part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array([error] * part.num_rows, pa.string())]
                yield pa.RecordBatch.from_arrays(answered, schema=schema)

    return run


def summarize(chunks: DataFrame, key: str, order: str, client: Callable[[], Client]) -> DataFrame:
    """(key, text): a summary of each chunk, joined in order."""
    asked = chunks.select(key, F.col(order).cast("int").alias("sample_idx"), F.concat(F.lit("Summarize:\n"), "chunk").alias("prompt"))
    return joined_text(generate(asked, key, client), [key], ["sample_idx"], F.coalesce("pred", F.lit("")), "\n")


def method_source(name: Column, inputs: Column, values: Column) -> Column:
    """Python of a method that maps inputs to values."""
    branch = F.zip_with(inputs, values, lambda i, v: F.concat(F.lit("    if x == '"), i, F.lit("':\n        return "), v))
    return F.concat(F.lit("def "), name, F.lit("(x):\n"), F.array_join(branch, "\n"))


def answers_by_key(needles: DataFrame, key: list[str], order: str, answer: str) -> DataFrame:
    """(key, answers): the answers of all needles of a key, in order."""
    rows = needles.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, answer))).alias("__a"))
    return rows.select(*key, F.transform("__a", lambda x: x[answer]).alias("answers"))
