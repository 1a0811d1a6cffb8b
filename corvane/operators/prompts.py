"""Prompts: seed prompts by kind and variant, item prompts of evaluation sets, and contexts cut to size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.sampling import below, uniform
from corvane.operators.chunking import token_window
from corvane.operators.temporal import joined_text

#: Templates of the kinds of seed prompt that vary: (kind, template with {x}, choices of x).
VARIED = (
    ("structuring", "Write one message that asks to give a part of the context as {x}. Say which part; names and numbers must be exact.", ("JSON", "YAML", "TOML", "INI", "XML", "plain text")),
    ("summarization", "Write one message that asks for {x} of one section of the context. Name the section.", ("a short summary", "a detailed summary", "a list of the main points")),
    ("question", "Write one question whose answer stands in the context, asking for {x}.", ("a fact", "a number or a date", "a reason", "a comparison")),
    ("use_case", "Write one message that asks how {x} would use what the context says.", ("a practitioner", "a student", "a reviewer")),
    ("creative", "Write one message that asks for {x} inspired by the context.", ("a poem", "a story", "a dialogue", "an analogy")),
    ("generic", "Start a conversation about the context with {x}.", ("a greeting and a question", "a request", "an observation")),
    ("qa", "Ask one precise question about the context and expect {x}.", ("a single word", "one sentence", "a number")),
)


def varied_prompts(keys: DataFrame, key: str, kinds: tuple[str, ...], draws: int, seed: int) -> DataFrame:
    """(key, draw, kind, variant, prompt): kind and variant drawn with replacement by hashes; an unknown kind raises ValueError."""
    table = {kind: (text, choices) for kind, text, choices in VARIED}
    if unknown := set(kinds) - set(table):
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    rows = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    rows = rows.withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), below(uniform(seed, key, "draw"), len(kinds)) + 1))
    entry = lambda f: F.create_map(*(x for k in kinds for x in (F.lit(k), f(*table[k]))))[F.col("kind")]
    choices = entry(lambda _, c: F.array(*map(F.lit, c)))
    rows = rows.withColumn("variant", F.element_at(choices, below(uniform(seed + 1, key, "draw"), F.size(choices)) + 1))
    return rows.withColumn("prompt", F.replace(entry(lambda t, _: F.lit(t)), F.lit("{x}"), F.col("variant")))


def cut_context(tokens: Column, most: int, separator: str = " ") -> Column:
    """A context's first ``most`` tokens as text."""
    return F.array_join(F.slice(tokens, 1, most), separator)


def context_prompts(items: DataFrame, contexts: DataFrame, key: str, tokens: str, most: int, question: str) -> DataFrame:
    """(*items, prompt, n_context, cut): each question under its context, joined by ``key``, cut to ``most`` tokens; items without a context have none."""
    joined = items.join(contexts.select(key, F.col(tokens).alias("__t")), key, "left")
    n = F.coalesce(F.size("__t"), F.lit(0))
    text = F.coalesce(cut_context(F.col("__t"), most), F.lit(""))
    return joined.withColumns({"prompt": F.concat(text, F.when(n > 0, F.lit("\n\n")).otherwise(F.lit("")), F.col(question)), "n_context": F.least(n, F.lit(most)), "cut": n > most}).drop("__t")


def described_window(description: Column, tokens: Column, low: int, high: int, u_size: Column, u_start: Column) -> Column:
    """A window of low..high tokens behind a description of the text that it comes from."""
    return F.concat(description, F.lit("\n\n"), F.array_join(token_window(tokens, low, high, u_size, u_start), " "))


def reference_prompt(given: DataFrame, order: str, what: Column, text: Column) -> DataFrame:
    """(prompt): what is given, named in one sentence, then each text in order; a small set of reference texts, in one row."""
    rows = given.select(order, what.alias("what"), text.alias("text"))
    named = joined_text(rows.withColumn("all", F.lit(1)), ["all"], [order], F.col("what"), ", ").select("all", F.concat(F.lit("You are given "), "text", F.lit(".")).alias("head"))
    body = joined_text(rows.withColumn("all", F.lit(1)), ["all"], [order], F.col("text"), "\n\n")
    return named.join(body, "all").select(F.concat("head", F.lit("\n\n"), "text").alias("prompt"))


def item_prompts(items: DataFrame, kind: Column, **columns: Column) -> Column:
    """The prompt of an evaluation item by its kind.

    columns: context, question, options (array<string>). ``choice`` lists its
    options and asks for one in tags; ``list`` asks for all values;
    ``translation`` for the translation alone; ``lookup`` for the literal that a
    call returns; others for a short answer.
    """
    ask, options = columns["question"], columns.get("options", F.array().cast("array<string>"))
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("- "), o)), "\n")
    return (
        F.when(kind == "choice", F.concat(ask, F.lit("\n\nOptions:\n"), listed, F.lit("\n\nGive the option as <answer>option</answer>.")))
        .when(kind == "list", F.concat(ask, F.lit("\nGive all values as: The answers are: a, b.")))
        .when(kind == "translation", F.concat(F.lit("Translate: "), ask, F.lit("\nGive the translation only.")))
        .when(kind == "lookup", F.concat(F.lit("What does "), ask, F.lit(" return? Give the literal only.")))
        .otherwise(F.concat(ask, F.lit("\nAnswer briefly.")))
    )


def haystack_source(kind: Column, essay: Column, noise: Column, needle: Column, n: Column) -> Column:
    """The sentences that a haystack is made of, by kind: those of an essay, a noise sentence n times, or n needle-like ones."""
    repeat = lambda x: F.array_repeat(x, n)
    numbered = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.concat(needle, F.lit(" "), i.cast("string")))
    return F.when(kind == "essay", essay).when(kind == "noise", repeat(noise)).when(kind == "needle", numbered).otherwise(F.raise_error(F.concat(F.lit("unknown haystack: "), kind)))


def label_choice(labels: Column, u: Column, first: bool = False) -> Column:
    """One of a list of labels: the first, or a uniform draw; null without labels."""
    return F.when(F.size(labels) > 0, F.get(labels, F.lit(0) if first else below(u, F.size(labels))))
