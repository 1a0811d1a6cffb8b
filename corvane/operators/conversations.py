"""Conversations in long form (conv_id, turn, role, text) and as arrays of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def nest(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): array<struct<turn, role, content>> in turn order."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def search(turns: DataFrame, text: str, in_messages: bool = True, extra: tuple[str, ...] = (), key: str = "conv_id") -> DataFrame:
    """(key, n_turns, n_chars) of conversations in which an enabled field holds the trimmed text, case aside.

    extra: further string columns to look in. With no field enabled, no row.
    """
    wanted = F.lit(text.strip().lower())
    fields = ([F.col("text")] if in_messages else []) + [F.col(c) for c in extra]
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(f, F.lit(""))), wanted)
    per = turns.groupBy(key).agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("n_chars"), F.bool_or(hit).alias("hit"))
    return per.where("hit").drop("hit")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page, counted from 0, of rows in a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def flip_roles(role: Column) -> Column:
    """user and assistant change places; others stay."""
    return F.when(role == "user", "assistant").when(role == "assistant", "user").otherwise(role)


def trim_messages(messages: Column) -> Column:
    """Each message cut down to role and content."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def last_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Last user and last assistant text of each conversation that has both, not empty."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]
    per = turns.groupBy(key).agg(last("user").alias("question"), last("assistant").alias("answer"))
    return per.where("question <> '' AND answer <> ''")


def is_valid(messages: Column) -> Column:
    """Two messages at least, the last by the assistant."""
    return (F.size(messages) > 1) & (F.element_at(messages, -1)["role"] == "assistant")


def split_prompt(nested: DataFrame) -> DataFrame:
    """prompt (all messages but the last) and answer (the last content) of valid conversations."""
    m = F.col("messages")
    return nested.where(is_valid(m)).withColumns({"prompt": F.slice(m, F.lit(1), F.size(m) - 1), "answer": F.element_at(m, -1)["content"]}).drop("messages")


def prepend_system(turns: DataFrame, text: str, key: str = "conv_id") -> DataFrame:
    """A system turn before the first one; turns are counted anew from 0."""
    first = turns.groupBy(key).agg(F.min("turn").alias("low")).select(key, (F.col("low") - 1).alias("turn"), F.lit("system").alias("role"), F.lit(text).alias("text"))
    w = Window.partitionBy(key).orderBy("turn")
    return turns.select(key, "turn", "role", "text").unionByName(first).withColumn("turn", (F.row_number().over(w) - 1).cast("bigint"))


def usage(turns: DataFrame, tokens: Column, key: str = "conv_id") -> DataFrame:
    """Prompt and completion tokens, and those of earlier prompts that a later one repeats."""
    w = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    each = turns.withColumn("n", tokens).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    reply = F.col("role") == "assistant"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    per = each.groupBy(key).agg(total(F.when(reply, F.col("before"))).alias("prompt_tokens"), total(F.when(reply, F.col("n"))).alias("completion_tokens"), F.coalesce(F.max(F.when(reply, F.col("before"))), F.lit(0)).cast("bigint").alias("distinct_tokens"))
    return per.select(key, "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") - F.col("distinct_tokens")).alias("seen_prompt_tokens"), F.col("distinct_tokens").alias("new_prompt_tokens"), (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


def chat_tokens(turns: DataFrame, tokens: Column, key: str = "conv_id", reply_prompt: bool = False) -> DataFrame:
    """Tokens of a chat: three a message besides its content and role, three more if a reply is primed."""
    per = turns.groupBy(key).agg(F.sum(tokens + F.lit(1) + 3).cast("bigint").alias("chat_tokens"))
    return per.withColumn("chat_tokens", F.col("chat_tokens") + (3 if reply_prompt else 0))


def shared_prefix(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, common): how many leading messages two versions of each conversation share; both are (key, turn, role, text)."""
    a = left.select(key, "turn", F.struct("role", "text").alias("a"))
    b = right.select(key, "turn", F.struct("role", "text").alias("b"))
    w = Window.partitionBy(key).orderBy("turn")
    met = a.join(b, [key, "turn"], "left").withColumn("same", F.coalesce((F.col("a") == F.col("b")).cast("int"), F.lit(0)))
    met = met.withColumn("so_far", F.min("same").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return met.groupBy(key).agg(F.sum("so_far").cast("bigint").alias("common"))


def to_html(messages: Column) -> Column:
    """A conversation as a fragment of HTML, contents escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<div><b>"), m["role"], F.lit("</b>: "), escape(m["content"]), F.lit("</div>"))), "\n")
