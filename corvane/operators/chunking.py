"""Chunks and windows of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.sampling import below, uniform


def words(text: Column) -> Column:
    """The deterministic tokenizer: runs of non-blanks."""
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def fixed_chunks(df: DataFrame, text: str, size: int, keep: list[str]) -> DataFrame:
    """(keep, chunk_idx, chunk): consecutive pieces of ``size`` code points; no row for an empty text."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))
    pieces = F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size))))
    return df.select(*keep, F.posexplode(pieces).alias("chunk_idx", "chunk"))


def character_window(text: Column, size: int, u: Column) -> Column:
    """A window of ``size`` code points at a random start; the whole text if shorter."""
    start = below(u, F.greatest(F.lit(1), F.length(text) - size + 1))
    return F.substring(text, start + 1, F.lit(size))


def token_window(tokens: Column, low: int, high: int, u_size: Column, u_start: Column) -> Column:
    """A window of low..high tokens at a random start; all tokens if there are fewer."""
    size = F.least(F.size(tokens), low + below(u_size, high - low + 1))
    start = below(u_start, F.greatest(F.lit(1), F.size(tokens) - size + 1))
    return F.slice(tokens, start + 1, F.greatest(size, F.lit(0)))


def position_marks(chunk: Column, start: Column, end: Column) -> Column:
    """The chunk between notes on how many tokens come before its start and its end."""
    note = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit(" tokens preceding]"))
    return F.concat(note(start), F.lit("\n"), chunk, F.lit("\n"), note(end))


def truncate_with_dots(text: Column, size: int, u: Column) -> Column:
    """``... window ...`` of texts longer than ``size``; shorter ones stay."""
    return F.when(F.length(text) > size, F.concat(F.lit("... "), character_window(text, size, u), F.lit(" ..."))).otherwise(text)


def even_chunks(df: DataFrame, tokens: str, most: int, keep: list[str]) -> DataFrame:
    """(keep, chunk_idx, n_chunks, chunk): the fewest chunks of at most ``most`` tokens, of even size."""
    n = F.ceil(F.size(tokens) / most)
    sized = df.where(F.size(tokens) > 0).withColumn("__n", n).withColumn("__size", F.ceil(F.size(tokens) / F.col("__n")).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.col("__size")), lambda s: F.slice(F.col(tokens), s + 1, F.col("__size")))
    return sized.select(*keep, F.col("__n").cast("bigint").alias("n_chunks"), F.posexplode(pieces).alias("chunk_idx", "chunk"))


def sentence_windows(df: DataFrame, sentences: str, size: int, draws: int, seed: int, keep: list[str]) -> DataFrame:
    """(keep, draw, chunk): ``draws`` windows of ``size`` sentences at random starts."""
    drawn = df.where(F.size(sentences) > 0).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    start = below(uniform(seed, *keep, "draw"), F.greatest(F.lit(1), F.size(sentences) - size + 1))
    return drawn.select(*keep, "draw", F.array_join(F.slice(F.col(sentences), start + 1, F.lit(size)), ". ").alias("chunk"))
