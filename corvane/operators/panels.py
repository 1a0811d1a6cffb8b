"""Contexts from records made of parts: patients and their notes, papers and their sections.

Parts are rows, so only the texts that a draw takes are moved; what is held of a
record at once is the list of its parts' names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.sampling import below, rank_by_draw, uniform


def draw_parts(parts: DataFrame, record: str, part: str, draws: int, seed: int, least: int = 1, most: int = 1) -> DataFrame:
    """(draw, record, place, part): each draw takes one record, evenly, and least..most of its parts without replacement, in drawn order.

    A record with fewer parts gives all of them.  Repeated names of a part count
    once, null ones and null records not at all.  Draws are hashes of (seed, draw),
    whatever the partitioning.  Counts the records.
    """
    if not 0 < least <= most:
        raise ValueError("a draw takes at least one part, and no fewer than that at most")
    named = parts.where(F.col(record).isNotNull() & F.col(part).isNotNull())
    listed = named.groupBy(record).agg(F.array_sort(F.collect_set(part)).alias("__parts"))
    placed = rank_by_draw(listed, uniform(seed, record), [record], "__at")
    asked = parts.sparkSession.range(draws).withColumnRenamed("id", "draw")
    asked = asked.withColumn("__at", below(uniform(seed + 1, "draw"), F.lit(listed.count()))).withColumn("__n", least + below(uniform(seed + 2, "draw"), most - least + 1))
    order = F.array_sort(F.transform("__parts", lambda p: F.struct(uniform(seed + 3, F.col("draw"), p).alias("u"), p.alias("p"))))
    taken = asked.join(placed.withColumn("__at", F.col("__at").cast("int")), "__at").select("draw", record, F.slice(order, F.lit(1), F.col("__n")).alias("__taken"))
    return taken.select("draw", record, F.posexplode("__taken").alias("place", "__p")).select("draw", record, "place", F.col("__p.p").alias(part))


def window_of(text: Column, most: int | None, draw: Column) -> Column:
    """The text, or a drawn stretch of ``most`` characters of a longer one between dots."""
    if most is None:
        return text
    stretch = F.substring(text, below(draw, F.length(text) - most + 1) + 1, F.lit(most))
    return F.when(F.length(text) > most, F.concat(F.lit("... "), stretch, F.lit(" ..."))).otherwise(text)


def _assembled(rows: DataFrame, by: list[str], place: str, shown: Column, separator: str) -> DataFrame:
    """(by, n_parts, body): the shown parts of each group in order."""
    pieces = rows.select(*by, F.struct(F.col(place).alias("o"), shown.alias("t")).alias("__x"))
    return pieces.groupBy(*by).agg(F.count("*").cast("int").alias("n_parts"), F.array_join(F.transform(F.array_sort(F.collect_list("__x")), lambda x: x["t"]), separator).alias("body"))


def drawn_contexts(records: DataFrame, parts: DataFrame, record: str, part: str, text: str, frame: Callable[[Column, Column], Column], whole: Callable[[Column, Column], Column], draws: int, seed: int, least: int = 1, most: int = 1, max_chars: int | None = None, separator: str = "\n") -> DataFrame:
    """(draw, record, n_parts, context): ``whole(body, n_parts)`` around drawn parts, each shown by ``frame(part, text)``.

    records: one row a record, with the columns that ``whole`` reads; records
    without a row here give no context.  ``max_chars`` cuts longer parts to a drawn window; a null text is empty.
    """
    drawn = draw_parts(parts, record, part, draws, seed, least, most)
    rows = drawn.join(parts.select(record, part, F.coalesce(text, F.lit("")).alias("__text")), [record, part])
    shown = frame(F.col(part), window_of(F.col("__text"), max_chars, uniform(seed + 4, "draw", part)))
    made = _assembled(rows, ["draw", record], "place", shown, separator)
    return made.join(records, record).select("draw", record, "n_parts", whole(F.col("body"), F.col("n_parts")).alias("context"))


def whole_contexts(records: DataFrame, parts: DataFrame, record: str, part: str, text: str, frame: Callable[[Column, Column], Column], whole: Callable[[Column, Column], Column], separator: str = "\n") -> DataFrame:
    """(record, n_parts, context): every record with all its parts by name; a record without parts has an empty body."""
    rows = parts.where(F.col(record).isNotNull() & F.col(part).isNotNull()).select(record, part, F.coalesce(text, F.lit("")).alias("__text"))
    made = _assembled(rows, [record], part, frame(F.col(part), F.col("__text")), separator)
    n, body = F.coalesce("n_parts", F.lit(0)), F.coalesce("body", F.lit(""))
    return records.join(made, record, "left").select(record, n.alias("n_parts"), whole(body, n).alias("context"))


def tagged(name: Column, text: Column) -> Column:
    """The text on lines of its own between tags of that name."""
    return F.concat(F.lit("<"), name, F.lit(">\n"), text, F.lit("\n</"), name, F.lit(">"))


def patient_frame(body: Column, n: Column) -> Column:
    """A patient's record: who, what, and the notes.  Reads patient, name, birthday, diagnosis; what is missing is unknown."""
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    head = F.concat(F.lit("Medical record of "), known("name"), F.lit(" (ID: "), F.col("patient"), F.lit("), born on "), known("birthday"), F.lit(", diagnosis: "), known("diagnosis"), F.lit(". It has "), n.cast("string"), F.lit(" notes.\n"))
    return tagged(F.concat(F.lit("patient-record-"), F.col("patient")), F.concat(head, tagged(F.lit("notes"), body)))


def paper_frame(body: Column, _: Column) -> Column:
    """A paper: title, abstract, sections.  Reads title, abstract; what is missing is empty."""
    field = lambda c: tagged(F.lit(c), F.coalesce(F.col(c), F.lit("")))
    return tagged(F.lit("paper"), F.concat_ws("\n", field("title"), field("abstract"), tagged(F.lit("sections"), body)))
