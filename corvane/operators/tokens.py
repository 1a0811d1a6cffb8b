"""Token ids of messages: thinking spans, stored log-probabilities, packed arrays, and streams of tokens."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.operators.packing import markers

#: Tokens that open and close a thinking span, by model family.
THINKING = {"qwen": (151667, 151668)}
#: Tokens that open a header, close it, and end a message, by model family.
HEADERS = {"llama": (128006, 128007, 128009)}


def drop_thinking_tokens(messages: DataFrame, family: str = "qwen", ids: str = "token_ids", logprobs: str = "logprobs") -> DataFrame:
    """Messages without what is inside their thinking span, of ids and sparse log-probabilities.

    logprobs: array<struct<token_idx, token_id, logprob>> or null. Both marks
    stay, places behind the span move up by what went, and entries of tokens
    that went go too. A message without both marks in order stays as it is.
    """
    opens, closes = THINKING[family]
    marked = messages.withColumns({"__start": F.array_position(ids, F.lit(opens)), "__end": F.array_position(ids, F.lit(closes))})
    start, end = F.col("__start"), F.col("__end")
    has = (start > 0) & (end > start)
    gone = (end - start - 1).cast("int")
    kept = F.when(has, F.concat(F.slice(ids, F.lit(1), start.cast("int")), F.slice(ids, end.cast("int"), F.greatest(F.lit(0), F.size(ids) - end.cast("int") + 1)))).otherwise(F.col(ids))

    def moved(x: Column) -> Column:
        at = x["token_idx"]
        return F.struct(F.when(at >= end - 1, at - gone).otherwise(at).cast("int").alias("token_idx"), x["token_id"].alias("token_id"), x["logprob"].alias("logprob"))

    inside = lambda x: (x["token_idx"] >= start) & (x["token_idx"] < end - 1)
    entries = F.when(has, F.transform(F.filter(logprobs, lambda x: ~inside(x)), moved)).otherwise(F.transform(logprobs, lambda x: F.struct(x["token_idx"].cast("int").alias("token_idx"), x["token_id"].alias("token_id"), x["logprob"].alias("logprob"))))
    return marked.withColumns({ids: kept, logprobs: entries}).drop("__start", "__end")


def build_stored_elements(messages: DataFrame, family: str, key: str = "conv_id") -> DataFrame:
    """(key, input_ids, targets) from (key, turn, role, token_ids, logprobs): elements with the teacher's stored log-probabilities.

    A message whose ids lack the end marker, as generation ran out, gets it
    unless it is the last; markers that follow the end come after it, but for
    the last. targets: array<struct<token_idx, token_id, logprob>>, each
    message's entries moved to where its ids stand; messages without entries
    give none.
    """
    table = F.broadcast(markers(messages.sparkSession).where(F.col("family") == family))  # three rows
    own = Window.partitionBy(key)
    rows = messages.join(table, "role").withColumn("last", F.col("turn") == F.max("turn").over(own))
    head = F.concat("start_ids", "token_ids")
    n = F.size("end_ids")
    ended = (F.size(head) >= n) & (F.slice(head, F.greatest(F.lit(1), F.size(head) - n + 1), n) == F.col("end_ids"))
    none = F.array().cast("array<int>")
    tail = F.when(F.col("last"), none).when(ended, F.col("extra_ids")).otherwise(F.concat("end_ids", "extra_ids"))
    rows = rows.withColumn("ids", F.concat(head, tail))
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.size("ids")).over(own.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    at = lambda x: F.struct((x["token_idx"] + F.col("offset") + F.size("start_ids")).cast("int").alias("token_idx"), x["token_id"].alias("token_id"), x["logprob"].alias("logprob"))
    rows = rows.withColumn("moved", F.coalesce(F.transform("logprobs", at), F.array().cast("array<struct<token_idx:int,token_id:int,logprob:double>>")))
    ordered = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "ids", "moved"))).alias("m"))
    return ordered.select(key, F.flatten(F.transform("m", lambda x: x["ids"])).alias("input_ids"), F.flatten(F.transform("m", lambda x: x["moved"])).alias("targets"))


def decode_arrays(packed: DataFrame, key: str) -> DataFrame:
    """(key, token_idx, k, token_id, logprob) from (key, chosen, indices, logprobs), base64 of float32, int32 and float32 arrays.

    The number of chosen values is the number of tokens T; the other two are
    (T, K) in rows. Rows without tokens, and rows whose arrays don't fit, are
    none; ``undecodable`` lists the latter.
    """
    kind = packed.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                arrays = _arrays(row.chosen, row.indices, row.logprobs)
                if arrays is None or not len(arrays[0]):
                    continue
                chosen, ids, logs = arrays
                width = len(ids) // len(chosen)
                yield pd.DataFrame({key: row[0], "token_idx": np.repeat(np.arange(len(chosen), dtype=np.int32), width), "k": np.tile(np.arange(width, dtype=np.int32), len(chosen)), "token_id": ids, "logprob": logs.astype(np.float64)})

    return packed.select(key, "chosen", "indices", "logprobs").mapInPandas(run, f"`{key}` {kind}, token_idx int, k int, token_id int, logprob double")


def _arrays(chosen, indices, logprobs):
    try:
        c, i, p = (np.frombuffer(base64.b64decode(x, validate=True), dtype=t) for x, t in ((chosen, "<f4"), (indices, "<i4"), (logprobs, "<f4")))
    except (TypeError, ValueError):
        return None
    return (c, i, p) if len(i) == len(p) and (not len(c) or len(i) % len(c) == 0) else None


def undecodable(packed: DataFrame, key: str) -> DataFrame:
    """(key) of rows that ``decode_arrays`` can't read."""
    kind = packed.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            bad = [_arrays(*x) is None for x in zip(pdf["chosen"], pdf["indices"], pdf["logprobs"])]
            yield pdf.loc[bad, [key]]

    return packed.select(key, "chosen", "indices", "logprobs").mapInPandas(run, f"`{key}` {kind}")


def split_messages(tokens: DataFrame, family: str = "llama", key: str = "stream_id") -> DataFrame:
    """(key, message, role_ids, token_ids) of streams (key, pos, token_id) that headers and end markers cut into messages.

    A message begins with its header and goes to its end marker, which it
    keeps; a stream's last message without one is left out, as are tokens
    between messages.
    """
    opens, closes, ends = HEADERS[family]
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("message", F.sum(F.when(F.col("token_id") == opens, 1).otherwise(0)).over(so_far))
    within = Window.partitionBy(key, "message").orderBy("pos")
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("message > 0").withColumn("closed", F.sum(F.when(F.col("token_id") == closes, 1).otherwise(0)).over(up_to))
    rows = rows.withColumn("ended", F.coalesce(F.sum(F.when((F.col("token_id") == ends) & (F.col("closed") > 0), 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = F.when((F.col("closed") == 0) & (F.col("token_id") != opens), "role").when((F.col("closed") > 0) & (F.col("token_id") != closes) & (F.col("ended") == 0), "body")
    told = rows.withColumn("part", part).where("part IS NOT NULL")
    gather = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("pos", "token_id")))), lambda x: x["token_id"])
    out = told.groupBy(key, "message").agg(gather("role").alias("role_ids"), gather("body").alias("token_ids"))
    out = out.where(F.array_contains("token_ids", F.lit(ends)))
    return out.withColumn("message", (F.row_number().over(Window.partitionBy(key).orderBy("message")) - 1).cast("int"))


def fill_sections(lines: DataFrame, by: list[str], order: str, text: str, tokens: str, most: int, buffer: int = 20) -> DataFrame:
    """(by, section, n_sections, content, tokens): lines put in order into sections until the next one with ``buffer`` tokens to spare no longer fits.

    A line that fits no section raises an error. The fold is over one
    document's lines, an array of a row, and keeps where each section begins.
    """
    checked = F.when(F.col(tokens) + buffer < most, F.col(tokens)).otherwise(F.raise_error(F.lit("a line is longer than a section"))).cast("bigint")
    folded = lines.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("line"), checked.alias("n")))).alias("__l"))
    state = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("place"), F.array(F.lit(1)).alias("starts"))

    def put(s: Column, x: Column) -> Column:
        over, place = s["used"] + x["n"] + buffer > most, s["place"] + 1
        return F.struct(F.when(over, x["n"]).otherwise(s["used"] + x["n"]).alias("used"), place.alias("place"), F.when(over, F.concat(s["starts"], F.array(place))).otherwise(s["starts"]).alias("starts"))

    cut = folded.withColumn("__s", F.aggregate("__l", state, put)["starts"]).select(*by, "__l", "__s", F.posexplode("__s").alias("__i", "__from"))
    held = F.slice("__l", F.col("__from"), F.coalesce(F.get("__s", F.col("__i") + 1), F.size("__l") + 1) - F.col("__from"))
    rows = cut.select(*by, (F.col("__i") + 1).alias("section"), F.size("__s").cast("bigint").alias("n_sections"), held.alias("__h"))
    return rows.select(*by, "section", "n_sections", F.array_join(F.transform("__h", lambda x: x["line"]), "\n").alias("content"), F.aggregate("__h", F.lit(0).cast("bigint"), lambda t, x: t + x["n"]).alias("tokens"))
