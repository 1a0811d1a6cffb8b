"""Conversation tables: Parquet, legacy pickles, and previews."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.sampling import uniform
from corvane.schemas import CONVERSATION


def read(spark: SparkSession, path: str, trusted_pickle: bool = False) -> DataFrame:
    """By suffix: Parquet with the declared schema, or a pickle of trusted origin; else ValueError."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(CONVERSATION).parquet(path)
    if path.endswith(".pkl"):
        if not trusted_pickle:
            raise ValueError("a pickle runs code when read; pass trusted_pickle=True for one of your own")
        return from_pickle(spark, path)
    raise ValueError(f"not a conversation file: {path}")


def from_pickle(spark: SparkSession, path: str) -> DataFrame:
    """A one-off converter: one file holds one list, read by one task; a legacy {"rows": [...]} is unwrapped."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = pickle.loads(content)
                rows = rows["rows"] if isinstance(rows, dict) else rows
                yield pd.DataFrame([{"messages": [{k: m.get(k) for k in ("content", "role", "token_ids", "top_logprobs")} for m in r["messages"]], "system_prompt": r.get("system_prompt"), "metadata": {str(k): str(v) for k, v in (r.get("metadata") or {}).items()}, "type": r.get("type")} for r in rows], columns=CONVERSATION.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, CONVERSATION)


def write(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Snappy Parquet."""
    df.write.mode(mode).partitionBy(*partition_by).option("compression", "snappy").parquet(path)


def read_many(spark: SparkSession, sources: list[dict], fetch: Callable[[dict], list[str]] | None = None) -> DataFrame:
    """Union of sources {path, type: local|remote, limit, order}; a bare string is local if it names a Parquet or pickle file.

    fetch gives the Parquet paths of a remote source, of which those under data/ are read in order of name.
    """
    out = None
    for s in sources:
        s = {"path": s, "type": "local" if ".parquet" in s or ".pkl" in s else "remote"} if isinstance(s, str) else s
        if s.get("type", "local") == "local":
            df = read(spark, s["path"], s.get("trusted_pickle", False))
        elif fetch is None:
            raise ValueError(f"no fetch function for {s['path']}")
        else:
            df = spark.read.schema(CONVERSATION).parquet(*sorted(p for p in fetch(s) if p.endswith(".parquet")))
        if s.get("limit") is not None:
            df = df.orderBy(s.get("order") or F.to_json("messages")).limit(s["limit"])
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("no source")
    return out


def preview(nested: DataFrame, key: str, messages: str, seed: int = 0, rows: int | None = 256, width: int = 4) -> DataFrame:
    """At most ``rows`` random rows (None: all, in no order) with message_0.. as columns."""
    m = F.col(messages)
    shown = nested if rows is None else nested.orderBy(uniform(seed, key), key).limit(rows)
    return shown.select(key, F.size(m).alias("n_messages"), *(F.get(m, F.lit(i))["content"].alias(f"message_{i}") for i in range(width)))


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of data files under a folder, not empty, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    return files.where(F.col("path").rlike(r"\.(pkl|parquet)$") & (F.col("bytes") > 0)).orderBy("path")
