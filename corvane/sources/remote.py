"""What lies behind an API: paged lists and batched fetches, run in tasks by a client that the caller gives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from corvane.functions.arithmetic import back_off
from corvane.operators.analytics import changed
from corvane.runtime import materialize


def with_retry(call: Callable[[], Any], attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls until it succeeds, waiting longer each time; the last error is raised."""
    for i in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001  any failure of a remote call may pass
            if i == attempts - 1:
                raise
            sleep(back_off(i))


class RateLimiter:
    """At most n calls in a window of seconds, and a least gap between calls."""

    def __init__(self, n: int, window: float = 60.0, gap: float = 0.0, clock=time.monotonic, sleep=time.sleep):
        self.n, self.window, self.gap, self.clock, self.sleep = n, window, gap, clock, sleep
        self.start, self.count, self.last = clock(), 0, None

    def wait(self) -> None:
        now = self.clock()
        if now - self.start >= self.window:
            self.start, self.count = now, 0
        if self.count >= self.n:
            self.sleep(self.window - (now - self.start))
            self.start, self.count = self.clock(), 0
        if self.last is not None and self.gap > self.clock() - self.last:
            self.sleep(self.gap - (self.clock() - self.last))
        self.count, self.last = self.count + 1, self.clock()


def list_pages(plan: DataFrame, list_page: Callable[[dict, str | None], tuple[list[dict], str | None]], schema: str, attempts: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """All items of each plan row, page by page, and ``error``: list_page(row, token) gives (items, next token).

    A page that fails for good ends its plan row with a row that has only the error.
    """

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                token, more = None, True
                while more:
                    try:
                        items, token = with_retry(lambda: list_page(row, token), attempts, sleep)
                    except Exception as e:  # noqa: BLE001
                        items, token = [{"error": str(e) or type(e).__name__}], None
                    if items:
                        yield pd.DataFrame({n: pd.Series([i.get(n) for i in items], dtype=object) for n in names})
                    more = token is not None

    whole = f"{schema}, error string"
    names = StructType.fromDDL(whole).names
    return plan.mapInPandas(run, whole)


def fetch(keys: DataFrame, key: str, get: Callable[[Any], str], size: int = 100, attempts: int = 5, threads: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, content, error): what ``get`` gives, ``threads`` calls of a task at once; each is tried again, and failures are rows with their error, never dropped."""
    kind = keys.schema[key].dataType.simpleString()

    def one(k):
        try:
            return k, with_retry(lambda: get(k), attempts, sleep), None
        except Exception as e:  # noqa: BLE001
            return k, None, str(e) or type(e).__name__

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                with ThreadPoolExecutor(threads) as pool:
                    rows = list(pool.map(one, pdf[key].iloc[at : at + size]))
                yield pd.DataFrame(rows, columns=[key, "content", "error"])

    return keys.select(key).mapInPandas(run, f"`{key}` {kind}, content string, error string")


def refresh(path: str, listed: DataFrame, key: str, version: str, get: Callable[[Any], str], **options) -> tuple[DataFrame, DataFrame]:
    """Brings a Parquet table up to date: diffs what is listed with what is stored, fetches new and changed items, upserts.

    listed: (key, version). Returns the table, (key, version, content), and the
    rows whose fetch failed, (key, error); those keep their stored content and
    are asked for again next time. Every refresh writes a version of its own
    below ``path``, so a reader never sees half of one.
    """
    spark = listed.sparkSession
    before = latest_version(spark, path)
    old = spark.read.parquet(before) if before else listed.select(key, version).limit(0).withColumn("content", F.lit(None).cast("string"))
    due = changed(listed.select(key, version).dropDuplicates([key]), old, key, version)
    got = materialize(fetch(due, key, get, **options).join(due, key))
    new = got.where("error IS NULL").select(key, version, "content")
    following = f"{path}/v={int(before.rsplit('=', 1)[1]) + 1 if before else 0}"
    old.join(new.select(key), key, "left_anti").unionByName(new).write.parquet(following)
    return spark.read.parquet(following), got.where("error IS NOT NULL").select(key, "error")


def latest_version(spark, path: str) -> str | None:
    """The newest complete version v=<n> below a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    done = [x.getPath().getName() for x in system.listStatus(root) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    numbers = [int(n[2:]) for n in done if n.startswith("v=")]
    return f"{path}/v={max(numbers)}" if numbers else None
