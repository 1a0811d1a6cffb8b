"""Named queries over the driver's tables, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.runtime import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a scale-factor folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(key)
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def sql_uniform(seed: int, *keys: str) -> str:
    """The SQL twin of ``functions.sampling.uniform``."""
    parts = ", ".join(f"({k})::VARCHAR" for k in keys)
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
