"""Work keyed by batch, written batch by batch in few jobs, that goes on where it was killed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.runtime import exists

#: Batches that one job makes and commits together.
TOGETHER = 256


def finished(spark: SparkSession, path: str) -> DataFrame:
    """(batch) of the batches that were committed."""
    done = f"{path}/_done"
    rows = spark.read.schema("batch string").parquet(done) if exists(spark, done) else spark.createDataFrame([], "batch string")
    return rows.distinct()


def run(rows: DataFrame, batch: str, make: Callable[[DataFrame], DataFrame], path: str, together: int = TOGETHER) -> int:
    """Writes ``make(rows)`` below ``path``, one folder a batch, and returns how many batches were made.

    ``make`` keeps the column ``batch``; rows of all batches of a job go through it at once, so a
    job is as wide as all of them. A job overwrites its batches' folders and no others, and then notes them as done;
    after a kill or an error the next run makes the batches that aren't noted,
    those of the broken job from the start. A batch without results is noted too. Rows
    without a batch are left out. The driver holds the names of the missing batches.
    """
    spark = rows.sparkSession
    key = F.col(batch).cast("string")
    missing = rows.where(F.col(batch).isNotNull()).select(key.alias("batch")).distinct().join(finished(spark, path), "batch", "left_anti")
    names = sorted(r.batch for r in missing.collect())
    for i in range(0, len(names), together):
        part = names[i : i + together]
        made = make(rows.where(key.isin(part)))
        made.withColumn(batch, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(f"{path}/table")
        spark.createDataFrame([(x,) for x in part], "batch string").coalesce(1).write.mode("append").parquet(f"{path}/_done")
    return len(names)


def results(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The rows of the batches that are noted as done, with ``batch`` as a string."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/table").withColumn(batch, F.col(batch).cast("string"))
    return rows.join(finished(spark, path).withColumnRenamed("batch", batch), batch, "left_semi")
