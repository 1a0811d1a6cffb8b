"""Event streams: deduplicated, counted in windows, and upserted batch by batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.operators.analytics import latest


def read_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, some files a batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Wall-clock times as UTC instants, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def window_counts(events: DataFrame, width: str, late: str, by: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """(window_start, by, n, total): tumbling windows; rows later than the watermark are left out of a stream."""
    counted = event_time(events, time).withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *by, "n", F.round("total", 4).alias("total"))


def distinct_events(events: DataFrame, keys: list[str], late: str, time: str = "ts") -> DataFrame:
    """Each key once; a stream forgets keys older than the watermark."""
    timed = event_time(events, time).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def sliding_counts(events: DataFrame, width: str, slide: str, late: str, by: list[str], time: str = "ts") -> DataFrame:
    """(window_start, by, n): windows of ``width`` that begin every ``slide``, so an event is in several."""
    counted = event_time(events, time).withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("n"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), *by, "n")


def streaks(events: DataFrame, by: str, late: str, time: str = "ts", key: str = "event_id", value: str = "event_type") -> DataFrame:
    """(by, n, changes, last): per key the events so far, how often ``value`` changed from one to the next, and its last value.

    A stateful operator: state is three numbers a key, kept between batches;
    events of a batch are taken in order of time, then key. One row a key and batch that
    touches it.
    """
    kind = events.schema[by].dataType.simpleString()

    def step(group, batches, state):
        n, changes, last = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(batches)).sort_values([time, key])
        values = rows[value].tolist()
        changes += sum(a != b for a, b in zip([last, *values], values) if a is not None)
        state.update((n + len(values), changes, values[-1]))
        yield pd.DataFrame({by: [group[0]], "n": [n + len(values)], "changes": [changes], "last": [values[-1]]})

    timed = event_time(events, time).withWatermark(time, late).select(by, time, key, value)
    return timed.groupBy(by).applyInPandasWithState(step, f"`{by}` {kind}, n long, changes long, last string", "n long, changes long, last string", "update", "NoTimeout")


def run_to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over all there is into Parquet below ``folder``, a place of its own, and reads it back.

    complete: the last result; append and update: the rows of all batches, with
    ``epoch``. A batch that is run again after a failure overwrites its own files.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table" if mode == "complete" else f"{folder}/table/epoch={epoch}")

    schema = stream.schema
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema if mode == "complete" else StructType([*schema, StructField("epoch", LongType())])).parquet(f"{folder}/table")


def upsert_each_batch(stream: DataFrame, path: str, by: list[str], recency: list, checkpoint: str, parts: int = 64) -> None:
    """Keeps the latest row of each key in a table of ``parts`` parts by a hash of the key.

    A micro-batch rewrites only the parts that it touches, each into a version
    of its own, v=<epoch>/part=<n>; a batch that is run again overwrites its
    own version. ``read_upserted`` reads the newest version of every part.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, epoch: int) -> None:
        fresh = batch.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
        touched = {r[0] for r in fresh.select("part").distinct().collect()}  # at most ``parts``
        held = {n: folder for n, folder in _newest_parts(spark, path, epoch).items() if n in touched}
        before = _read_parts(spark, held, schema).withColumn("part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
        latest(fresh.unionByName(before), by, recency).write.mode("overwrite").partitionBy("part").parquet(f"{path}/v={epoch}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _versions(spark: SparkSession, path: str) -> list[tuple[int, dict[int, str]]]:
    """Number and part folders of each complete version, oldest first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = hadoop(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    number = lambda x: int(x.getPath().getName().split("=")[1])
    versions = [x for x in system.listStatus(root) if x.getPath().getName().startswith("v=") and system.exists(hadoop(x.getPath(), "_SUCCESS"))]
    parts = lambda v: {number(x): x.getPath().toString() for x in system.listStatus(v.getPath()) if x.getPath().getName().startswith("part=")}
    return sorted(((number(v), parts(v)) for v in versions), key=lambda v: v[0])


def _newest_parts(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """Folder of the newest complete version of each part, of versions below ``before``."""
    out = {}
    for number, folders in _versions(spark, path):
        if before is None or number < before:
            out |= folders
    return out


def _read_parts(spark: SparkSession, parts: dict[int, str], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*parts.values()) if parts else spark.createDataFrame([], schema)


def read_upserted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that ``upsert_each_batch`` keeps."""
    return _read_parts(spark, _newest_parts(spark, path), schema)


def vacuum_upserted(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes the parts of ``upsert_each_batch`` that ``keep`` newer complete versions replace; returns their folders.

    A batch that is run again reads what was before it, so at least two versions of a
    part stay.  Versions that aren't complete are left alone, as they may be in the making.
    """
    if keep < 2:
        raise ValueError("the newest version of a part may be written again, from the one before it")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone, seen = [], {}
    for _, folders in sorted(_versions(spark, path), key=lambda v: -v[0]):
        for part, folder in folders.items():
            seen[part] = seen.get(part, 0) + 1
            if seen[part] > keep:
                gone.append(folder)
    for folder in gone:
        system.delete(hadoop(folder), True)
    return sorted(gone)
