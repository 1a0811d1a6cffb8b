"""Embeddings kept by the digest of their text: what is known is never computed again.

A cache is a folder of appended versions.  A run looks up the digests of its
texts, computes each missing distinct text once, in batches of at most BATCH,
and appends what it computed as one version, which appears whole or not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from corvane.runtime import children, discard, exists, fresh_path, move, publish, remove, ship

#: Texts that a model is given at once.
BATCH = 150
#: (digest, vector) of a version.
VERSION = StructType().add("digest", StringType()).add("vector", ArrayType(DoubleType()))
#: Takes a list of texts, gives a vector of each.
Embedder = Callable[[list[str]], list[list[float]]]


def _computer(embedder: Callable[[], Embedder], batch: int):
    """(digest, vector, error) of (digest, text); where a batch fails, each of its texts is asked alone."""

    def run(batches):
        model = embedder()

        def vectors(texts):
            try:
                return [(v, None) for _, v in zip(texts, model(texts), strict=True)]
            except Exception as e:  # noqa: BLE001  a model may fail in any way
                if len(texts) == 1:
                    return [(None, str(e) or type(e).__name__)]
                return [vectors([t])[0] for t in texts]

        for frame in batches:
            for a in range(0, frame.num_rows, batch):
                part = frame.slice(a, batch)
                done = vectors(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v for v, _ in done], pa.list_(pa.float64())), pa.array([e for _, e in done], pa.string())], names=["digest", "vector", "error"])

    return run


@dataclass
class Embedded:
    """``rows`` with ``vector`` and ``error``; how many distinct texts were computed, and failed."""

    rows: DataFrame
    computed: int
    failed: int


class EmbeddingCache:
    """The cache of one model in a folder; another model has another one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        ship(spark)

    def versions(self) -> list[str]:
        """Folders of the whole versions, in order of their names."""
        return [f"{self.path}/{x}" for x in children(self.spark, self.path) if x.startswith("v") and exists(self.spark, f"{self.path}/{x}/_SUCCESS")]

    def known(self) -> DataFrame:
        """(digest, vector), each digest once."""
        found = self.versions()
        rows = self.spark.read.schema(VERSION).parquet(*found) if found else self.spark.createDataFrame([], VERSION)
        return rows if len(found) < 2 else rows.groupBy("digest").agg(F.min("vector").alias("vector"))  # two runs at once may have computed the same text

    def embed(self, rows: DataFrame, text: str, embedder: Callable[[], Embedder], batch: int = BATCH) -> Embedded:
        """The rows with ``vector`` and ``error``, names of their own; what was computed is kept.

        Null texts have neither; an empty text is a text. A text that the model
        fails on has the error and isn't kept, so the next run tries it again. Texts that repeat,
        a third of all rows even, are one row of the look-up, and the join to
        them is on the digest, which Spark splits where it is hot.
        """
        digest = F.sha2(F.col(text).cast("binary"), 256)
        marked = rows.withColumn("__digest", digest)
        wanted = marked.where(F.col(text).isNotNull()).groupBy(F.col("__digest").alias("digest")).agg(F.first(text).alias("text"))
        missing = publish(wanted.join(self.known().select("digest"), "digest", "left_anti"), "missing-texts")
        schema = StructType([*VERSION.fields]).add("error", StringType())
        fresh = publish(missing.select("digest", "text").mapInArrow(_computer(embedder, batch), schema), "new-vectors")
        computed, failed = fresh.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
        if computed:
            path = fresh_path(self.spark, "version")
            fresh.where("error IS NULL").select("digest", "vector").write.parquet(path)
            number = 1 + max((int(x.rsplit("/v", 1)[1].split("-")[0]) for x in self.versions()), default=0)
            move(self.spark, path, f"{self.path}/v{number:08d}-{uuid.uuid4().hex[:8]}")
        found = self.known().withColumn("error", F.lit(None).cast("string"))
        if failed:
            found = found.unionByName(fresh.where("error IS NOT NULL"))
        discard(missing)
        out = marked.join(found.withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")
        return Embedded(out, computed, failed)

    def compact(self) -> None:
        """Merges all versions into one; readers of the old ones must have ended."""
        before = self.versions()
        if len(before) < 2:
            return
        path = fresh_path(self.spark, "version")
        self.known().write.parquet(path)
        number = 1 + max(int(x.rsplit("/v", 1)[1].split("-")[0]) for x in before)
        move(self.spark, path, f"{self.path}/v{number:08d}-{uuid.uuid4().hex[:8]}")
        for old in before:
            remove(self.spark, old)
