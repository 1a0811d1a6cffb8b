"""The shard catalogue as a source of batches and streams."""

import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.sources import shards
from corvane.streaming import events as stream


@pytest.fixture
def folder():
    root = tempfile.mkdtemp()

    def put(version, name, ids, **columns):
        path = f"{root}/v{version}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "text": [f"t{i}" for i in ids], **columns}), path)

    put(2, "data/a.parquet", range(10))
    put(2, "data/b.parquet", range(10, 30), more=["x"] * 20)
    put(10, "data/a.parquet", range(5))
    put(10, "data/c.parquet", range(5, 20_000))
    put(10, "_hidden/d.parquet", [99])
    with open(f"{root}/v10/data/b.parquet", "wb") as f:
        f.write(b"PAR1 broken")
    open(f"{root}/v10/data/empty.parquet", "w").close()
    with open(f"{root}/v10/readme.txt", "w") as f:
        f.write("x")
    return root, put


def load(spark, root, **options):
    shards.register(spark)
    return spark.read.format("corvane_shards").options(path=root, **options).load()


def test_versions_and_unreadable_shards(spark, folder):
    root, _ = folder
    df = load(spark, root)
    assert df.columns == ["id", "text", "shard", "version", "error"] and df.rdd.getNumPartitions() == 3
    assert df.where("error IS NULL").agg(F.count("*"), F.sum("id"), F.max("version")).first() == (20_000, sum(range(20_000)), 10)
    bad = df.where("error IS NOT NULL").collect()
    assert [(r.shard, r.id, r.text) for r in bad] == [("data/b.parquet", None, None)] and "Arrow" in bad[0].error
    assert load(spark, root, unreadable="skip").count() == 20_000
    with pytest.raises(Exception, match="Arrow"):
        load(spark, root, unreadable="fail").count()
    assert load(spark, root, version="2").count() == 30
    assert load(spark, root, version="all", unreadable="skip").groupBy("version").count().orderBy("version").collect() == [(2, 30), (10, 20_000)]
    with pytest.raises(Exception, match="no readable shard"):
        load(spark, root, version="7").count()
    given = spark.read.format("corvane_shards").schema("id int, more string, version int").options(path=f"file://{root}", version="2").load()
    assert given.agg(F.sum("id"), F.count("more"), F.min("version")).first() == (sum(range(30)), 20, 2)


def test_filters_spare_shards(spark, folder):
    root, _ = folder
    df = load(spark, root, version="all")
    assert df.where("shard = 'data/a.parquet' AND version = 2 AND id > 3").count() == 6
    assert df.where("shard = 'data/a.parquet'").rdd.getNumPartitions() == 2
    assert df.where("version IN (2, 3)").count() == 30


def test_a_stream_reads_each_shard_once(spark, folder):
    root, put = folder
    state = tempfile.mkdtemp()
    shards.register(spark)

    def step():
        source = spark.readStream.format("corvane_shards").options(path=root).load()
        return stream.run_to_table(source, state, "append").groupBy("version").agg(F.count("id").alias("n")).orderBy("version").collect()

    assert step() == [(2, 30), (10, 20_000)]
    assert step() == [(2, 30), (10, 20_000)]
    put(11, "data/a.parquet", range(7))
    assert step() == [(2, 30), (10, 20_000), (11, 7)]


def test_shards_are_bounded(spark):
    """A table of any size is written and read in shards of at most so many rows, none through a shuffle to a fixed number."""
    root = tempfile.mkdtemp()
    shards.write_version(spark.range(95, numPartitions=1), root, 3, rows=10)
    rows = load(spark, root)
    assert rows.rdd.getNumPartitions() == 10
    sizes = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert max(sizes) == 10 and sum(sizes) == 95
