"""State that ends by timers of event time."""

import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.streaming import events as stream, stateful

START = datetime(2024, 1, 1)


def feed(spark, folder, minutes):
    """One more file of (user, minute)."""
    rows = [(u, START + timedelta(minutes=m)) for u, m in minutes]
    spark.createDataFrame(rows, "user int, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_sessions_close_by_timer_and_leave_no_state(spark):
    folder, state = tempfile.mkdtemp() + "/in", tempfile.mkdtemp()
    minutes = lambda ms: int(ms // 60000 - START.timestamp() // 60)

    def step():
        like = spark.read.parquet(folder)
        with stateful.rocksdb(spark):
            got = stream.run_to_table(stateful.closed_sessions(stream.read_stream(spark, folder, like, files=100), "user", 600, "5 minutes"), state, "append")
        return sorted((r.user, minutes(r.first_ms), minutes(r.last_ms), r.n) for r in got.collect())

    def held():
        return {r.user for r in spark.read.format("statestore").option("path", f"{state}/checkpoint").option("stateVarName", "times").load().select("key.user").collect()}

    feed(spark, folder, [(1, 0), (1, 7), (2, 3), (3, 12)])
    assert step() == [] and held() == {1, 2, 3}
    feed(spark, folder, [(1, 9), (3, 18)])  # watermark 13: user 2 ends at 13
    assert (2, 3, 3, 1) in step() and held() <= {1, 3}
    feed(spark, folder, [(3, 31), (1, 27)])  # watermark 26: user 1's first session and user 3's end at 19 and 28
    assert {(1, 0, 9, 3), (2, 3, 3, 1)} <= set(step())
    feed(spark, folder, [(9, 100)])
    assert step() == [(1, 0, 9, 3), (1, 27, 27, 1), (2, 3, 3, 1), (3, 12, 18, 2), (3, 31, 31, 1)]
    assert held() == {9}


def test_keys_share_states_and_give_the_same_sessions(spark):
    """60 keys and null in four states, over batches that reopen and join sessions: as many calls on state as there are buckets, rows by the plain rule."""
    folder, state = tempfile.mkdtemp() + "/in", tempfile.mkdtemp()
    rng, events = np.random.default_rng(4), []
    for batch in range(3):
        fresh = [(None if u == 60 else int(u), batch * 90 + int(m)) for u, m in zip(rng.integers(0, 61, 400), rng.integers(0, 100, 400))]
        events += fresh
        feed(spark, folder, fresh)
        with stateful.rocksdb(spark):
            source = stream.read_stream(spark, folder, spark.read.parquet(folder), files=100)
            got = stream.run_to_table(stateful.closed_sessions(source, "user", 600, "20 minutes", buckets=4), state, "append").collect()
    held = spark.read.format("statestore").option("path", f"{state}/checkpoint").option("stateVarName", "times").load()
    assert 0 < held.count() <= 4
    least = max(m for _, m in events) - 20
    want = []
    for u in {u for u, _ in events}:
        times = stateful.split_sessions([m for x, m in events if x == u], 10)
        want += [(u, x[0], x[-1], len(x)) for x in times if x[-1] + 10 <= least]
    minutes = lambda ms: int(ms // 60000 - START.timestamp() // 60)
    assert got[0].asDict().keys() == {"user", "first_ms", "last_ms", "n", "epoch"}
    assert sorted(((r.user, minutes(r.first_ms), minutes(r.last_ms), r.n) for r in got), key=repr) == sorted(want, key=repr)
    assert any(u is None for u, *_ in want) and len(want) > 100


@pytest.mark.parametrize("cut", [1, 7, 500])
def test_sessions_joined_in_parts_are_those_of_all_events(cut):
    rng = np.random.default_rng(cut)
    events = np.column_stack((rng.integers(0, 5, 500), *[rng.integers(-(2**52), 2**52, 500) // 2**39 * 2**39] * 2, np.ones(500, dtype=np.int64)))
    got = np.empty((0, 4), dtype=np.int64)
    for i in range(0, 500, cut):
        got = stateful.merge_sessions(np.concatenate((events[i : i + cut], got)), 2**43)
    want = [(k, s[0], s[-1], len(s)) for k in range(5) for s in stateful.split_sessions(events[events[:, 0] == k, 1].tolist(), 2**43)]
    assert [tuple(r) for r in got.tolist()] == want and 5 < len(want) < 500


def test_split_sessions():
    assert stateful.split_sessions([5, 1, 20, 11], 6) == [[1, 5], [11], [20]] and stateful.split_sessions([], 6) == []


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_nothing_to_keep(spark, rows):
    folder, state = tempfile.mkdtemp() + "/in", tempfile.mkdtemp()
    spark.createDataFrame(rows, "user int, ts timestamp").write.parquet(folder)
    with stateful.rocksdb(spark):
        got = stream.run_to_table(stateful.closed_sessions(stream.read_stream(spark, folder, spark.read.parquet(folder)), "user", 600, "5 minutes"), state, "append")
    assert got.where(F.col("n") > 0).count() == 0


def test_replaced_versions_of_an_upserted_table_are_deleted(spark):
    root = tempfile.mkdtemp()
    schema = spark.createDataFrame([], "k int, t int").schema
    for t in range(5):
        spark.createDataFrame([(k, t) for k in range(20) if k % 3 == 0 or t < 2], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = stream.read_stream(spark, f"{root}/in", spark.read.schema(schema).parquet(f"{root}/in"))
        stream.upsert_each_batch(source, f"{root}/out", ["k"], [F.desc("t")], f"{root}/cp", parts=16)
    want = {k: 4 if k % 3 == 0 else 1 for k in range(20)}
    held = lambda: {r.k: r.t for r in stream.read_upserted(spark, f"{root}/out", schema).collect()}
    assert held() == want
    gone = stream.vacuum_upserted(spark, f"{root}/out")
    assert gone and held() == want and stream.vacuum_upserted(spark, f"{root}/out") == []
    spark.createDataFrame([(1, 9)], schema).write.mode("append").parquet(f"{root}/in")
    stream.upsert_each_batch(stream.read_stream(spark, f"{root}/in", spark.read.schema(schema).parquet(f"{root}/in")), f"{root}/out", ["k"], [F.desc("t")], f"{root}/cp", parts=16)
    assert held() == {**want, 1: 9}
    with pytest.raises(ValueError):
        stream.vacuum_upserted(spark, f"{root}/out", 1)
    assert stream.vacuum_upserted(spark, f"{root}/none") == []
