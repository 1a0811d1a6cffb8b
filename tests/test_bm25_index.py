"""The block-max index against plain scoring of all chunks."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import bm25_index, retrieval
from corvane.operators.bm25_index import Bm25Index
from corvane.runtime import fresh_path


def corpus(seed, size, topics=6):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        topic = rng.randrange(topics)
        rows.append((i, [f"t{topic}w{int(rng.expovariate(0.2))}" if rng.random() < 0.7 else f"c{int(rng.expovariate(0.3))}" for _ in range(rng.randrange(0, 40))]))
    return rows


def plain(chunks, queries, k):
    return sorted(tuple(r) for r in retrieval.top_per_query(retrieval.bm25(chunks, F.col("terms"), queries, "id", "q"), "q", "id", k).select("q", "rank", "id", F.round("score", 5)).collect())


def found(search):
    return sorted(tuple(r) for r in search.rows.select("q", "rank", "key", F.round("score", 5)).collect())


@pytest.mark.parametrize("seed,turn,first", [(1, 500_000, 1), (2, 20, 2), (3, 500_000, 100)])
def test_as_scoring_all_chunks(spark, monkeypatch, seed, turn, first):
    monkeypatch.setattr(bm25_index, "RANGE", 8)
    monkeypatch.setattr(bm25_index, "TURN", turn)
    rows = corpus(seed, 300)
    chunks = spark.createDataFrame(rows, "id long, terms array<string>").repartition(3)
    rng = random.Random(seed)
    asked = [(f"q{i}", t) for i in range(12) for t in (rng.choice(rows)[1][:9] + ["unknown"])] + [("none", "unknown")]
    queries = spark.createDataFrame(asked, "q string, term string")
    index = Bm25Index.build(chunks, F.col("terms"), "id", fresh_path(spark, "test-index"))
    search = index.top(queries, "q", 4, first)
    assert found(search) == plain(chunks, queries, 4)
    assert 0 < search.share() <= 1


def test_blocks_are_spared(spark, monkeypatch):
    """Chunks of twelve topics: a query on one reads few of the blocks that share a common term."""
    monkeypatch.setattr(bm25_index, "RANGE", 8)
    rng = random.Random(5)
    rows = [(i, [f"t{i % 12}"] * 3 + ["common"] + [f"x{i}"] * rng.randrange(4)) for i in range(1200)]
    chunks = spark.createDataFrame(rows, "id long, terms array<string>")
    queries = spark.createDataFrame([("a", "t3"), ("a", "common"), ("a", "x15")], "q string, term string")
    search = Bm25Index.build(chunks, F.col("terms"), "id", fresh_path(spark, "test-index")).top(queries, "q", 5)
    assert found(search) == plain(chunks, queries, 5)
    assert search.share() < 0.3


def test_kept_and_opened_again(spark):
    chunks = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("b", ["z", None]), ("c", None), ("d", [])], "id string, terms array<string>")
    path = fresh_path(spark, "test-index")
    assert Bm25Index.at(spark, path) is None
    Bm25Index.build(chunks, F.col("terms"), "id", path)
    again = Bm25Index.build(chunks.limit(0), F.col("terms"), "id", path)  # what is there stays
    queries = spark.createDataFrame([(1, "y"), (1, None), (2, "z"), (None, "x")], "q int, term string")
    for index in (again, Bm25Index.at(spark, path)):
        assert {(r.q, r.key) for r in index.top(queries, "q", 5).rows.collect()} == {(1, "a"), (2, "b"), (None, "a"), (None, "b")}
    assert index.top(queries.limit(0), "q", 5).rows.count() == 0


def test_empty_corpus(spark):
    chunks = spark.createDataFrame([], "id long, terms array<string>")
    index = Bm25Index.build(chunks, F.col("terms"), "id", fresh_path(spark, "test-index"))
    search = index.top(spark.createDataFrame([(1, "x")], "q int, term string"), "q", 3)
    assert search.rows.count() == 0 and search.share() == 0.0


def test_tasks_count_terms_without_lists_of_strings(spark):
    """Terms reach tasks as one string a chunk; null terms count for the size alone, and a term with the separator is refused."""
    schema = "id long, terms array<string>"
    chunks = spark.createDataFrame([(1, ["x", "x", None, "", "y"]), (2, [None]), (3, [""]), (4, None)], schema)
    index = Bm25Index.build(chunks, F.col("terms"), "id", fresh_path(spark, "test-index"))
    assert [sorted(r.sizes) for r in index.sizes.collect()] == [[0, 1, 1, 5]]
    held = {r.term: sorted(p // bm25_index.RANGE for p in r.posts) for r in index.blocks.where("term IS NOT NULL").collect()}
    assert held == {"x": [2], "y": [1], "": [1, 1]}
    with pytest.raises(Exception, match="U\\+001F"):
        Bm25Index.build(spark.createDataFrame([(1, ["a\x1fb"])], schema), F.col("terms"), "id", fresh_path(spark, "test-index"))


def test_chosen_chunks_are_cut_without_a_shuffle_of_texts(spark):
    from corvane.plans import chunks as plans
    from corvane.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    top = spark.createDataFrame([(r.doc_id * 100_000, 7) for r in t.documents.orderBy("doc_id").limit(3).collect()], "id long, item_id long")
    got = plans._chunks_of(t, top)
    assert "hashpartitioning(doc_id" not in got.select("id", "chunk")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert {r.id for r in got.collect()} == {r.id for r in top.collect()}
