"""What a cache computes, keeps and looks up."""

import os
import tempfile

from corvane.operators.embedding_cache import EmbeddingCache
from corvane.runtime import fresh_path


def counting(folder):
    """An embedder that logs its batches."""

    def embedder():
        def model(texts):
            with open(f"{folder}/{os.getpid()}", "a") as f:
                for t in texts:
                    print(len(texts), t, file=f)
            if any(t.startswith("bad") for t in texts):
                raise RuntimeError("bad text")
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return embedder


def asked(folder):
    out = [line.rstrip("\n").split(" ", 1) for name in os.listdir(folder) for line in open(f"{folder}/{name}")]
    for name in os.listdir(folder):
        os.remove(f"{folder}/{name}")
    return [(int(n), t) for n, t in out]


def test_each_text_is_computed_once_for_all_runs(spark):
    folder, path = tempfile.mkdtemp(), fresh_path(spark, "cache")
    texts = [f"text {i % 40}" for i in range(400)] + [None, ""] + ["text 1"] * 300
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(texts)], "id int, text string, digest string").repartition(4)
    first = EmbeddingCache(spark, path).embed(df, "text", counting(folder), batch=7)
    done = asked(folder)
    assert (first.computed, first.failed) == (41, 0) and sorted(t for _, t in done) == sorted({t for t in texts if t is not None}) and max(n for n, _ in done) <= 7
    got = first.rows.collect()
    assert len(got) == len(texts) and all(r.vector == (None if r.text is None else [float(len(r.text)), 1.0]) and r.error is None and r.digest == "v" for r in got)

    again = EmbeddingCache(spark, path).embed(df, "text", counting(folder))
    assert again.computed == 0 and asked(folder) == [] and sorted(r.id for r in again.rows.collect()) == sorted(r.id for r in got)

    changed = spark.createDataFrame([(0, "text 0, changed"), (1, "text 1")], "id int, text string")
    third = EmbeddingCache(spark, path).embed(changed, "text", counting(folder))
    assert third.computed == 1 and asked(folder) == [(1, "text 0, changed")]
    cache = EmbeddingCache(spark, path)
    assert len(cache.versions()) == 2 and cache.known().count() == 42
    cache.compact()
    assert len(cache.versions()) == 1 and cache.known().count() == 42


def test_a_failing_text_is_an_error_and_tried_again(spark):
    folder, path = tempfile.mkdtemp(), fresh_path(spark, "cache")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["good 1", "bad", "good 2"])], "id int, text string").coalesce(1)
    for computed in (2, 0):
        done = EmbeddingCache(spark, path).embed(df, "text", counting(folder))
        assert (done.computed, done.failed) == (computed, 1)
        assert {(r.text, r.vector is None, r.error) for r in done.rows.collect()} == {("good 1", False, None), ("bad", True, "bad text"), ("good 2", False, None)}
    empty = EmbeddingCache(spark, fresh_path(spark, "cache")).embed(df.limit(0), "text", counting(folder))
    assert (empty.computed, empty.rows.count()) == (0, 0)
