"""A killed run goes on with the batches that are missing."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corvane.operators import batched_runs, requests as rq


def asked(folder):
    out = sorted(x.strip() for name in os.listdir(folder) if name.startswith("log") for x in open(f"{folder}/{name}"))
    for name in os.listdir(folder):
        if name.startswith("log"):
            os.remove(f"{folder}/{name}")
    return out


def test_goes_on_with_missing_batches(spark):
    class Failing:
        """Logs what it is asked, and dies on one batch while a file is there."""

        def __init__(self, folder):
            self.folder = folder

        async def complete(self, chat):
            text = chat[-1]["content"]
            with open(f"{self.folder}/log-{os.getpid()}", "a") as f:
                print(text, file=f)
            if text.startswith("b3") and os.path.exists(f"{self.folder}/kill"):
                os._exit(1)
            return f"reply to {text}"

    folder, path = tempfile.mkdtemp(), tempfile.mkdtemp() + "/out"
    rows = spark.createDataFrame([(f"b{b}", i, [("user", f"b{b} {i}")]) for b in range(6) for i in range(3)] + [(None, 9, [("user", "none")])], "batch string, i int, chat array<struct<role: string, content: string>>").coalesce(2)
    make = lambda part: rq.ask(part, lambda: Failing(folder)).select("batch", "i", F.col("reply.content").alias("text"))
    open(f"{folder}/kill", "w").close()
    with pytest.raises(Exception):  # noqa: B017  the worker dies
        batched_runs.run(rows, "batch", make, path, together=2)
    assert sorted(r.batch for r in batched_runs.finished(spark, path).collect()) == ["b0", "b1"]
    assert batched_runs.results(spark, path, "batch").count() == 6
    asked(folder)
    os.remove(f"{folder}/kill")
    assert batched_runs.run(rows, "batch", make, path, together=2) == 4
    assert asked(folder) == sorted(f"b{b} {i}" for b in range(2, 6) for i in range(3))
    got = {(r.batch, r.i): r.text for r in batched_runs.results(spark, path, "batch").collect()}
    assert got == {(f"b{b}", i): f"reply to b{b} {i}" for b in range(6) for i in range(3)}
    assert batched_runs.run(rows, "batch", make, path) == 0 and asked(folder) == []
