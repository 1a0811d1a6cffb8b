"""Exact percentiles against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import percentiles

SHARES = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]


def groups(rng):
    return {
        "even": [rng.random() for _ in range(6000)], "ties": [float(rng.randrange(3)) for _ in range(3000)], "one": [7.0], "two": [1.0, 2.0], None: [float(i * i) for i in range(900)],
        "far": [rng.choice((1e-9, 1e300, -1e300, 0.0)) for _ in range(500)], "same": [5.0] * 800, "nothing": [None, float("nan")],
    }


@pytest.mark.parametrize("sent", [100_000, 0])
def test_percentiles_of_groups(spark, monkeypatch, sent):
    monkeypatch.setattr(percentiles, "SENT_GROUPS", sent)
    held = groups(random.Random(1))
    df = spark.createDataFrame([(g, v) for g, vs in held.items() for v in vs], "g string, v double").repartition(6)
    got = {r.g: (r.n, r.percentiles) for r in percentiles.exact_percentiles(df, ["g"], "v", SHARES, accuracy=50).collect()}
    assert set(got) == set(held) - {"nothing"}
    for g, (n, found) in got.items():
        assert n == len(held[g]) and np.allclose(found, np.quantile(held[g], SHARES), rtol=1e-12, atol=0)


def test_whole_tables_empty_ones_and_wrong_shares(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    row = percentiles.exact_percentiles(df, [], "v", [0.5, 0.333]).first()
    assert row.n == 1001 and row.percentiles == pytest.approx([500.0, 333.0])
    assert percentiles.exact_percentiles(df.limit(0).withColumn("g", F.lit(1)), ["g"], "v", [0.5]).count() == 0
    for wrong in ([], [-0.1], [1.1]):
        with pytest.raises(ValueError):
            percentiles.exact_percentiles(df, [], "v", wrong)
