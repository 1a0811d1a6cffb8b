import numpy as np
import pytest

from corvane.llm import mixing


def example(seed, sparse=False):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 1000, 60).astype(float) ** (2 if sparse else 1)
    codes = [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    totals = [np.bincount(c, tokens) for c in codes]
    targets = [rng.random(n) + 1 for n in (5, 4, 3)]
    return tokens, codes, totals, [t / t.sum() for t in targets]


@pytest.mark.parametrize("seed,budget", [(0, 0.1), (1, 0.3), (2, 0.5), (3, 0.6), (4, 0.9), (5, 1.0)])
def test_raking_meets_the_marginals_though_cells_are_bounded(seed, budget):
    tokens, codes, totals, targets = example(seed)
    aims = [mixing.goals(total, target, budget) for total, target in zip(totals, targets)]
    for total, target, aim in zip(totals, targets, aims):
        assert aim.sum() == pytest.approx(budget * tokens.sum()) and (aim <= total * (1 + 1e-9)).all()
        free = aim < total * (1 - 1e-9)
        assert not free.any() or np.ptp((aim / target)[free]) < 1e-6 * tokens.sum()
    kept = np.minimum(tokens, mixing.rake(tokens, codes, aims, budget, cycles=80))
    assert (kept <= tokens).all() and (kept >= 0).all()
    if budget < 0.9:
        for code, aim in zip(codes, aims):
            assert np.bincount(code, kept) == pytest.approx(aim, rel=1e-3)
    if budget == 0.5:
        assert (kept == tokens).any()  # saturated cells


def test_a_table_of_cells_is_raked_alike(spark, monkeypatch):
    rows = [(i, "word " * (1 + i * 7 % 50), f"s{i % 5 * (i % 3)}", f"l{i % 4}") for i in range(300)] + [(900, "a@b | c", "s1", "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    want = {tuple(r[:3]): r.cv_probability for r in mixing.Mixture(df).probabilities().collect()}
    report = {(r.dimension, r.value): r for r in mixing.Mixture(df).report().collect()}
    for dimension in mixing.DIMENSIONS:
        values = [r for (d, _), r in report.items() if d == dimension]
        for column in ("target", "feasible", "reached"):
            assert sum(r[column] for r in values) == pytest.approx(1)
        assert all(r.reached == pytest.approx(r.feasible, abs=1e-3) for r in values)
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    monkeypatch.setattr(mixing, "CYCLES", 3)
    got = {tuple(r[:3]): r.cv_probability for r in mixing.Mixture(df).probabilities().collect()}
    monkeypatch.undo()
    monkeypatch.setattr(mixing, "CYCLES", 3)
    cells = mixing.Mixture(df)
    monkeypatch.setattr(mixing.rake, "__defaults__", (mixing.BUDGET, 3))
    want = {tuple(r[:3]): r.cv_probability for r in cells.probabilities().collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_sampled_shares_follow_the_targets(spark):
    rows = [(i, "word " * 20, ("a", "b", None)[i % 3] if i % 5 else "a", ("x", None)[i % 2], "c") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, cv_tokens string")
    even = lambda dimension, totals: {k: 1 / len(totals) for k in totals}
    got = mixing.mix(df, targets=even, budget=0.3)
    kept = got.where("cv_sampled").groupBy("cv_source").sum("cv_tokens").collect()
    assert {r[0] for r in kept} == {"a", "b", "(none)"}
    shares = [r[1] / sum(x[1] for x in kept) for r in kept]
    assert max(abs(s - 1 / 3) for s in shares) < 0.04
    assert got.where("cv_sampled").count() == pytest.approx(1200, rel=0.1)


def test_nulls_empty_texts_and_empty_tables(spark):
    rows = [(1, None, None, None), (2, "", "a", "x"), (None, "b c | d", "a", "x"), (4, "Licensed under X", "a", "x"), (4, "Licensed under X", "a", "x"), (5, "me@example.com " + "y" * 300_000, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(df, budget=1.0).collect()
    assert sorted((str(r.doc_id), r.cv_topic, r.cv_tokens, r.cv_sampled) for r in got) == sorted([("1", "prose", 0, False), ("2", "prose", 0, False), ("None", "table", 4, True), ("4", "legal", 3, True), ("4", "legal", 3, True), ("5", "contact", 2, True)])
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.where("doc_id < 3")).where("cv_sampled").count() == 0


def test_rows_without_an_id_draw_by_their_texts(spark):
    df = spark.createDataFrame([(None, f"word {i}", "a", "x") for i in range(400)], "doc_id long, text string, source string, lang string")
    assert 150 < mixing.mix(df).where("cv_sampled").count() < 250
