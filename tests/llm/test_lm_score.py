import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import lm_score

TEXTS = [(1, "The cat sat on the mat"), (2, "the dog sat on THE log"), (3, None), (4, ""), (5, "a cat and a dog"), (5, "a cat and a dog"), (None, "cat cat cat\tcat"), (6, "é ß the " * 400)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


@pytest.mark.parametrize("top,head", [(256, 1 << 20), (4, 1 << 20), (4, 3), (3, 0)])
def test_base_scores_against_brute_force(spark, top, head):
    df = spark.createDataFrame([(d, t, -1.0) for d, t in TEXTS], "doc_id long, text string, score double")
    training = df.where("doc_id IS NULL OR doc_id <> 2")
    counts, vocab, model = lm_score.fit(training, top=top, head_words=head)
    count = Counter(x for d, t in TEXTS if d != 2 for x in tokens(t))
    total, distinct = sum(count.values()), len(count)
    assert (vocab.total, vocab.distinct) == (total, distinct)
    got = lm_score.score_texts(df, counts, vocab, model).collect()
    assert len(got) == len(TEXTS)
    assert got[0].__fields__ == ["doc_id", "text", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for r in got:
        want = tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(want), sum(count[x] > 0 for x in want), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in want))
        assert math.isfinite(r.score) and r.score < 0


@pytest.mark.parametrize("top,head", [(3, 1 << 20), (3, 5), (256, 1 << 20), (3, 0)])
def test_probabilities_of_all_events_sum_to_one(spark, top, head):
    words = [f"word{i}" for i in range(9)]
    df = spark.createDataFrame([(i, " ".join(words[j % 9] for j in range(i, 2 * i + 2))) for i in range(12)], "doc_id long, text string")
    counts, vocab, model = lm_score.fit(df, top=top, head_words=head)
    scorer = lm_score.Scorer(vocab, model)

    class All:  # every event after the same two words
        event = np.arange(vocab.n_head + lm_score.SUFFIXES)

    rng = np.random.default_rng(3)
    r = np.tile(rng.standard_normal(lm_score.DIMENSION).astype(np.float32), (len(All.event), 1))
    assert np.exp(scorer.log_event(r, All.event)).sum() == pytest.approx(1, rel=1e-4)
    # Inside the event of a suffix: c + 1 of each rare word and 1 for unknown ones, over their sum.
    rare = {x.h: x.c for x in counts.collect()}
    for h in vocab.hashes.view(np.int64).tolist():
        del rare[h]
    assert vocab.suffix_weight.sum() == sum(c + 1 for c in rare.values()) + lm_score.SUFFIXES


def test_a_score_is_the_sum_of_its_tokens(spark):
    """Scores of all prefixes by hand: class and member probabilities of each token, from plain loops."""
    df = spark.createDataFrame([(i, " ".join(f"k{(i + j) % 40}" for j in range(90))) for i in range(30)], "doc_id long, text string")
    counts, vocab, model = lm_score.fit(df, top=8)
    text = "k1 k2 k3 nothing k4 k5"
    got = lm_score.score_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"), counts, vocab, model).first().score
    place = {int(h): i for i, h in enumerate(vocab.hashes)}
    vectors, want = [], 0.0
    for w in tokens(text):
        h = lm_score.END if w is None else lm_score.hash_word(w.encode())
        low = np.frombuffer((w or "").encode() + bytes(8), dtype=np.uint8)
        s = lm_score._END_SPELLING if w is None else lm_score.spelling(low, np.array([0]), np.array([len(w)]))[0]
        e = place.get(h, vocab.n_head + s[3] - lm_score.TRIGRAMS)
        none = np.zeros(lm_score.DIMENSION)
        past = vectors[::-1]
        r = model.a[0] * (past[0] if past else none) + model.a[1] * (past[1] if len(past) > 1 else none) + model.a[2] * (np.mean(past[: lm_score.WINDOW], axis=0) if past else none)
        logits = model.q @ r + model.b[:, 0]
        want += logits[vocab.cls[e]] - np.log(np.exp(logits).sum())
        if vocab.place[e] >= 0:
            k = vocab.group[vocab.place[e]]
            members = range(vocab.bounds[k], vocab.bounds[k + 1])
            inner = []
            for m in members:
                event = vocab.members[m]
                q = model.t[vocab.spelled[event]].sum(axis=0) + model.eq[vocab.own[event]]
                inner.append(q @ r + vocab.member_log[m] + model.eb[vocab.own[event], 0])
            want += vocab.group_log[k] + inner[vocab.place[e] - vocab.bounds[k]] - np.log(np.exp(inner).sum())
        if h not in place:
            want -= math.log(vocab.suffix_weight[s[3] - lm_score.TRIGRAMS])
        vectors.append(model.u[s].sum(axis=0) + model.eu[vocab.own[e]])
    assert got == pytest.approx(want / math.log(10), rel=1e-4)


@pytest.mark.parametrize("head", [1 << 20, 5, 0])
def test_it_learns_more_than_frequencies(spark, head):
    df = spark.createDataFrame([(i, " ".join(f"k{(i + j) % 40}" for j in range(400))) for i in range(400)], "doc_id long, text string").coalesce(2)
    fitted = lm_score.fit(df.where("doc_id % 5 > 0"), top=16, head_words=head)
    r = lm_score.score_texts(df.where("doc_id % 5 = 0"), *fitted).selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert r.s > 0.8 * r.b  # closer to 0


def test_the_query_gains_on_held_out_texts_however_the_table_is_cut(spark, tmp_path):
    """Over the query itself: contract columns by brute force, and the held-out gain over base per token from 1 and from 32 partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    total, distinct = sum(count.values()), len(count)
    gains = []
    for n in (1, 32):
        docs.repartition(n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = {r.doc_id: r for r in lm_score.query(spark, f"{tmp_path}/{n}").collect()}
        assert len(got) == len(rows)
        for d, t in rows:
            r, want = got[d], tokens(t)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(want), sum(count[x] > 0 for x in want), total)
            assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in want))
        out = [r for r in got.values() if r.held_out]
        gains.append(sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out))
    assert min(gains) > 0.2 and max(gains) < 1.1 * min(gains)


def test_averaged_tasks_learn_too(spark, monkeypatch):
    """With 17 training tasks in place of one: the held-out gain over base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(32, "doc_id").cache()
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    gains = []
    for task_tokens in (1_000_000, 20_000):
        monkeypatch.setattr(lm_score, "TASK_TOKENS", task_tokens)
        scored = lm_score.score_texts(docs.where(held), *lm_score.fit(docs.where(~held)))
        r = scored.agg(F.sum("n_tokens"), F.sum(F.col("score") - F.col("base_score"))).first()
        gains.append(r[1] / r[0])
    print("gain of 1 and of 17 tasks", gains)
    assert gains[1] > 0.5 * gains[0] > 0.1


def _fastest(f, times=40):
    took = []
    for _ in range(times):
        start = time.perf_counter()
        f()
        took.append(time.perf_counter() - start)
    return min(took)


def test_rows_are_taken_in_less_time_than_by_an_index():
    """A mini-batch's vectors and the sums of its gradients: the values of plain indexing, and the vectors in less time."""
    rng = np.random.default_rng(5)
    table, own = (rng.standard_normal((n, lm_score.DIMENSION)).astype(np.float32) for n in (lm_score.TRIGRAMS, 10_000))
    spelled, rows = rng.integers(0, len(table), (lm_score.BATCH, 4)).astype(np.uint16), rng.integers(0, len(own), lm_score.BATCH).astype(np.int32)
    gradient = rng.standard_normal((lm_score.BATCH, lm_score.DIMENSION)).astype(np.float32)

    def composed():
        return own[rows] + table[spelled[:, 0]] + table[spelled[:, 1]] + table[spelled[:, 2]] + table[spelled[:, 3]]

    def sums():
        flat = spelled.ravel()
        by = np.argsort(flat, kind="stable")
        start, _ = lm_score.runs(flat[by])
        return flat[by[start]], np.add.reduceat(gradient[by >> 2], start, axis=0)

    np.testing.assert_allclose(lm_score._composed(table, own, spelled, rows), composed(), rtol=1e-6)
    for got, want in zip(lm_score._row_sums(spelled, gradient, len(table)), sums()):
        np.testing.assert_array_equal(got, want)
    assert _fastest(lambda: lm_score._composed(table, own, spelled, rows)) < 0.7 * _fastest(composed)


def test_normalisers_of_pieces_even_out_of_range():
    rng = np.random.default_rng(7)
    r, q = rng.standard_normal((300, 9)).astype(np.float32), rng.standard_normal((50, 9)).astype(np.float32)
    r[[3, 140, 299]] *= 200  # beyond what exp takes
    r[[7, 150], :] = [0] * 8 + [-300]
    q[:, 8] = 1
    pieces = [(0, 2, 0, 1), (2, 150, 1, 20), (150, 300, 20, 50)]
    got = lm_score._log_sums(r, q, pieces)
    for a, b, c, d in pieces:
        np.testing.assert_allclose(got[a:b], np.logaddexp.reduce(r[a:b].astype(float) @ q[c:d].T.astype(float), axis=1), rtol=1e-4, atol=1e-4)
    assert not len(lm_score._log_sums(r[:0], q, []))


def test_empty_training_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    fitted = lm_score.fit(df.limit(0))
    row = lm_score.score_texts(df, *fitted).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0
    assert lm_score.score_texts(df.limit(0), *fitted).count() == 0
