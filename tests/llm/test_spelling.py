import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, factor=5):
    found, forms = {w: [v for v in n if near(w, v)] for w in n}, {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n[w], len(found[w]), n[forms[w]] if forms[w] else None))
    return out


def vocabulary(seed, size, letters):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 16))) for _ in range(size // 4)}
    words |= {"aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaa", "aaaaaab", "abababab", "babababa", "ababababa"}
    while len(words) < size:
        w = rng.choice(sorted(words))
        i = rng.randrange(len(w))
        v = rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]))
        if len(v) >= 6:
            words.add(v)
    return {w: 5 ** rng.randrange(6) + rng.randrange(3) for w in words}


@pytest.mark.parametrize("seed,letters,part", [(1, "abé", 1024), (2, "ab", 16), (3, "abcdefgh", 8), (4, "aé", 4)])
def test_against_brute_force(spark, monkeypatch, seed, letters, part):
    monkeypatch.setattr(spelling, "PART", part)
    n = vocabulary(seed, 700, letters)
    df = spark.createDataFrame([(w, k, "x") for w, k in n.items()], "word string, n long, form string").repartition(5)
    assert {tuple(r) for r in spelling.variants(df).collect()} == brute(n)


def test_long_words_and_odd_rows(spark):
    long = "ab" * 400
    rows = [(long, 50), (long + "c", 10), ("c" + long, 2), (None, 9), ("short", 9), ("", 1), ("twice1", 2), ("twice1", 3), ("twice2", 1), ("unseen", 0)]
    got = {r.word: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {
        long: (None, long, 50, 2, None), long + "c": (long, long, 10, 1, 50), "c" + long: (long, long, 2, 1, 50),
        "twice1": (None, "twice1", 5, 1, None), "twice2": ("twice1", "twice1", 1, 1, 5),
    }
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(rows, "word string, n long"), factor=1)


def test_forms_follow_to_the_last(spark):
    chain = [("aaaaaa" + "b" * i, 6**i) for i in range(12)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got["aaaaaa"] == ("aaaaaab", chain[-1][0]) and {root for _, root in got.values()} == {chain[-1][0]}


def test_runs(spark):
    docs = spark.createDataFrame([(1, "Ünder-ÀB2cd x÷y ŁŁ Straße " + "z" * 100_000), (2, None), (None, "")], "doc_id long, text string")
    assert [r.run for r in spelling.lower_runs(docs).collect()] == ["Ünder", "Àb", "cd", "x÷y", "straße", "z" * 100_000]
    counted = spelling.word_counts(spelling.lower_runs(spark.createDataFrame([(i, "Answer answeR other") for i in range(5)], "doc_id long, text string")), "run")
    assert [tuple(r) for r in counted.collect()] == [("answer", 10)]
    drawn = spark.createDataFrame([(0,)], "i int").select(spelling._drawn_deletion(F.lit(6), F.lit("answer")).alias("w"))
    assert drawn.first().w in {"answer", *("answer"[:i] + "answer"[i + 1 :] for i in range(6))}
