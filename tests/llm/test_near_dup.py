import random
import re

import pytest

from corvane.llm import near_dup


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Groups at and around the threshold, chains of edits, shared passages, copies, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7))}" if rng.random() < 0.5 else f"v{rng.randrange(4000)}"
    passage, out = [word() for _ in range(60)], []
    for _ in range(4):
        base = [word() for _ in range(rng.choice((30, 120, 260)))]
        group = [base, base] + [edited(rng, base, rng.randrange(1, 12)) for _ in range(14)]
        chain = base
        for _ in range(4):
            chain = edited(rng, chain, 3)
            group.append(chain)
        out += group
    out += [[word() for _ in range(rng.randrange(5, 80))] + passage for _ in range(25)]
    out += [[word() for _ in range(n)] for n in (0, 1, 2, 3, 4, 5)] * 2 + [["same"], ["SAME"], [], ["x"] * 50, ["x"] * 60]
    rng.shuffle(out)
    return [(i * 3, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed,size,small", [(1, 4, False), (2, 5, False), (3, 4, True)])
def test_all_links_against_brute_force(spark, monkeypatch, seed, size, small):
    if small:  # the paths of long lists and large families
        for name, value in (("SHORT_LIST", 3), ("BLOCK", 4), ("CHUNK", 5), ("BROADCAST_TEXTS", 0), ("SALTS", 3), ("WIDTH", 50), ("VALUES", 500)):
            monkeypatch.setattr(near_dup, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame([(t, "x", d) for d, t in rows], "text string, cls string, doc_id long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, words=size).collect()}
    assert got == brute(rows, size)


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(7, text, 1), (7, text, 2), (3, text + " more", 3), (None, None, 4), (None, text, 5), (9, None, 6), (10, "", 7), (11, " \t", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    want = [(7, 26, 3, False)] * 2 + [(3, 27, 3, True), (None, 0, None, True), (None, 26, 3, False), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True)]
    assert got == sorted(want, key=str)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"z{i % 5000}" for i in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "b" * 300_000)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def odd_ids(seed):
    """Texts of ``corpus`` whose ids repeat or are null, with repeated rows."""
    rng = random.Random(seed)
    rows = [(rng.choice((None, 1, 2, d)), t, rng.randrange(3)) for d, t in corpus(seed)]
    return rows + rng.sample(rows, 30)


@pytest.mark.parametrize("seed,bound", [(4, 200_000), (5, 0)])
def test_one_row_of_each_group_stays_whatever_ids_repeat(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(near_dup, "BROADCAST_TEXTS", bound)
    rows = odd_ids(seed)
    groups = {i: g for i, (_, g) in brute([(i, t) for i, (_, t, _) in enumerate(rows)], 5).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, cls int").repartition(3)
    kept = [(r.doc_id, r.text) for r in near_dup.keep_one(df).collect()]
    members, of_text = {}, {}
    for i, (d, t, _) in enumerate(rows):
        members.setdefault(groups[i], []).append((d, t))
        of_text[t] = groups[i]
    wordless = [x for x in rows if not shingles(x[1], 5)]
    assert sum(not shingles(t, 5) for _, t in kept) == len(wordless)
    with_words = [(d, t) for d, t in kept if shingles(t, 5)]
    want = {g for g, m in members.items() if shingles(m[0][1], 5)}
    assert sorted(of_text[t] for _, t in with_words) == sorted(want)
    for d, t in with_words:
        ids = [x for x, _ in members[of_text[t]] if x is not None]
        assert d == (min(ids) if ids else None)


def test_an_id_shared_by_texts_of_two_groups(spark):
    text, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(3, text), (5, text + "z"), (5, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in near_dup.keep_one(df).collect()) == [(3, text), (5, other)]


def test_texts_of_null_ids_meet_only_their_own_class(spark, monkeypatch):
    """Rows that the comparison reads grow with the wanted texts, not with their square."""
    read = []
    texts = [" ".join(f"t{i}x{j}" for j in range(60)) + f" end{k}" for i in range(100) for k in range(2)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    original = near_dup.store.publish

    def watched(frame, name):
        out = original(frame, name)
        if name == "wanted":
            plain = near_dup._plain(df, "text", "doc_id")
            read.append((out.count(), plain.join(out, plain["doc"].eqNullSafe(out["doc"]) & (plain["mark"] == out["mark"])).count()))
        return out

    monkeypatch.setattr(near_dup.store, "publish", watched)
    assert near_dup.keep_one(df).count() == 100
    assert read and all(wanted == joined for wanted, joined in read)
