import random
import re

import pytest

from corvane.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    wins = {}
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(key)
    sizes, out = {len(w) for w in wins}, []
    for key, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((key, len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return out


@pytest.mark.parametrize("block_items", [100_000, 3])
def test_hits_against_brute_force(spark, monkeypatch, block_items):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block_items)
    rng = random.Random(4)
    vocabulary = ["The", "of", "éa", "x1", "w2", "w3", "ß", "zz"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "--"]) for _ in range(n))
    items = [(i, text(rng.randrange(4, 20))) for i in range(8)] + [(20, "w3"), (21, ""), (22, None), (None, text(5)), (5, "repeated id here")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(30)] + [(100 + i, text(20) + " " + (items[i][1] or "").upper() + " " + text(9)) for i in range(8)]
    docs += [(200, None), (201, ""), (202, "-- !"), (203, docs[31][1]), (203, docs[31][1]), (None, "w3 w3"), (300, text(5) + " ab" * 30_000 + " " + items[1][1])]
    df = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, n_hit int").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(df, bench, window=6)
    assert got.columns == ["doc_id", "text", "n_words", "n_hit", "hit_items", "removal_spans"]
    rows = got.collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(r.hit_items)) for r in rows) == sorted((str(d), n, h, i) for d, n, h, i in brute(docs, items, 6))
    cut = {r.doc_id: r.text for r in decontam.remove_spans(got).collect()}
    for r in rows:
        if not r.n_hit:
            assert cut[r.doc_id] == r.text or r.doc_id == 203
        else:
            inside = "".join(r.text[s.start : s.end] for s in r.removal_spans)
            assert len(words(inside)) <= r.n_hit and all(s.start < s.end for s in r.removal_spans)
            assert len(words(" ".join(r.text[s.start : s.end] for s in r.removal_spans))) == r.n_hit


def test_empty_tables_and_clean_texts(spark):
    docs = spark.createDataFrame([(1, "clean words stay as they are"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.hit_items, r.removal_spans) for r in decontam.decontaminate(docs, none).collect()] == [(0, [], [])] * 2
    assert decontam.decontaminate(docs.limit(0), none).count() == 0
    item = spark.createDataFrame([(1, "words stay")], "item_id long, text string")
    assert decontam.remove_spans(decontam.decontaminate(docs, item)).where("doc_id = 1").first().text == "clean  as they are"
