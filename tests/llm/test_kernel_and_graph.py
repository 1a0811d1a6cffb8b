import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from corvane.llm.fm_index import FMIndex, suffix_array
from corvane.llm.graph import components
from corvane.llm.kernel import ALNUM_WORDS, BLANK_WORDS, blocks, hash_word
from corvane.llm.near_dup import shingle_sets


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB éß \t\n-0_z", max_size=40)), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    for inside, pattern in ((BLANK_WORDS, r"[^\x20\x09-\x0D]+"), (ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        found = []
        for a, b, words in blocks(pa.array(texts, pa.string()), inside, block_bytes=16):
            for i in range(b - a):
                found.append([words.word(j).decode() for j in range(words.first[i], words.first[i + 1])])
                assert [hash_word(w.encode()) for w in found[-1]] == words.hash[words.first[i] : words.first[i + 1]].tolist()
        assert found == [re.findall(pattern, lower(t or "")) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=30), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6))
def test_fm_index_counts_and_locates(runs, phrases):
    symbols = np.array([x for r in runs for x in [*r, 0]], dtype=np.int64)
    order = suffix_array(symbols, 3)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    if not symbols.any():
        return
    index = FMIndex(symbols, 4)
    for phrase in phrases:
        which, low, high = index.search(np.array([phrase], dtype=np.int64))
        _, found = index.locate(low, high)
        k = len(phrase)
        assert sorted(found.tolist()) == [i for i in range(len(symbols) - k + 1) if symbols[i : i + k].tolist() == phrase]


def test_suffix_array_of_many_copies():
    one = np.random.default_rng(0).integers(1, 5000, 700)
    symbols = np.concatenate([np.append(one, 0)] * 9).astype(np.int64)
    index = FMIndex(symbols, 5000)
    _, low, high = index.search(one[None, 300:310].astype(np.int64))
    assert sorted(index.locate(low, high)[1].tolist()) == [300 + 701 * i for i in range(9)]


def test_short_texts_are_one_shingle():
    texts = ["", "one two", "one two three four five", "one two three four five one two three four five"]
    for _, n, words in blocks(pa.array(texts), BLANK_WORDS):
        assert [len(s) for s in shingle_sets(words, n, 4)] == [0, 1, 2, 5]


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    ring = [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    edges = spark.createDataFrame(chain + star + ring + [(300, 301), (301, 300), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200 + i: 200 for i in range(7)} | {300: 300, 301: 300}
    assert got == want
    assert components(edges.limit(0)).count() == 0
