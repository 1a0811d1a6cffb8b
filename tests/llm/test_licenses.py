import random
import re

from corvane.llm import licenses
from corvane.llm.licenses import TEMPLATES, Template, align

BY_NAME = {t.name: t.text for t in TEMPLATES}


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        template = [rng.randrange(12) for _ in range(rng.randrange(1, 15))]
        text = [x for x in template if rng.random() < 0.8] + [rng.randrange(12) for _ in range(rng.randrange(4))]
        pairs = align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= longest_common(text, template)
    whole = list(range(30))
    assert align(whole[:12] + [99] + whole[13:], whole) == [(i, i) for i in range(30) if i != 12]


def test_gaps_without_unique_words_are_aligned_in_full():
    rng = random.Random(2)
    for _ in range(300):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2)]
        pairs = licenses.common(a, b, 0, len(a), 0, len(b))
        assert len(pairs) == longest_common(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] > q[0] and p[1] > q[1] for p, q in zip(pairs, pairs[1:]))


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, licenses int")
    rows = licenses.find_licenses(df).orderBy("doc_id").collect()
    return [[(x.license, r.text[x.start : x.end], round(x.coverage, 2)) for x in r.licenses] for r in rows]


def test_notices_copies_edits_and_near_misses(spark):
    mit = BY_NAME["MIT-notice"]
    texts = [
        f"é foo bar. {mit} baz", f"{mit} {mit}\n{mit}", "RELEASED under  the\nmit license", "Released under the BSD License.", None, "", "the under released",
        "x " * 40_000 + BY_NAME["GPL-3.0-notice"] + " y" * 500,
        "intro " + BY_NAME["MIT"].replace("copy, modify,", "copy, change,").replace("free of charge", "gratis") + " outro",
        "Licensed under the Apache License, Version 2.0.", "words of a mit under license the and released far apart " + "q " * 50,
    ]
    got = scan(spark, texts)
    assert got[0] == [("MIT-notice", "Released under the MIT License", 1.0)]
    assert got[1] == [("MIT-notice", "Released under the MIT License", 1.0)] * 3
    assert got[2] == [("MIT-notice", "RELEASED under  the\nmit license", 1.0)]
    assert got[3:7] == [[], [], [], []]
    assert [x[0] for x in got[7]] == ["GPL-3.0-notice"]
    assert [x[0] for x in got[8]] == ["MIT"] and 0.9 < got[8][0][2] < 1
    assert ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0", 1.0) in got[9]
    assert got[10] == []


def test_empty_table_and_own_templates(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma")], "doc_id int, text string")
    own = (Template("own", "alpha beta gamma"),)
    assert [len(r.licenses) for r in licenses.find_licenses(df, templates=own).collect()] == [1, 1]
    assert licenses.find_licenses(df.limit(0)).count() == 0
    assert [r.licenses for r in licenses.find_licenses(df, templates=()).collect()] == [[], []]


def test_any_number_of_foreign_words_may_stand_inside(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghklm") for _ in range(7))
    texts = []
    for n in (0, 5, 20, 40, 60, 120, 500):
        for spread in (False, True):
            words = BY_NAME["BSD-2-Clause"].split()
            for _ in range(n):
                words.insert(rng.randrange(1, len(words)) if spread else 30, word())
            texts.append(" ".join([word() for _ in range(200)] + words + [word() for _ in range(200)]))
    texts.append(texts[-1] + " " + BY_NAME["BSD-2-Clause"] + " " + texts[3])
    got = scan(spark, texts)
    assert all([(x[0], x[2]) for x in g] == [("BSD-2-Clause", 1.0)] for g in got[:-1])
    assert [x[0] for x in got[-1]] == ["BSD-2-Clause"] * 3


def test_recall_against_longest_common_subsequences(spark):
    """Edited, interrupted and interleaved templates among prose; a scan by brute force tells which reach the coverage."""
    rng = random.Random(4)
    prose = "the of and to in a this is be that or for with not may any by all at use software copy license".split()
    texts, want = [], []
    long = [t for t in TEMPLATES if not t.phrase]
    for k in range(120):
        template = rng.choice(long)
        words = [w for w in template.text.split() if rng.random() > rng.choice((0, 0.05, 0.1, 0.2, 0.3))]
        for _ in range(rng.choice((0, 3, 30, 150))):
            words.insert(rng.randrange(len(words)), rng.choice(prose))
        if k % 4 == 0:
            other, mixed = rng.choice(long).text.split(), []
            while words or other:
                for x in (words, other):
                    take = rng.randrange(1, 9)
                    mixed += x[:take]
                    del x[:take]
            words = mixed
        texts.append(" ".join([rng.choice(prose) for _ in range(rng.randrange(60))] + words + [rng.choice(prose) for _ in range(rng.randrange(60))]))
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for t in texts:
        reached = set()
        for x in long:
            a, b = split(t), split(x.text)
            cut = re.split("|".join(rf"(?<= {r.split()[0]}) (?={r.split()[1]} )" for r in x.never), " " + " ".join(a) + " ") if x.never else [" ".join(a)]
            if any(100 * longest_common(p.split(), b) >= licenses.COVERAGE * len(b) and set(x.must) <= set(p.split()) for p in cut):
                reached.add(x.name)
        want.append(reached)
    got = [{x[0] for x in g} for g in scan(spark, texts)]
    names = {t.name for t in long}
    assert all(len(x.split()) == 2 for t in long for x in t.never)
    found = sum(len(g & w) for g, w in zip(got, want))
    assert found >= 0.9 * sum(map(len, want)) > 50
    assert all((g & names) <= w for g, w in zip(got, want))


def test_headers_side_by_side_keep_their_own_words(spark):
    gpl, lgpl, agpl = BY_NAME["GPL-2.0-header"], BY_NAME["LGPL-header"], BY_NAME["AGPL-3.0-header"]
    rng = random.Random(6)
    foreign = lambda n: " ".join("".join(rng.choice("bcdfghklm") for _ in range(7)) for _ in range(n))
    words = gpl.split()
    halves = " ".join(words[:20]) + " " + foreign(60) + " " + " ".join(words[20:])
    texts = [
        f"{gpl} {lgpl}", f"{lgpl} {gpl}", " ".join(words[:-5]) + " " + lgpl, f"{halves} {foreign(300)} {lgpl}",
        " ".join([*words[:10], "lesser", *words[10:]]), f"{agpl} {foreign(50)} {lgpl} {foreign(50)} {gpl} {gpl}",
        " ".join(words[:-2]) + " " + foreign(400) + " later " + foreign(200) + " version", f"{foreign(99)} this {foreign(99)} {gpl}",
    ]
    got = [[(name, text.rstrip(".")) for name, text, _ in g if name in ("GPL-2.0-header", "LGPL-header", "AGPL-3.0-header")] for g in scan(spark, texts)]
    g, l, a = ("GPL-2.0-header", gpl.rstrip(".")), ("LGPL-header", lgpl.rstrip(".")), ("AGPL-3.0-header", agpl.rstrip("."))
    assert got[0] == [g, l] and got[1] == [l, g]
    assert [x[0] for x in got[2]] == ["GPL-2.0-header", "LGPL-header"] and got[2][1] == l
    assert got[3] == [("GPL-2.0-header", halves.rstrip(".")), l]
    assert got[4] == [("GPL-2.0-header", texts[4].rstrip("."))]
    assert got[5] == [a, l, g, g]
    assert got[6] == [("GPL-2.0-header", " ".join(words[:-2]))] and got[7] == [g]


def test_versions_and_kinds_are_told_apart(spark):
    texts = ["This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0.", BY_NAME["GPL-2.0-header"], BY_NAME["LGPL-header"]]
    assert [[x[0] for x in g] for g in scan(spark, texts)] == [["GPL-2.0-notice"], ["CC-BY-SA-4.0-notice"], ["CC-BY-4.0-notice"], ["CC-BY-NC-4.0-notice"], ["GPL-2.0-header"], ["LGPL-header"]]
