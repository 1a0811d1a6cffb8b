"""License scans by patience alignment of whole texts with license templates.

A text is a candidate for a template if it holds enough of its words, which a
table of word hashes tells for a block of texts at once.  The text is then
aligned with the template: words unique to both sides anchor the longest
increasing subsequence, gaps are aligned the same way, a gap without such words
by its longest common subsequence, and the share of template words matched is
the coverage.  Copies that stand together are sought around the rare words of
the template first; then each stretch between them is aligned as a whole, so
that any number of foreign words may stand inside an occurrence.  No occurrence
holds words that its template excludes, so the text is cut at these beforehand.
Of the words that match, those nearest to each other are taken.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm import store
from corvane.llm.kernel import ALNUM_WORDS, blocks, tidy

#: Percent of a template's words that a license needs.
COVERAGE = 80


@dataclass(frozen=True)
class Template:
    """must: words without which a match doesn't count.  never: words, or words in a row, that no occurrence holds.

    phrase: a notice of few and common words, which must stand together: within
    half its length more of foreign words.
    """

    name: str
    text: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    phrase: bool = False


#: License notices and texts.
TEMPLATES = (
    Template("MIT-notice", "Released under the MIT License.", ("mit",), phrase=True),
    Template("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0.", ("apache",), phrase=True),
    Template("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "2"), ("lesser", "affero", "3"), phrase=True),
    Template("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "3"), ("lesser", "affero", "2"), phrase=True),
    Template("LGPL-notice", "This work is licensed under the GNU Lesser General Public License.", ("gnu", "lesser"), phrase=True),
    Template("AGPL-notice", "This work is licensed under the GNU Affero General Public License.", ("gnu", "affero"), phrase=True),
    Template("CC-BY-4.0-notice", "Licensed under CC BY 4.0.", ("cc", "by", "4"), ("nc", "sa", "nd"), phrase=True),
    Template("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0.", ("cc", "sa", "4"), ("nc", "nd"), phrase=True),
    Template("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0.", ("cc", "nc"), ("sa", "nd"), phrase=True),
    Template("CC-BY-ND-4.0-notice", "Licensed under CC BY-ND 4.0.", ("cc", "nd", "4"), ("nc", "sa"), phrase=True),
    Template("CC-BY-NC-SA-4.0-notice", "Licensed under CC BY-NC-SA 4.0.", ("cc", "nc", "sa"), phrase=True),
    Template("CC-BY-NC-ND-4.0-notice", "Licensed under CC BY-NC-ND 4.0.", ("cc", "nc", "nd"), phrase=True),
    Template("CC0-1.0-notice", "Dedicated to the public domain under CC0 1.0 Universal.", ("cc0",), phrase=True),
    Template("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla",)),
    Template("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("BSD-3-Clause-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered",)),
    Template("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    Template("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', ("apache",)),
    Template("GPL-2.0-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("2", "gnu"), ("gnu lesser", "gnu affero")),
    Template("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("3", "gnu"), ("gnu lesser", "gnu affero")),
    Template("LGPL-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("lesser", "gnu")),
    Template("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("affero", "gnu")),
)


def common(text: list, template: list, a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of text[a:b] and template[c:d]: one bit row of steps for each text word that the template has."""
    at: dict = {}
    for j in range(c, d):
        at[template[j]] = at.get(template[j], 0) | 1 << (j - c)
    full = (1 << (d - c)) - 1
    row, places, rows = full, [], []
    for i in range(a, b):
        if hit := at.get(text[i], 0):
            both = row & hit
            row = ((row + both) | (row - both)) & full
            places.append(i)
            rows.append(row)
    out, k, j = [], len(rows), d - c
    while k and j:
        if rows[k - 1] >> (j - 1) & 1:
            j -= 1
        else:
            k -= 1
            if not k or rows[k - 1] >> (j - 1) & 1:
                j -= 1
                out.append((places[k], c + j))
    return out


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched (text place, template place), both increasing: patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if in_template[w] == 1 and in_text[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(text[a:b], a) if w in where]
        # Longest run of anchors that also increases in the template: piles by their tops.
        tops: list[int] = []
        piles: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(anchors):
            at = bisect_left(tops, j)
            before.append(piles[at - 1] if at else -1)
            tops[at:], piles[at:] = [j, *tops[at + 1 :]], [k, *piles[at + 1 :]]
        chain, k = [], piles[-1] if piles else -1
        while k >= 0:
            chain.append(anchors[k])
            k = before[k]
        chain.reverse()
        if not chain:
            out += common(text, template, a, b, c, d)
            continue
        out += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def _nearest(text: list, end: int, words: list) -> list[int]:
    """Places of the words, in their order, in the shortest stretch of the text whose last word is at ``end`` or before it."""
    i = end + 1
    for w in reversed(words):
        i -= 1
        while text[i] != w:
            i -= 1
    out = []
    for w in words:
        while text[i] != w:
            i += 1
        out.append(i)
        i += 1
    return out


class _Prepared:
    """Templates as lists of word hashes, and for each distinct word how many places it fills."""

    def __init__(self, templates: tuple[Template, ...]):
        self.names = [t.name for t in templates]
        lists = [self._hashes([t.text for t in templates]), self._hashes([" ".join(t.must) for t in templates])]
        self.words, self.must = [x.tolist() for x in lists[0]], [set(x.tolist()) for x in lists[1]]
        self.never = [[x.tolist() for x in self._hashes(list(t.never)) if len(x)] for t in templates]
        self.phrase = [t.phrase for t in templates]
        self.vocabulary = np.unique(np.concatenate(lists[0])) if templates else np.zeros(0, dtype=np.uint64)
        self.places = np.zeros((len(self.vocabulary), len(templates)), dtype=np.int32)
        for i, words in enumerate(lists[0]):
            np.add.at(self.places, (np.searchsorted(self.vocabulary, words), i), 1)
        self.size = np.array([len(x) for x in self.words])

    @staticmethod
    def _hashes(texts: list[str]) -> list[np.ndarray]:
        found = []
        for a, b, words in blocks(pa.array(texts, pa.string()), ALNUM_WORDS):
            found += [words.hash[words.first[i] : words.first[i + 1]] for i in range(b - a)]
        return found

    def scan(self, hashes: list, which: int, coverage: int) -> list[tuple[int, int, int]]:
        """(first word, word after the last, matched words) of each occurrence, not overlapping."""
        cuts = []
        for run in self.never[which]:
            cuts += [(i, i + len(run)) for i, w in enumerate(hashes) if w == run[0] and hashes[i : i + len(run)] == run]
        out, start = [], 0
        for a, b in [*sorted(cuts), (len(hashes), len(hashes) + 1)]:
            for hit in self._scan(hashes[start : b - 1], which, coverage):
                out.append((hit[0] + start, hit[1] + start, hit[2]))
            start = max(a + 1, out[-1][1] if out else 0)
        return out

    def _scan(self, hashes: list, which: int, coverage: int) -> list[tuple[int, int, int]]:
        """The same, of a stretch without excluded words."""
        template, m = self.words[which], self.size[which]
        need = -(-m * coverage // 100)
        if len(hashes) < need:
            return []
        counts = Counter(hashes)
        # An occurrence lacks at most m - need places: of any more, one is there.
        places = sorted(range(m), key=lambda j: (counts[template[j]], j))[: m - need + 1]
        keys: dict = {}
        for j in places:
            keys.setdefault(template[j], j)
        starts = sorted({max(0, i - keys[w]) for i, w in enumerate(hashes) if w in keys})
        out, free, slack = [], 0, m // 4 + 2
        for s in starts:
            lo, hi = max(free, s - slack), s + m + slack
            if s + m <= free:
                continue
            region = hashes[lo:hi]
            matched = align(region, template)
            if len(matched) < need and (repeat := self._tighter(region, template, s - lo, m)):
                matched = repeat
            while len(matched) >= need and len(matched) < m and not self.phrase[which]:  # grow while that helps
                first, last = max(free, lo - (hi - lo)), hi + (hi - lo)
                wider = align(hashes[first:last], template)
                if len(wider) <= len(matched):
                    break
                lo, hi, matched = first, last, wider
            if len(matched) >= need:
                *hit, right = self._hit(hashes, lo, matched, which, need)
                if right:
                    out.append(tuple(hit))
                    free = hit[1]
        if self.phrase[which]:
            return out
        edges = [0, *(x for hit in out for x in hit[:2]), len(hashes)]
        todo = list(zip(edges[::2], edges[1::2]))
        while todo:  # what stands between, each as a whole
            lo, hi = todo.pop()
            here = set(hashes[lo:hi]) if hi - lo >= need else ()
            if sum(w in here for w in template) < need:
                continue
            if len(matched := align(hashes[lo:hi], template)) >= need:
                *hit, right = self._hit(hashes, lo, matched, which, need)
                todo += [(lo, hit[0]), (hit[1], hi)]
                if right:
                    out.append(tuple(hit))
        return sorted(out)

    def _hit(self, hashes: list, lo: int, matched: list[tuple[int, int]], which: int, need: int) -> tuple[int, int, int, bool]:
        """First word, word after the last, matched words, and whether none that must be there is missing."""
        template, m = self.words[which], self.size[which]
        places = _nearest(hashes, lo + matched[-1][0], [template[j] for _, j in matched])
        first, last, few = 0, len(places), max(1, m // 20)
        for _ in range(m - need):  # a few words far off are chance
            ahead = next((k for k in range(first + 1, min(first + few, last - 1) + 1) if places[k] - places[k - 1] > m), 0)
            behind = next((k for k in range(last - 1, max(last - few, first + 1) - 1, -1) if places[k] - places[k - 1] > m), 0)
            if ahead and last - ahead >= need and not self.must[which] & {template[j] for _, j in matched[first:ahead]}:
                first = ahead
            elif behind and behind - first >= need and not self.must[which] & {template[j] for _, j in matched[behind:last]}:
                last = behind
            else:
                break
        return places[first], places[last - 1] + 1, last - first, self.must[which] <= {template[j] for _, j in matched[first:last]}

    @staticmethod
    def _tighter(region: list, template: list, at: int, m: int) -> list[tuple[int, int]]:
        """Without what surrounds the expected place, where words may repeat."""
        return [(i + at, j) for i, j in align(region[at : at + m], template)]


def _scanner(block, coverage: int, fields: list[str], schema: pa.Schema):
    def run(batches):
        prepared = _Prepared.__new__(_Prepared)
        prepared.__dict__.update(block.value)
        for batch in batches:
            for a, b, words in blocks(batch.column(batch.schema.get_field_index("__cv_text")), ALNUM_WORDS):
                n, vocab = b - a, prepared.vocabulary
                at = np.minimum(np.searchsorted(vocab, words.hash), max(len(vocab) - 1, 0))
                known = vocab[at] == words.hash if len(vocab) else np.zeros(len(words.hash), dtype=bool)
                text = np.repeat(np.arange(n), np.diff(words.first))
                held = np.zeros((n, len(vocab)), dtype=np.int32)
                held[text[known], at[known]] = 1
                possible = (held @ prepared.places) * 100 >= coverage * prepared.size
                found = [[] for _ in range(n)]
                for d, which in np.argwhere(possible):
                    w0, w1 = words.first[d], words.first[d + 1]
                    hits = prepared.scan(words.hash[w0:w1].tolist(), which, coverage)
                    if hits:
                        base = words.offsets[d]
                        points = np.concatenate(([0], np.cumsum((words.low[base : words.offsets[d + 1]] & 0xC0) != 0x80)))
                        for s, e, matched in hits:
                            found[d].append({"start": int(points[words.start[w0 + s] - base]), "end": int(points[words.end[w0 + e - 1] - base]), "license": prepared.names[which], "coverage": matched / int(prepared.size[which])})
                made = [sorted(x, key=lambda h: (h["start"], h["end"], h["license"])) for x in found]
                part = batch.slice(a, n)
                yield pa.RecordBatch.from_arrays([pa.array(made, schema.field(f).type) if f == "licenses" else part.column(f).cast(schema.field(f).type) for f in fields], schema=schema)

    return run


def find_licenses(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, coverage: int = COVERAGE, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with licenses: array<struct<start, end, license, coverage>> by start (code points, end exclusive).

    keep: the columns to return (all by default); a column named licenses is
    replaced.  Null and empty texts have none; repeated rows are scanned alike;
    occurrences of one template don't overlap, those of several may.  Foreign
    words inside an occurrence don't lower its coverage, however many they are;
    only the notices marked as phrases must stand together.
    """
    spark = docs.sparkSession
    store.ship(spark)
    kept = [c for c in (keep if keep is not None else docs.columns) if c != "licenses"]
    hit = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("license", T.StringType()).add("coverage", T.DoubleType())
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__cv_text"))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("licenses", T.ArrayType(hit))])
    block = spark.sparkContext.broadcast(_Prepared(templates).__dict__)
    return source.mapInArrow(tidy(_scanner(block, coverage, schema.names, to_arrow_schema(schema))), schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    shown = F.transform("licenses", lambda h: F.concat_ws(":", h["license"], h["start"].cast("string"), h["end"].cast("string"), F.round(h["coverage"] * 100).cast("int").cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(shown, ",").alias("licenses"))


QUERIES = {"op6_license_scans": query}
ORACLES: dict[str, str] = {}
