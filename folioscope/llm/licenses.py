"""License scan by patience alignment of texts with license templates.

Both sides are words. An alignment anchors on words that occur once in the template and once in the stretch of text at
hand, keeps the longest increasing subsequence of the anchors, and aligns the gaps between them in the same way, until
a gap has no unique common word; leading and trailing equal words of a gap count too. Coverage is the share of the
template's words that are aligned.

A template's words are ranked by rarity among the templates; any text that covers ``COVERAGE`` of a template holds at
least one of its ``signal`` words, which make up more than 1 - COVERAGE of it. So texts without a signal word of any
template are passed over in the scan. The others are aligned in stretches around signal words, in windows of one and a
half template lengths, of twice that, and so on up to the stretch, and as a whole: a text whose alignment as a whole
reaches the coverage is never lost, and a text that repeats a license is aligned once for each place. Windows that hold
too few of a template's words, in any order, aren't aligned.

Defined results: null and empty texts match nothing; texts are scanned whole, of any length; rows with a null doc_id
are scanned too; repeated rows are scanned each; a text may match several templates, but of templates that align with
overlapping words only the one with the most aligned words is reported, ties to the name that sorts first, then to the
narrower place; a template that occurs several times is counted, its best coverage reported; extra columns, of any
names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

COVERAGE = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words(text: str) -> list[str]:
    return [m.group().lower() for m in _WORD.finditer(text)]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of aligned equal words, ascending in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        left, right = Counter(a[i:j]), Counter(b[k:m])
        place = {w: x for x, w in enumerate(b[k:m], k) if right[w] == 1}
        anchors = [(x, place[w]) for x, w in enumerate(a[i:j], i) if left[w] == 1 and w in place]
        if not anchors:
            continue
        chain = increasing(anchors)
        out += chain
        edge = [(i - 1, k - 1), *chain, (j, m)]
        work += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edge, edge[1:], strict=False)]
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, given ascending in the first part, that ascends in the second too."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for x, (_, v) in enumerate(pairs):
        k = bisect_left(tails, v)
        before[x] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(x)
        else:
            tails[k], at[k] = v, x
    chain, x = [], at[-1] if at else -1
    while x >= 0:
        chain.append(pairs[x])
        x = before[x]
    return chain[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.templates = {k: words(v) for k, v in sorted((templates or TEMPLATES).items())}
        self.coverage = coverage
        common = Counter(w for t in self.templates.values() for w in set(t))
        plain = set("the of to and a in or is this for with any be as not you it that on by are at under from was one all if into do so your will more even other"
                    " non may means author common person persons list files general published version".split())
        self.signal: dict[str, set[str]] = {}
        for name, t in self.templates.items():
            count, chosen, mass = Counter(t), set(), 0
            for w in sorted(count, key=lambda w: (w in plain, len(w) < 4, common[w], -len(w), w)):
                if mass > len(t) * (1 - coverage) + 1e-9:
                    break
                chosen.add(w)
                mass += count[w]
            self.signal[name] = chosen

    def pattern(self) -> str:
        """A regular expression that every text with a signal word matches; words grouped by their first letter."""
        tails: dict[str, list[str]] = {}
        for w in sorted({w for s in self.signal.values() for w in s}):
            tails.setdefault(re.escape(w[0]), []).append(re.escape(w[1:]))
        body = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in tails.items())
        return f"(?i)(?<![a-z0-9])(?:{body})(?![a-z0-9])"

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, aligned words, places) of each template that the text reaches."""
        tokens = words(text)
        found: list[tuple[int, str, tuple[int, ...]]] = []
        have = Counter(tokens)
        for name, template in self.templates.items():
            signal, size = self.signal[name], len(template)
            need = self.coverage * size
            if sum(min(n, have[w]) for w, n in Counter(template).items()) < need:
                continue
            hits = [k for k, w in enumerate(tokens) if w in signal]
            if not hits:
                continue
            stretches: list[list[int]] = []
            for k in hits:
                low, high = max(0, k - size - size // 4), min(len(tokens), k + size + size // 4 + 1)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
            if stretches != [[0, len(tokens)]]:
                found += self._windows(name, template, tokens, [0], len(tokens), len(tokens), need)
            for low, high in stretches:
                found += self._places(name, template, tokens, low, high, need)
        found.sort(key=lambda x: (-x[0], x[1], x[2][-1] - x[2][0], x[2]))
        taken: set[int] = set()
        best: dict[str, list] = {}
        for n, name, places in found:
            if taken.isdisjoint(places):
                taken.update(places)
                row = best.setdefault(name, [n, 0])
                row[1] += 1
        return [(name, round(n / len(self.templates[name]), 6), n, places) for name, (n, places) in sorted(best.items())]

    def _places(self, name: str, template: list[str], tokens: list[str], low: int, high: int, need: float) -> list:
        """Alignments in one stretch. A long stretch may hold the template several times, so that few of its words are
        unique there: windows of the template's length and a half, a third of it apart, are then aligned each, and
        wider ones for a template with words put in between."""
        size, out = len(template), []
        wide = size + size // 2
        while True:
            starts = [low] if high - low <= wide else range(low, high - wide + max(1, wide // 3), max(1, wide // 3))
            out += self._windows(name, template, tokens, starts, wide, high, need)
            if high - low <= wide:
                return out
            wide *= 2

    def _windows(self, name: str, template: list[str], tokens: list[str], starts: Iterable[int], wide: int, high: int, need: float) -> list:
        out, wanted = [], Counter(template)
        for start in starts:
            end = min(high, start + wide)
            have = Counter(tokens[start:end])
            if sum(min(n, have[w]) for w, n in wanted.items()) < need:
                continue
            pairs = align(tokens[start:end], template)
            if len(pairs) >= need:
                out.append((len(pairs), name, tuple(start + x for x, _ in pairs)))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, aligned, places), a row for each document and template that it reaches."""
    scanner = Scanner(templates, coverage)
    schema = "doc_id long, license string, coverage double, aligned int, places int"

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [
                (doc, *hit)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for hit in scanner.scan(text)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "license", "coverage", "aligned", "places"],
            )

    likely = docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").rlike(scanner.pattern()))
    return likely.mapInArrow(batches, schema)
