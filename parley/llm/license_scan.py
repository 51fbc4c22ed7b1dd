"""License scans by patience alignment.

Words that occur once in a stretch of text and once in a template are anchors; the longest increasing subsequence of
them is kept, the gaps between them are aligned the same way, and equal words next to an anchor are taken along. The
coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_views

#: Names and texts of notices and license openings, as published by their stewards.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "Released under the MIT License",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}
#: Words too common to point at a template.
COMMON = frozenset("a an and any are as at be by for if in is it of on or the this to under with you".split())
_WORD = re.compile(r"[^\W_]+")


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending in the first) that ascends in the second too, by patience piles."""
    tops, at, back = [], [], [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back[i] = at[pile - 1] if pile else -1
        tops[pile : pile + 1] = [b]
        at[pile : pile + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs (i, j) of aligned equal words of a and b, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        places = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, places[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in places])
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


class Matcher:
    """Finds the passages of a text that cover at least `least` of a template."""

    def __init__(self, templates=None, least: float = 0.8):
        self.least = least
        self.templates = {k: _WORD.findall(v.lower()) for k, v in (templates or TEMPLATES).items()}
        self.telling = {k: {w for w in v if w not in COMMON} for k, v in self.templates.items()}
        self.vocabulary = set().union(*self.telling.values())
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        self.marks = {k: {w: sum(1 << i for i, x in enumerate(v) if x == w) for w in set(v)} for k, v in self.templates.items()}
        self.at = {k: {w: [i for i, x in enumerate(v) if x == w] for w in self.telling[k]} for k, v in self.templates.items()}

    def needed(self, name: str) -> int:
        """So many distinct telling words a passage has at least: words left out are at most 1 - least of the template."""
        counts = Counter(w for w in self.templates[name] if w in self.telling[name])
        spare, missing = len(self.templates[name]) - self.covered(name), 0
        for n in sorted(counts.values()):
            if spare < n:
                break
            spare, missing = spare - n, missing + 1
        return max(1, len(counts) - missing)

    def covered(self, name: str) -> int:
        return math.ceil(self.least * len(self.templates[name]) - 1e-9)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end in code points) of each passage, by start. Of overlapping passages of one
        template the better one is given; a passage inside that of a longer template is left out."""
        lower = text.lower()
        if len(lower) != len(text):  # letters whose lower case is longer: fold those that keep the length only
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = _WORD.findall(lower)
        seen = self.vocabulary.intersection(words)
        names = [k for k in self.templates if len(self.telling[k] & seen) >= self.needed(k)]
        if not names:
            return []
        found, places = [], [m.span() for m in _WORD.finditer(lower)]
        for name in names:
            template, own = self.templates[name], []
            windows = dict.fromkeys(self.stretches(words, name))
            windows.update(dict.fromkeys(self.repeats(words, name, list(windows))))
            for start, end in windows:
                pairs = align(words[start:end], template)
                if len(pairs) >= self.covered(name):
                    own.append((len(pairs) / len(template), places[start + pairs[0][0]][0], places[start + pairs[-1][0]][1]))
            kept: list[tuple[float, int, int]] = []
            for c, a, b in sorted(own, key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(b <= y or a >= z for _, y, z in kept):
                    kept.append((c, a, b))
            found += [(name, c, a, b, len(template)) for c, a, b in kept]
        inside = lambda x: any(y[4] > x[4] and y[2] <= x[2] and x[3] <= y[3] for y in found)
        return sorted(((n, c, a, b) for n, c, a, b, m in found if not inside((n, c, a, b, m))), key=lambda x: (x[2], x[0]))

    def stretches(self, words: list[str], name: str):
        """Stretches of the text around telling words: windows of twice the template's length, half overlapping."""
        telling, m = self.telling[name], len(self.templates[name])
        hits = [i for i, w in enumerate(words) if w in telling]
        done = -1
        for h in hits:
            start = max(0, h - m // 2)
            if h > done:
                for at in (start, h):
                    yield at, min(len(words), at + 2 * m)
                done = h + m // 4

    def shared(self, words: list[str], name: str, length: int) -> list[int]:
        """How many words the template shares with the `length` words from each place on, counted once over the text."""
        counts, held, n, out = self.counts[name], Counter(), 0, [0] * len(words)
        for i in range(len(words) - 1, -1, -1):
            if (w := words[i]) in counts:
                held[w] += 1
                n += held[w] <= counts[w]
            if i + length < len(words) and (w := words[i + length]) in counts:
                n -= held[w] <= counts[w]
                held[w] -= 1
            out[i] = n
        return out

    def longest_common(self, words: list[str], name: str) -> int:
        """The length of the longest common subsequence with the template; no alignment has more pairs."""
        marks, all_ = self.marks[name], (1 << len(self.templates[name])) - 1
        open_ = all_
        for w in words:
            if met := open_ & marks.get(w, 0):
                open_ = ((open_ + met) | (open_ - met)) & all_
        return len(self.templates[name]) - open_.bit_count()

    def repeats(self, words: list[str], name: str, windows: list[tuple[int, int]]):
        """For windows that hold telling words more often than the template, and so give few anchors: stretches of the
        template's length, and a fifth more, from each word where a copy may begin, unless too few words stand in order."""
        counts, m, least = self.counts[name], len(self.templates[name]), self.covered(name)
        places: set[int] = set()
        for start, end in windows:
            found = Counter(w for w in words[start:end] if w in self.telling[name])
            if any(n > counts[w] for w, n in found.items()):
                places.update(max(0, i - t) for i in range(start, end) for t in self.at[name].get(words[i], ()))
        if not places:
            return
        short, long = m, m + m // 5
        by_length = {length: self.shared(words, name, length) for length in (short, long)}
        for at in sorted(places):
            if by_length[long][at] >= least and self.longest_common(words[at : at + long], name) >= least:
                for length in (short, long):
                    if by_length[length][at] >= least:
                        yield at, min(len(words), at + length)


def license_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, templates=None) -> DataFrame:
    """One row per passage: doc_id, license, coverage (of the template's words), start, end (code points, end exclusive).

    A null or empty text has none; repeated rows are scanned each on its own. A text may be of any length and hold any
    number of copies; of equal and overlapping passages of one template the better is given, of equally good ones the
    shorter and then the earlier. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        matcher = Matcher(templates, least)
        for batch in batches:
            rows = []
            for key_, view in zip(batch.column("doc_id").to_pylist(), text_views(batch.column("text")), strict=True):
                rows += [(key_, *x) for x in matcher.scan(str(view, "utf-8"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, license string, coverage double, start long, end long")
