"""License scan by patience alignment (operator 7).

Text and template are words (letters and digits, case folded).  A text is aligned with a template wherever a stretch of
it (half as long again as the template) holds enough of the template's words: the fullest stretch first, the others until
one is accepted, then the text on both sides of the accepted notice in the same way, so a text has one row for each
notice that stands in it.  Alignment: words that are
unique in both are anchors; the longest increasing subsequence of their places is kept; the gaps between kept anchors
are aligned the same way, since words repeated elsewhere may be unique inside a gap.  Coverage is the share of the
template's words that are aligned.

A notice is accepted by four rules.  (1) Coverage is at least ``least``.  (2) So is the share of aligned words in the
stretch from the first to the last of them: words in gaps count against it.  (3) What tells the license from its
neighbours is there: a template of another license that covers this one to ``least`` leaves some of its words out
("MIT", "version 3"), and of these, as of the numbers of a short notice, the same share is aligned, all of them if there
are four or fewer.  (4) Where a
neighbour has more words ("GNU Lesser General", "BY-NC"), no word stands in between.  Of accepted notices that overlap,
the one with the most aligned words stays.

Templates travel with the tasks (a list of notices, tens of KB).  Every whole text is scanned where it is read; nothing
is shuffled.

Defined results: null, empty and wordless texts match nothing; repeated rows are scanned each; of equally full stretches
the first is tried first; of equally good overlapping notices the one with the higher coverage, then the smaller name
stays; null doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.llm.common import pieces, word_hashes, word_spans

# Notices as their publishers word them.
TEMPLATES = {
    "Apache-1.0": "Licensed under the Apache License, Version 1.0.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "EPL-1.0": "Licensed under the Eclipse Public License, Version 1.0.",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0.",
    "ISC": "Released under the ISC License.",
    "MIT": "Released under the MIT License.",
    "MPL-1.1": "Licensed under the Mozilla Public License, Version 1.1.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "ODbL-1.0": "Released under the Open Database License.",
    "Zlib": "Released under the zlib License.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
        "FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS "
        "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions."),
}
# The GNU licenses and their versions, the Creative Commons licenses, their versions and names of these.
GNU = {"GPL": ("GNU General Public License", ("1", "2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
       "AGPL": ("GNU Affero General Public License", ("3",)), "GFDL": ("GNU Free Documentation License", ("1.1", "1.2", "1.3"))}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
      "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
for _key, (_name, _versions) in GNU.items():
    for _v in _versions:
        _id = f"{_key}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES[_id] = f"This work is licensed under the {_name}, version {_v}."
        TEMPLATES[f"{_id}-or-later"] = f"This work is licensed under the {_name}, version {_v} or later."
        TEMPLATES[f"{_id}-or-later-notice"] = f"This work is licensed under the {_name}, version {_v} or any later version."
        if _key != "GFDL":
            TEMPLATES[f"{_id}-or-later-header"] = (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free "
                f"Software Foundation, either version {_v} of the License, or (at your option) any later version.")
for _key, _name in CC.items():
    for _v, _port in CC_VERSIONS.items():
        TEMPLATES[f"CC-{_key}-{_v}"] = f"Licensed under CC {_key} {_v}."
        TEMPLATES[f"CC-{_key}-{_v}-header"] = f"This work is licensed under a Creative Commons {_name} {_v} {_port} License."


def breaks() -> np.ndarray:
    """Bytes that end a word: all ASCII but letters and digits."""
    out = np.zeros(256, dtype=bool)
    out[:128] = [not chr(c).isalnum() for c in range(128)]
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, offsets, breaks())
    return word_hashes(data, starts, ends), rows


def template_words(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return _words(data, np.array([0, len(data)]))[0].tolist()


def rising(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(places)
    for i, p in enumerate(places):
        j = bisect_left(tails, p)
        if j == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[j], ends[j] = p, i
        back[i] = ends[j - 1] if j else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # equal heads and tails of a gap align
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(template[c:d], c) if right[w] == 1 and left[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(text[a:b], a) if w in where]
        kept = [anchors[i] for i in rising([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


def windows(words: list[int], at: list[int], needed: Counter, length: int, enough: float) -> list[tuple[int, int, int, int]]:
    """(-held, last, first, tight first) of every stretch of at most ``length`` words that ends at a place of ``at`` and
    holds ``enough`` template words, counted as often as the template has them; fullest first.  The tight one leaves out
    words at its head that it holds again."""
    out, held, full, close, i, k = [], Counter(), 0, Counter(), 0, 0
    for j, p in enumerate(at):
        w = words[p]
        full += held[w] < needed[w]
        held[w] += 1
        close[w] += 1
        while at[i] <= p - length:
            w = words[at[i]]
            held[w] -= 1
            full -= held[w] < needed[w]
            i += 1
        while k < i or close[words[at[k]]] > needed[words[at[k]]]:
            close[words[at[k]]] -= 1
            k += 1
        if full >= enough:
            out.append((-full, p, at[i], at[k]))
    return sorted(out)


class Rule:
    """When an alignment with one template is a notice: see the four rules above."""

    def __init__(self, template: list[int], others: list[list[int]], version: list[int], least: float):
        self.template, self.least, self.enough = template, least, least * len(template)
        self.closed: set[int] = set()  # joints: nothing may stand between these places and the next
        telling, mine = {frozenset(version)}, Counter(template)
        for other in others:
            if (mine & Counter(other)).total() < self.enough:
                continue
            shared = patience(other, template)
            if len(shared) < self.enough:
                continue
            telling.add(frozenset(range(len(template))) - {j for _, j in shared})
            self.closed |= {j for (i, j), (u, v) in zip(shared, shared[1:]) if v == j + 1 and u > i + 1}
        self.telling = sorted((sorted(t) for t in telling if t), key=lambda t: (len(t), t))

    def needed(self, words: list[int]) -> int:
        return math.ceil(self.least * len(words))

    def trimmed(self, got: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Without aligned words that stand far off at an end while words in gaps are too many."""
        while len(got) > 1 and len(got) < self.least * (got[-1][0] - got[0][0] + 1):
            got = got[1:] if got[1][0] - got[0][0] > got[-1][0] - got[-2][0] else got[:-1]
        return got

    def holds(self, got: list[tuple[int, int]]) -> bool:
        if len(got) < self.enough or len(got) < self.least * (got[-1][0] - got[0][0] + 1):
            return False
        places = {j for _, j in got}
        if any(sum(j in places for j in t) < self.needed(t) for t in self.telling):
            return False
        return not any(j in self.closed and v == j + 1 and u > i + 1 for (i, j), (u, v) in zip(got, got[1:]))


def license_of(name: str) -> str:
    """A template's license: its name without the form."""
    return name.removesuffix("-header").removesuffix("-text").removesuffix("-notice")


def numbers(name: str, text: str) -> list[int]:
    """Places of a notice's numbers (its version); those of a whole text are clauses, which lists also mark by bullets."""
    if name.endswith("-text"):
        return []
    return [i for i, w in enumerate(re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text)) if w.isdigit()]


def rules(templates: dict[str, str], least: float = 0.8) -> dict[str, Rule]:
    """One rule a template.  Neighbours are the given templates and all known ones."""
    words = {n: template_words(t) for n, t in (TEMPLATES | templates).items()}

    def rule(name: str) -> Rule:
        others = [w for o, w in words.items() if license_of(o) != license_of(name) and w != words[name]]
        return Rule(words[name], others, numbers(name, templates[name]), least)

    return {n: rule(n) for n in sorted(templates)}


def notices(words: list[int], at: list[int], rule: Rule) -> list[list[tuple[int, int]]]:
    """Alignments that hold by ``rule``, apart from each other: the fullest stretch first, then what is left on both
    sides of it.  ``at``: places of template words in ``words``."""
    template = rule.template
    needed, out, todo = Counter(template), [], [(0, len(at), 0, len(words))]
    half = len(template) // 2
    while todo:
        a, b, low, high = todo.pop()
        for _, last, first, tight in windows(words, at[a:b], needed, len(template) + half + 8, rule.enough):
            best: list[tuple[int, int]] = []
            for x, y in ((tight, last + 1), (first, last + 1), (max(low, first - half), min(high, last + 1 + half))):
                got = rule.trimmed(patience(words[x:y], template))
                if len(got) > len(best) and rule.holds(got):
                    best = [(x + i, j) for i, j in got]
            if best:
                out.append(best)
                begin, end = best[0][0], best[-1][0]
                todo += [(a, bisect_left(at, begin), low, begin), (bisect_left(at, end + 1), b, end + 1, high)]
                break
    return sorted(out)


def apart(found: list[tuple]) -> list[tuple]:
    """Of notices (name, aligned, coverage, first, last) that overlap only the best."""
    kept: list[tuple[int, int, tuple]] = []
    for x in sorted(found, key=lambda x: (-x[1], -x[2], x[0], x[3])):
        i = bisect_left(kept, (x[3],))
        if (i == 0 or kept[i - 1][1] < x[3]) and (i == len(kept) or kept[i][0] > x[4]):
            insort(kept, (x[3], x[4], x))
    return [x for _, _, x in kept]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word (places among the text's words) of each accepted notice."""
    by_name = rules(templates, least)
    names, judges = list(by_name), list(by_name.values())

    def run(batches):
        import pyarrow as pa

        vocabulary = np.unique(np.array([w for r in judges for w in r.template], dtype=np.uint64))
        uses = np.array([np.isin(vocabulary, np.array(r.template, dtype=np.uint64)) for r in judges])

        def counted(words):  # how often each word of the vocabulary stands in a list of words
            return np.bincount(np.searchsorted(vocabulary, np.array(words, dtype=np.uint64)), minlength=len(vocabulary))

        # a text can hold a notice only if its kinds of words reach these sums: the whole template, then what tells it apart
        sums = [(k, r.template, r.enough) for k, r in enumerate(judges)]
        sums += [(k, [r.template[j] for j in t], r.needed(t)) for k, r in enumerate(judges) for t in r.telling]
        sums.sort(key=lambda x: x[0])
        weights = np.array([counted(w) for _, w, _ in sums], dtype=np.float32).T
        enough = np.array([x for _, _, x in sums])
        begins = np.searchsorted([k for k, _, _ in sums], np.arange(len(judges)))
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for at, data, offsets in pieces(batch.column("text"), 500_000):
                words, rows = _words(data, offsets)
                place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[place] == words)
                if not len(hit):
                    continue
                seen = np.zeros((len(offsets) - 1, len(vocabulary)), dtype=np.float32)
                seen[rows[hit], place[hit]] = 1
                possible = np.logical_and.reduceat(seen @ weights >= enough, begins, axis=1)
                begin = np.searchsorted(rows, np.arange(len(offsets)))
                for row in np.flatnonzero(possible.any(axis=1)):
                    inside = hit[(hit >= begin[row]) & (hit < begin[row + 1])]
                    text, found = words[begin[row]:begin[row + 1]].tolist(), []
                    for k in np.flatnonzero(possible[row]):
                        own = inside[uses[k][place[inside]]]
                        for got in notices(text, (own - begin[row]).tolist(), judges[k]):
                            found.append((names[k], len(got), len(got) / len(judges[k].template), got[0][0], got[-1][0]))
                    out += [(ids[at + row], name, coverage, first, last) for name, _, coverage, first, last in apart(found)]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long")
