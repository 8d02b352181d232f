"""License scans by patience alignment.

Words that occur once in both text and template are anchors; the longest increasing subsequence of their positions is
kept, and the gaps between neighbours are aligned the same way, after the words that agree at their two ends. A
template's coverage is the share of its words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pkgutil
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."

#: Texts of notices, fixed values: (name, words).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited."),
    ("All-rights-reserved", "All rights reserved."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-header", _GNU.format("Affero General Public License", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-header", _GNU.format("General Public License", "2")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-header", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-header", _GNU.format("Lesser General Public License", "3")),
    ("CC-BY-4.0-short", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0-notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_WARRANTY}"),
    ("BSD-3-Clause-text", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT-text", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
#: Licenses whose whole texts lie in the folder ``licenses``.
FULL_TEXTS = ("Apache-2.0", "Artistic", "BSD", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0")
TEMPLATES = NOTICES + tuple((f"{name}-full", pkgutil.get_data(f"{__package__}.licenses", f"{name}.txt").decode("utf-8", "replace")) for name in FULL_TEXTS)
MIN_COVERAGE = 0.8
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, in order of their first parts, whose second parts increase."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        if at == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[at], ends[at] = b, i
        back[i] = ends[at - 1] if at else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of ``a`` and ``b``, increasing in both. Gaps are taken from a stack, so depth has no bound."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = _increasing([(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at])
        if not anchors:
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def _dense(words: list[bytes], need: Counter, span: int, least: float) -> list[list[int]]:
    """Merged stretches of ``words`` in which some ``span`` words hold at least ``least`` of the needed ones."""
    marks = [i for i, w in enumerate(words) if w in need]
    have, common, first, out = Counter(), 0, 0, []
    for i in marks:
        have[words[i]] += 1
        common += have[words[i]] <= need[words[i]]
        while marks[first] <= i - span:
            w = words[marks[first]]
            common -= have[w] <= need[w]
            have[w] -= 1
            first += 1
        if common >= least:
            if out and marks[first] < out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([marks[first], i + 1])
    return out


def _placed(words: list[bytes], lo: int, hi: int, own: list[bytes], need: Counter, at: dict[bytes, list[int]], least: float) -> tuple[int, int, int] | None:
    """(aligned words, first, end) of the notice in words[lo:hi] at the place that most words vote for, or None.

    A word votes for the place where the template would begin. A place is aligned by itself and with room for
    insertions; of these, the alignment with the most words for its span is taken. Of places with equal votes the one
    nearest to the middle comes first, so that what is left on its two sides halves, and many copies of a notice take a
    number of recounts that grows with the logarithm of theirs. Places of long templates that lie
    within a 32nd of their length share the room, so the first of them stands for all.
    """
    if sum((Counter(w for w in words[lo:hi] if w in need) & need).values()) < least:
        return None
    unit, tried = max(1, len(own) // 32), set()
    votes = Counter(i - j for i in range(lo, hi) for j in at.get(words[i], ()))
    middle = (lo + hi - len(own)) // 2
    for place, _ in sorted(votes.items(), key=lambda x: (-x[1], abs(x[0] - middle), x[0])):
        if place // unit in tried:
            continue
        tried.add(place // unit)
        best = None
        for room in (0, len(own) // 4 + 1, len(own)):
            x, y = max(lo, place - room), min(hi, place + len(own) + room)
            part = words[x:y]
            if sum((Counter(w for w in part if w in need) & need).values()) < least:
                continue
            aligned = patience(part, own)
            first, end = (x + aligned[0][0], x + aligned[-1][0] + 1) if aligned else (x, x)
            if len(aligned) >= least and (best is None or 2 * len(aligned) - (end - first) > 2 * best[0] - (best[2] - best[1])):
                best = (len(aligned), first, end)
        if best:
            return best
    return None


def occurrences(words: list[bytes], own: list[bytes], least: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word + 1) of each place of the template with a coverage of at least ``least``, in order.

    Places don't overlap. They are sought where the template's words stand densely, best first, and each is taken out
    before the next is sought; then what remains of each stretch without gaps of over twice the template's length is
    aligned as a whole, for notices with long insertions.
    """
    need, wanted = Counter(own), least * len(own)
    rare = min(need.values()) if len(own) > 200 else len(own)
    at: dict[bytes, list[int]] = {}
    for j, w in enumerate(own):
        if need[w] <= rare:
            at.setdefault(w, []).append(j)
    found = []
    todo = _dense(words, need, 3 * len(own), wanted)
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= wanted and (best := _placed(words, lo, hi, own, need, at, wanted)):
            found.append(best)
            todo += [[lo, best[1]], [best[2], hi]]
    taken = {i for _, first, end in found for i in range(first, end)}
    groups: list[list[int]] = []
    for i, w in enumerate(words):
        if w in need and i not in taken:
            if groups and i - groups[-1][-1] <= 2 * len(own) and not (taken and any(k in taken for k in range(groups[-1][-1] + 1, i))):
                groups[-1].append(i)
            else:
                groups.append([i])
    for group in groups:
        part = words[group[0] : group[-1] + 1]
        if sum((Counter(w for w in part if w in need) & need).values()) >= wanted:
            aligned = patience(part, own)
            if len(aligned) >= wanted:
                found.append((len(aligned), group[0] + aligned[0][0], group[0] + aligned[-1][0] + 1))
    return sorted(((n / len(own), first, end) for n, first, end in found), key=lambda x: x[1])


def scan_all(words: list[bytes], templates: list[tuple[str, list[bytes]]], least: float) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, first word, last word + 1, words of the template) of each place of each template."""
    found, held = [], None
    for name, own in templates:
        if len(words) < least * len(own):
            continue
        if held is None:
            held = set(words)
        if sum(w in held for w in own) < least * len(own):
            continue
        found += [(name, *place, len(own)) for place in occurrences(words, own, least)]
    return found


def best_of(found: list[tuple[str, float, int, int, int]]) -> tuple[str | None, float, int, int]:
    """The place with the largest coverage; of equals that of the longest template, then the first by name and place."""
    return min(found, key=lambda x: (-x[1], -x[4], x[0], x[2]))[:4] if found else (None, 0.0, 0, 0)


def scan_words(words: list[bytes], templates: list[tuple[str, list[bytes]]], least: float) -> tuple[str | None, float, int, int]:
    """(name, coverage, first word, last word + 1) of the best place of any template, see ``best_of``."""
    return best_of(scan_all(words, templates, least))


_PLACES = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def _scan(templates: list[tuple[str, list[bytes]]], least: float, names: list[str]):

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                found = scan_all(words, templates, least)
                places = [dict(zip(("license", "coverage", "first_word", "end_word"), x)) for x in sorted(found, key=lambda x: (x[2], x[0]))]
                rows.append((*best_of(found), len(words), places))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), _PLACES)))], names)

    return run


def scan(docs: DataFrame, templates=TEMPLATES, least: float = MIN_COVERAGE, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all by default) of each row of ``docs``, and license, coverage, first_word, end_word, n_words, places.

    places holds each place of each template with a coverage of at least ``least``, by first word and name; those of
    different templates may overlap, as with licenses that differ by a word. license is the template with the largest coverage, if that is at least ``least``, else null with coverage 0. Texts
    are taken whole; a null text has no words. Rows that repeat come back as often as they come in; an empty table gives an
    empty one. Templates without words are left out. A template is aligned only where
    enough of its words occur at all, which coverage implies. Result columns replace columns with their names.
    """
    bound_batches(docs.sparkSession)
    results = ["license", "coverage", "first_word", "end_word", "n_words", "places"]
    own = sorted(((name, words_of(text.encode())) for name, text in templates), key=lambda x: (-len(x[1]), x[0]))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"), "license string, coverage double, first_word bigint, end_word bigint, n_words bigint, places array<struct<license: string, coverage: double, first_word: bigint, end_word: bigint>>"])
    return rows.mapInArrow(_scan([x for x in own if x[1]], least, [*kept, *results]), schema)
