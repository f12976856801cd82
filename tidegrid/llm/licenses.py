"""License scans by patience alignment of texts with license templates.

A text and a template are aligned on the words that occur exactly once in both: of these anchors the longest
increasing subsequence stays, equal words beside an anchor join it, and the gaps between are aligned in the same way,
where words that were not unique before may be so. The coverage of a template is the share of its words that are
aligned within a stretch of the text that is at most STRETCH times as long; the span runs from the first to the last
aligned word.

Templates are a bounded list and go to every task; texts are scanned in place, whole, without any shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

COVERAGE, STRETCH = 0.8, 2.0

# The notices that declare a license and its version, and the full text of short licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "bsd": "Released under the BSD License.",
    "bsd-2-clause": "Released under the BSD 2-Clause License.",
    "bsd-3-clause": "Released under the BSD 3-Clause License.",
    "bsd-2-clause-text": (_BSD := "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "bsd-3-clause-text": _BSD + (_ENDORSE := " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-4-clause-text": _BSD + " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization." + _ENDORSE,
    "cc0-1.0": "Licensed under CC0 1.0 Universal.",
    "mpl-1.1": "Licensed under the Mozilla Public License, version 1.1.",
    "mpl-1.1-header": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "mpl-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-1.0": "Licensed under the Eclipse Public License, version 1.0.",
    "epl-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words that tell a license from its kin: each must be aligned, else the license isn't reported.
REQUIRED = {
    "apache-1.1": "apache 1.1",
    "apache-2.0": "apache 2.0",
    "apache-2.0-header": "apache 2.0",
    "bsd": "bsd",
    "bsd-2-clause": "bsd 2-clause",
    "bsd-3-clause": "bsd 3-clause",
    "bsd-3-clause-text": "endorse",
    "bsd-4-clause-text": "advertising endorse",
    "cc0-1.0": "cc0 1.0",
    "epl-1.0": "eclipse 1.0",
    "epl-2.0": "eclipse 2.0",
    "isc": "appear",
    "mit": "mit",
    "mpl-1.1": "mozilla 1.1",
    "mpl-1.1-header": "mozilla 1.1",
    "mpl-2.0": "mozilla 2.0",
    "mpl-2.0-header": "mozilla 2.0",
    "unlicense": "unencumbered",
}
for _name, _kind, _versions in (("gpl", "", ("1", "2", "3")), ("lgpl", "Lesser ", ("2.1", "3")), ("lgpl", "Library ", ("2",)), ("agpl", "Affero ", ("1", "3"))):
    for _v in _versions:
        _key = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES[_key] = f"This work is licensed under the GNU {_kind}General Public License, version {_v}."
        TEMPLATES[_key + "-header"] = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
        REQUIRED[_key] = REQUIRED[_key + "-header"] = f"gnu {_kind}general public {_v}".lower()
for _name, _long in (("by", ""), ("by-sa", "-ShareAlike"), ("by-nd", "-NoDerivatives"), ("by-nc", "-NonCommercial"), ("by-nc-sa", "-NonCommercial-ShareAlike"), ("by-nc-nd", "-NonCommercial-NoDerivatives")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _key = f"cc-{_name}-{_v}"
        TEMPLATES[_key] = f"Licensed under CC {_name.upper()} {_v}."
        TEMPLATES[_key + "-long"] = f"This work is licensed under a Creative Commons Attribution{_long} {_v} International License."
        REQUIRED[_key], REQUIRED[_key + "-long"] = f"{_name} {_v}", f"attribution{_long} {_v}".lower()

_word = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


_version = re.compile(r"v?(\d+)(?:\.0)*")


def words_of(text: str) -> list[str]:
    """Words in lower case; versions without v and final .0, so that 3, v3 and 3.0 are equal."""
    return [m[1] if w[-1] <= "9" and (m := _version.fullmatch(w)) else w for w in _word.findall(text.lower())]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of the first number) whose second numbers increase, by patience sorting."""
    piles: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(piles, b)
        back.append(tops[at - 1] if at else -1)
        if at == len(piles):
            piles.append(b)
            tops.append(k)
        else:
            piles[at], tops[at] = b, k
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {w: j for j in range(j0, j1) if in_b[w := b[j]] == 1}
        anchors = increasing([(i, place[w]) for i in range(i0, i1) if in_a[w := a[i]] == 1 and w in place])
        ends = [*anchors, (i1, j1)]
        if anchors:
            out += anchors
            for (x, y), (u, v) in zip([(i0 - 1, j0 - 1), *anchors], ends, strict=True):
                todo.append((x + 1, u, y + 1, v))
    return sorted(out)


def least_of(template: list[str]) -> int:
    """The fewest of its words that cover COVERAGE of a template, in whole numbers: 5 * (1 - 0.8) is below 1 in floating point."""
    return -(-len(template) * round(100 * COVERAGE) // 100)


def windows(words: list[str], template: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of a text that can hold the template: around its rarest words there, merged where they overlap.

    Copies close together leave no word of a merged stretch unique, so each place of these words also gives stretches
    of its own, from a template's length about it to STRETCH times that.
    """
    counts = Counter(words)
    shared = [w for w in dict.fromkeys(template) if w in counts]
    # A stretch covers the template if it has least_of() of its words, so one of any that are more than the rest.
    missing = len(template) - least_of(template)
    own, need, chosen = Counter(template), missing + 1, set()
    for w in sorted(set(template), key=lambda w: (counts[w] / own[w], w)):
        chosen.add(w)
        need -= own[w]
        if need <= 0:
            break
    if not chosen & set(shared):
        return
    reach, at = int(len(template) * STRETCH), [i for i, w in enumerate(words) if w in chosen]
    begin = end = None
    for i in at:
        if end is not None and i - reach <= end:
            end = i + reach
        else:
            if end is not None:
                yield max(0, begin), min(len(words), end)
            begin, end = i - reach, i + reach
    if end is not None:
        yield max(0, begin), min(len(words), end)
    if len(at) < 2:
        return
    size, least, known, seen = len(template), len(template) - missing, set(template), set()
    places = {w: [j for j, x in enumerate(template) if x == w] for w in chosen}
    for i in at:
        for j in places[words[i]]:
            for more in (0, size // 4, int(size * (STRETCH - 1) / 2)):
                a, z = max(0, i - j - more), min(len(words), i - j + size + more)
                if (a, z) not in seen:
                    seen.add((a, z))
                    if sum(w in known for w in words[a:z]) >= least:
                        yield a, z


def stretches(words: list[str], template: list[str], required: frozenset[str] = frozenset()) -> Iterator[tuple[float, int, int]]:
    """(coverage, first word, one past the last word) of the best aligned stretch of each window, with all required words."""
    for a, z in windows(words, template):
        pairs = align(words[a:z], template)
        # Of the aligned places, the stretch of bounded length that holds most; ties go to the first.
        found, reach, low = (0.0, 0, 0), len(template) * STRETCH, 0
        for high in range(len(pairs)):
            while pairs[high][0] - pairs[low][0] >= reach:
                low += 1
            cover = (high - low + 1) / len(template)
            if cover > found[0] and required.issubset(template[j] for _, j in pairs[low : high + 1]):
                found = (cover, a + pairs[low][0], a + pairs[high][0] + 1)
        yield found


def licenses_of(words: list[str], known: dict[str, tuple[list[str], frozenset[str]]], coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, one past the last word) of the best stretch of each license.

    Of stretches that overlap, the one with most aligned words counts, then the best covered, the first, the shortest.
    """
    found = set()
    for name, (template, required) in known.items():
        for cover, a, z in stretches(words, template, required):
            if cover >= coverage:
                found.add((-round(cover * len(template)), -cover, a, z, name))
    spans: list[tuple[int, int]] = []
    out: dict[str, tuple[str, float, int, int]] = {}
    for _, cover, a, z, name in sorted(found):
        at = bisect_left(spans, (z, -1))
        # Kept spans don't overlap, so only the one before z can reach into this one.
        if at == 0 or spans[at - 1][1] <= a:
            insort(spans, (a, z))
            out.setdefault(name, (name, -cover, a, z))
    return [out[name] for name in known if name in out]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per document and template that covers it: doc_id, license, coverage (rounded to 6 places), first_word, end_word.

    Where stretches of several templates overlap, only the one with most aligned words is reported. The words of
    REQUIRED must be aligned if templates is None; own templates have none.

    The whole text is scanned; null counts as empty and covers nothing; repeated rows give repeated rows; empty docs
    give none; further columns are ignored. A stretch needs as much coverage as asked for; less than COVERAGE is an error,
    as candidates are looked for by COVERAGE.
    """
    if coverage < COVERAGE:
        raise ValueError(f"coverage of at least {COVERAGE}")
    known = {name: (words_of(t), frozenset(words_of(REQUIRED.get(name, "") if templates is None else ""))) for name, t in (TEMPLATES if templates is None else templates).items()}
    known = {name: t for name, t in known.items() if t[0]}
    # A text without enough of a template's words can't be covered: a cheap test before any alignment.
    vocabulary = {name: (Counter(t), least_of(t), required) for name, (t, required) in known.items()}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id.astype(object).where(b.doc_id.notna(), None), b.text, strict=True):
                words = words_of(text)
                distinct = set(words)
                some = {}
                for name, (counts, least, required) in vocabulary.items():
                    if required <= distinct and sum(n for w, n in counts.items() if w in distinct) >= least:
                        some[name] = known[name]
                if some:
                    rows += [(doc_id, name, round(cover, 6), first, end) for name, cover, first, end in licenses_of(words, some, coverage)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "first_word", "end_word"])
            yield out.assign(doc_id=pd.array([r[0] for r in rows], "Int64"))

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, license string, coverage double, first_word long, end_word long")
