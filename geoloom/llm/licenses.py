"""License scans by patience alignment of whole texts with notice templates.

Words that are unique in both a stretch of text and a template are anchors; the longest run of anchors that ascends in both
is taken, and the gaps between anchors are aligned in the same way. A gap without anchors is matched from its two ends.
Coverage is the share of the template's words that are aligned. Only words that licenses share may be missing: those that
name a license or its version, worked out from the whole template set, must be aligned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8
SHORT = 20  # words below which a template's names must be aligned; longer notices are told apart by their own wording
# Texts of public license notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
                   "copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to "
            "deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or "
            "sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                "Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                "Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
            "notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
                "obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.",
                 "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                 "your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.",
                 "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
                 "your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.",
                 "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                 "your option) any later version."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Released under CC0 1.0.", "Released under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
}
# Short lines of licenses above, in the words that texts use for them.
for _name, _texts in {
    "MIT": ["This project is licensed under the terms of the MIT License."],
    "BSD": ["Licensed under the BSD License.", "Released under the BSD License."],
    "GPL-3.0": ["Licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3."],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "ISC": ["Licensed under the ISC License.", "Released under the ISC License."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Apache-2.0": ["Released under the Apache License 2.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License."],
}.items():
    TEMPLATES[_name] += _texts
for _name, _texts in TEMPLATES.items():
    _ids = [f"BSD-{n}-Clause" for n in (2, 3)] if _name == "BSD" else [_name] + [_name + end for end in ("-only", "-or-later") if "GPL" in _name]
    _texts += [f"SPDX-License-Identifier: {i}" for i in _ids] + ([f"Licensed under {_name}."] if _name.startswith("CC-") else [])
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
_WRITTEN = re.compile(_WORD.pattern, re.I)
SCHEMA = "doc_id long, license string, coverage double, n_matched long, first_word long, last_word long, n_notices long"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def naming_words(templates: dict[str, list[str]], coverage: float) -> list[set[str]]:
    """Of each template, in order, the words that tell its license from others; a notice must have them all.

    They are its words with a digit; the words in which it differs from a template of another license that covers it; and in
    a template below SHORT words those written with a capital inside it, unless half of all licenses or more have them.
    """
    every = [(name, t, words_of(t)) for name, texts in templates.items() for t in texts]
    holders: dict[str, set[str]] = {}
    for name, _, words in every:
        for w in words:
            holders.setdefault(w, set()).add(name)
    out = []
    for name, text, words in every:
        need = {w for w in words if any(c.isdigit() for c in w)}
        if len(words) < SHORT:
            inside = [w.lower() for w in _WRITTEN.findall(text) if w != w.lower()][text[:1].isupper():]
            need |= {w for w in inside if len(holders[w]) == 1 or 2 * len(holders[w]) < len(templates)}
        for other, _, theirs in every:
            if other != name and len(theirs) >= coverage * len(words) - 1e-9:
                pairs = align(theirs, words)
                if coverage * len(words) - 1e-9 <= len(pairs) < len(words):
                    need |= set(words) - {words[j] for _, j in pairs}
        out.append(need)
    return out


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, in order of their first numbers, whose second numbers ascend."""
    piles, tops, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(piles, b)
        back.append(tops[k - 1] if k else -1)
        piles[k:k + 1], tops[k:k + 1] = [b], [i]
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (text, template), ascending in both. Equal words at equal places always align."""
    out, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once: dict[str, int] = {}
        for i in range(a, b):
            once[text[i]] = -1 if text[i] in once else i
        here: dict[str, int] = {}
        for j in range(c, d):
            here[template[j]] = -1 if template[j] in here else j
        anchors = ascending(sorted((i, here[w]) for w, i in once.items() if i >= 0 and here.get(w, -1) >= 0))
        if anchors:
            edges = [(a - 1, c - 1), *anchors, (b, d)]
            out += anchors
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """The templates, prepared: each has the words by which stretches of text are found that may hold it."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE):
        self.all = [(name, words_of(t)) for name, texts in templates.items() for t in texts]
        self.names = naming_words(templates, coverage)
        common = set("a an and any are as at be by for if in is it may not of on or that the this to was with you".split())
        # A stretch that covers the template has all but a few of its words, hence one of the longest of these.
        self.marks = []
        self.least = [math.ceil(coverage * len(words) - 1e-9) for _, words in self.all]  # words that make a notice
        for (_, words), least in zip(self.all, self.least):
            spare = len(words) - least
            marks, left = [], sorted({w for w in words if w not in common}, key=lambda w: (words.count(w), -len(w), w))
            while left and sum(words.count(w) for w in marks) <= spare:
                marks.append(left.pop(0))
            self.marks.append(set(marks) if sum(words.count(w) for w in marks) > spare else set(words))
        self.any_mark = set().union(*self.marks) if self.marks else set()

    def scan(self, text: str):
        """(license, coverage, matched words, first word, last word, whether it has all naming words) of every stretch of a text that covers a template."""
        words = words_of(text)
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.any_mark:
                at.setdefault(w, []).append(i)
        for (name, template), marks, least, needed in zip(self.all, self.marks, self.least, self.names):
            places, size = sorted(i for w in marks for i in at.get(w, ())), len(template)
            done = -1
            for place in places:
                if place <= done:
                    continue
                low, high = max(done + 1, place - size - size // 4), min(len(words), place + size + size // 4 + 1)
                pairs = self.nearest(align(words[low:high], template), size)
                named = needed <= {template[j] for _, j in pairs}
                if not named and len(pairs) >= least:
                    pairs, named = self.by_name(words[low:high], template, needed, least) or (pairs, named)
                if pairs and len(pairs) >= least:
                    yield name, len(pairs) / size, len(pairs), low + pairs[0][0], low + pairs[-1][0], named
                    done = low + pairs[-1][0] if named else place

    def notices(self, text: str):
        """scan() with all naming words, without notices whose place a better one holds: licenses share phrases, so a text comes near to several."""
        starts, ends = [], []
        for notice in sorted((n[:5] for n in self.scan(text) if n[5]), key=lambda x: (-x[1], -x[2], x[3], x[0])):
            first, last = notice[3:]
            k = bisect_left(starts, first)
            if (k and ends[k - 1] >= first) or (k < len(starts) and starts[k] <= last):
                continue
            starts.insert(k, first)
            ends.insert(k, last)
            yield notice

    @classmethod
    def by_name(cls, text, template, needed, least):
        """The alignment with all naming words where another notice near by has drawn away the first one: held fast at one of these words."""
        name = min(needed, key=lambda w: (template.count(w), w))
        for p in (i for i, w in enumerate(text) if w == name):
            for j in (i for i, w in enumerate(template) if w == name):
                after = [(p + 1 + a, j + 1 + b) for a, b in align(text[p + 1:], template[j + 1:])]
                pairs = cls.nearest([*align(text[:p], template[:j]), (p, j), *after], len(template))
                if len(pairs) >= least and needed <= {template[b] for _, b in pairs}:
                    return pairs, True
        return None

    @staticmethod
    def nearest(pairs, size):
        """Aligned words that stand together: those at the ends are dropped while they are farther off than the template is long."""
        while pairs and pairs[-1][0] - pairs[0][0] > size + size // 4:
            middle = pairs[len(pairs) // 2][0]
            pairs = pairs[1:] if middle - pairs[0][0] > pairs[-1][0] - middle else pairs[:-1]
        return pairs


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Per document (doc_id, text) and license found: best coverage, matched words, place (first and last word), notices.

    A text that lacks a word that names the license or its version is no notice of it, however much of the rest it has. A license's place is that of its best notice, the first of equal ones; where notices overlap, only the best counts. Null and empty texts have no rows; rows with null or repeated
    ids are scanned each; other columns are not read.
    """
    scanner = Scanner(templates, coverage)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found: dict[str, list] = {}
                for name, *notice in scanner.notices(text or ""):
                    found.setdefault(name, []).append(notice)
                for name, notices in sorted(found.items()):
                    rows.append((doc_id, name, *max(notices, key=lambda x: (x[0], x[1], -x[2])), len(notices)))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.float64()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
