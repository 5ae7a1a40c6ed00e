"""License scans by patience alignment.

Words that are rare outside a template point to places in a text that may hold it. There, words that occur once in the
text and once in the template are anchors; their longest increasing subsequence is kept, and the gaps between anchors are
aligned in the same way. The share of a template's words that are aligned is its coverage. A match has a coverage of at
least ``least``. Parts of a template that stand apart, whatever lies between them, are joined if they continue one another
in its order and each adds at least ``PIECE`` aligned words; coverage is then that of the parts aligned as one. A joined
match holds at most one part that is a match by itself, so copies stay apart. Of matches that overlap, the one with the higher coverage stays, then the one with more words.

Words are runs of ASCII letters, digits and bytes beyond ASCII, in lower case (A-Z). The whole text is searched, for the
notices and openings below and for the whole texts of licences in the folder ``templates`` beside this file. A template is
aligned only where a text has half of its different rare words, which is counted for all templates at once.

Defined results: a null or empty text has no match, nor has an empty template; equal matches resolve by template name;
rows that repeat an id each give their matches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Words, column, scan, texts

#: Notices and openings of common licences, as published with them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
}


@lru_cache(1)
def templates() -> dict[str, str]:
    """The notices above, and the whole texts that come with this package (their files' names are the licences')."""
    return TEMPLATES | {f"{p.stem}{'' if p.stem.endswith('notice') else '-text'}": p.read_text() for p in sorted((Path(__file__).parent / "templates").glob("*.txt"))}


#: Words too common to point to a template.
COMMON = frozenset("a all an and any are as at be by for from in is it of on or see shall that the this to under use with without you your not may no can either".split())
LEAST, PIECE = 0.8, 4
_APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first, whose second increases (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        if p == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[p], piles[p] = y, i
        back.append(piles[p - 1] if p else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Increasing pairs of places with equal words: ends that agree, then anchors unique to both, then the gaps between."""
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
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if cb[b[j]] == 1}
        anchors = _longest([(i, at[a[i]]) for i in range(a0, a1) if ca[a[i]] == 1 and a[i] in at])
        if not anchors:
            continue
        out += anchors
        x, y = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
        w = Words(data, np.array([0, len(data)]), _APART)
        self.name, self.hashes = name, w.hashes().tolist()
        words = [data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)]
        rare = {h for h, x in zip(self.hashes, words, strict=True) if x not in COMMON}
        self.rare = rare or set(self.hashes)


def _joined(hashes: np.ndarray, t: Template, own: list[int], found: list, least: float) -> list[tuple[str, float, int, int, int]]:
    """Matches of t made of several parts. own: places of its rare words; found: its matches in one part."""
    n = len(t.hashes)
    reach = max(4, n // 4)
    parts, start = [(m[3], m[4], True) for m in found], 0
    for end in range(1, len(own) + 1):
        if end == len(own) or own[end] - own[end - 1] > reach:
            left = [i for i in own[start:end] if all(not m[3] <= i < m[4] for m in found)]
            if left:  # what a match in one part has of a run stays with it
                parts.append((left[0], left[-1] + 1, False))
            start = end
    # A run that goes on to both sides of a match is cut by it.
    for m in found:
        parts = [x for a, b, w in parts for x in ([(a, m[3], w), (m[4], b, w)] if not w and a < m[3] and b > m[4] else [(a, b, w)])]
    parts.sort()
    pieces, floor = [], 0
    for k, (a, b, whole) in enumerate(parts):
        if not whole:  # common words about the rare ones belong to them, up to the next part
            a = max(floor, a - reach)
            b = min(b + reach, parts[k + 1][0] if k + 1 < len(parts) else len(hashes))
        floor = b
        places = list(range(a, b))
        pairs = align(hashes[a:b].tolist(), t.hashes)
        if len(pairs) >= PIECE:
            pieces.append((places, pairs, whole))
    out, used = [], set()
    for i, (places, pairs, whole) in enumerate(pieces):
        if i in used:
            continue
        members = [i]
        for j in range(i + 1, len(pieces)):
            if len(pairs) == n or (whole and pieces[j][2]):
                break
            more = align(hashes[places + pieces[j][0]].tolist(), t.hashes)
            if len(more) >= len(pairs) + PIECE:
                places, pairs, whole = places + pieces[j][0], more, whole or pieces[j][2]
                members.append(j)
        if len(members) > 1 and len(pairs) >= least * n:
            used.update(members)
            out.append((t.name, len(pairs) / n, len(pairs), places[pairs[0][0]], places[pairs[-1][0]] + 1))
    return out


class Index:
    """Which templates a rare word belongs to."""

    def __init__(self, templates: list[Template]):
        pairs = sorted((h, k) for k, t in enumerate(templates) for h in t.rare)
        key, self.owner = np.array([h for h, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64)
        self.rare, first = np.unique(key, return_index=True)
        self.first = np.append(first, len(key))
        self.templates, self.least = templates, np.array([0.5 * len(t.rare) for t in templates])

    def able(self, found: np.ndarray) -> list[Template]:
        """The templates of whose different rare words at least half are among found (distinct, all rare)."""
        at = np.searchsorted(self.rare, found)
        begin, times = self.first[at], self.first[at + 1] - self.first[at]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin, times)
        return [self.templates[k] for k in np.flatnonzero(np.bincount(self.owner[place], minlength=len(self.templates)) >= self.least)]


def matches(hashes: np.ndarray, index: Index, least: float) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, aligned words, first word, word after the last) in one text."""
    hits = np.flatnonzero(np.isin(hashes, index.rare))
    able = index.able(np.unique(hashes[hits])) if len(hits) else []
    found, words = [], hashes[hits].tolist() if able else []
    for t in able:
        own = [int(hits[i]) for i, h in enumerate(words) if h in t.rare]
        n, before = len(t.hashes), len(found)
        at = floor = 0  # floor: the end of the match before
        while at < len(own):  # places that lie close together
            end = at + 1
            while end < len(own) and own[end] - own[end - 1] <= max(4, n // 4):
                end += 1
            group = own[at:end]
            at = end
            # A long run of such words is searched in overlapping parts, so that words can be unique in them.
            x = 0
            while x < len(group):
                first = group[x]
                y = bisect_left(group, first + 2 * n)
                inside = group[x:y]
                if len({int(hashes[i]) for i in inside}) >= 0.5 * len(t.rare):
                    lo, hi = max(floor, first - n), min(len(hashes), inside[-1] + n + 1)
                    pairs = align(hashes[lo:hi].tolist(), t.hashes)
                    if len(pairs) >= least * n:
                        # Words far from the others were met by chance.
                        core = [p for p in pairs if first - n // 2 - 2 <= p[0] + lo <= inside[-1] + n // 2 + 2]
                        if len(core) >= least * n:
                            found.append((t.name, len(core) / n, len(core), core[0][0] + lo, core[-1][0] + lo + 1))
                            floor = found[-1][4]
                if floor > first:
                    x = bisect_left(group, floor)
                elif y >= len(group):
                    break
                else:
                    x = max(x + 1, bisect_left(group, first + n))
        if len({w for w in words if w in t.rare}) >= 0.5 * len(t.rare):
            found += _joined(hashes, t, own, found[before:], least)
    kept: list[tuple[str, float, int, int, int]] = []
    for m in sorted(set(found), key=lambda m: (-m[1], -m[2], m[3], m[0])):
        if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


def license_matches(docs: DataFrame, known: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Matches in the rows of docs (doc_id, text): doc_id, license, coverage, aligned, start, end (words of the text). known:
    the templates by name, else all of this package's."""
    named = sorted((templates() if known is None else known).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([t for t in (Template(*x) for x in named) if t.hashes])
        for batch in batches:
            ids, rows = column(batch, "doc_id").to_pylist(), []
            for a, b, data, bounds in texts(column(batch, "text")):
                w = Words(_LOWER[data], bounds, _APART)
                h = w.hashes()
                some = np.unique(np.searchsorted(w.first, np.flatnonzero(np.isin(h, index.rare)), side="right") - 1)
                for i in some.tolist():
                    rows += [(ids[a + i], *m) for m in matches(h[w.first[i] : w.first[i + 1]], index, least)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "license", "coverage", "aligned", "start", "end"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, aligned long, start long, end long")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(scan(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES: dict[str, str] = {}
