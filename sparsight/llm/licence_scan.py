"""Licence notices in whole texts, by patience alignment with templates.

Key words of a template show where in a text it may lie. Such a stretch may hold
several copies; disjoint windows are placed so that as many as possible hold one,
and each copy is aligned alone:
words unique to both sides are anchors, the longest increasing subsequence of
them is kept, and the gaps between are aligned the same way.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparsight.llm.words import LOWER_ALNUM, bounded, coded

COVERAGE = 0.8
_KEY_LETTERS = 7

#: fixed values: the notices
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
    "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places with equal words, rising on both sides."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        anchors = _rising(unique)
        if not anchors:
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends[:-1], ends[1:])]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, in which the second rises."""
    tops, piles, before = [], [], {}
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        tops[k:k + 1], piles[k:k + 1] = [j], [i]
        before[i] = piles[k - 1] if k else None
    i = piles[-1] if piles else None
    out = []
    while i is not None:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def _words(text: str) -> list[str]:
    return text.encode().translate(LOWER_ALNUM).decode().split()


def key_places(words: list[str], coverage: float = COVERAGE) -> list[int]:
    """Places of a template's key words: all long ones, and so many that a notice cannot lack them all."""
    least = min(_KEY_LETTERS, max(map(len, words), default=0))
    order = sorted(range(len(words)), key=lambda i: (-len(words[i]), i))
    spare = len(words) - _needed(words, coverage)
    return sorted(i for k, i in enumerate(order) if len(words[i]) >= least or k <= spare)


def _needed(words: list[str], coverage: float) -> int:
    """The least number of words found in a notice."""
    n = max(1, int(coverage * len(words)))
    return n if n >= coverage * len(words) else n + 1


def in_common(words: list[str], template: list[str]) -> int:
    """The length of the longest common subsequence, all places of the template in one number."""
    at: dict[str, int] = {}
    for j, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(template)) - 1
    free = full
    for m in filter(None, map(at.get, words)):
        u = free & m
        free = (free + u | free - u) & full
    return len(template) - free.bit_count()


def placed(words: list[str], template: list[str], need: int) -> list[tuple[int, int, int]]:
    """``start, end, found`` of disjoint windows in each of which ``need`` words of the template and more are found.

    Of all such sets, one with the most windows; of these, with the most words
    found; of these, with the fewest words spanned. A window spans up to twice
    the template.
    """
    at: dict[str, int] = {}
    for j, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << j
    hits = [(i, at[w]) for i, w in enumerate(words) if w in at]
    full, reach = (1 << len(template)) - 1, 2 * len(template)
    most = {w: m.bit_count() for w, m in at.items()}
    here: Counter = Counter()
    possible, ahead = 0, 0  # words that a window from a hit on may find at most
    # of each prefix of the hits: count, words found, less words spanned; and the last window of the best set
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (len(hits) + 1)
    window: list[tuple[int, int] | None] = [None] * (len(hits) + 1)
    for s, (start, _) in enumerate(hits):
        if s and best[s] < best[s - 1]:
            best[s], window[s] = best[s - 1], None
        while ahead < len(hits) and hits[ahead][0] < start + reach:
            w = words[hits[ahead][0]]
            possible += here[w] < most[w]
            here[w] += 1
            ahead += 1
        if possible >= need:
            free, (count, words_found, spanned) = full, best[s]
            for e in range(s, ahead):
                end, mask = hits[e]
                u = free & mask
                free = (free + u | free - u) & full
                found = len(template) - free.bit_count()
                if found >= need:
                    value = (count + 1, words_found + found, spanned - (end + 1 - start))
                    if value > best[e + 1]:
                        best[e + 1], window[e + 1] = value, (s, found)
        w = words[start]
        here[w] -= 1
        possible -= here[w] < most[w]
    if hits and best[-1] < best[-2]:
        window[-1] = None
    out, k = [], len(hits)
    while k:
        if window[k] is None:
            k -= 1
            continue
        s, found = window[k]
        out.append((hits[s][0], hits[k - 1][0] + 1, found))
        k = s
    return out[::-1]


def copies(words: list[str], template: list[str], coverage: float = COVERAGE) -> list[tuple[int, int, int]]:
    """``start, end, found`` of every notice in a stretch.

    Each placed window is aligned alone, and trimmed to what patience finds
    where that is a notice. One torn over more than a window is looked for
    where none is placed.
    """
    need = _needed(template, coverage)
    if len(words) < need or in_common(words, template) < need:
        return []
    out = []
    for start, end, found in placed(words, template, need):
        pairs = patience(words[start:end], template)
        if len(pairs) >= need:
            start, end, found = start + pairs[0][0], start + pairs[-1][0] + 1, len(pairs)
        out.append((start, end, found))
    if not out:
        pairs = patience(words, template)
        if len(pairs) >= need:
            out.append((pairs[0][0], pairs[-1][0] + 1, len(pairs)))
    return out


def stretches(places: np.ndarray, offsets: np.ndarray, length: int, n: int) -> list[tuple[int, int]]:
    """Where a template of ``length`` words may lie in ``n`` words, from key words found and their places in it."""
    slack = max(4, length // 4)
    lines = np.unique(places - offsets)
    new = np.flatnonzero(np.concatenate([[True], np.diff(lines) > slack])) if len(lines) else []
    return [
        (max(0, int(part[0]) - slack), min(n, int(part[-1]) + length + slack))
        for part in np.split(lines, new[1:]) if len(part)
    ]


def notices(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
    coverage: float = COVERAGE,
) -> DataFrame:
    """``doc_id, licence, start, end, coverage``: notices of which ``coverage`` of the words stand in a text.

    ``start`` and ``end`` count words of letters and digits, the end
    exclusive. Of notices that overlap, the one with more words found stays,
    then the better covered, the earlier, and the first by name. A text may
    hold a notice many times; null and empty texts hold none.
    """
    known = {name: _words(t) for name, t in sorted((templates or TEMPLATES).items())}
    least = {name: len(key_places(w, coverage)) + _needed(w, coverage) - len(w) for name, w in known.items()}
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, list[tuple[str, int]]] = {}
        for name, words in known.items():
            for i in key_places(words, coverage):
                keys.setdefault(words[i], []).append((name, i))
        for batch in bounded(batches, "t"):
            codes, offsets, distinct = coded(batch.column("t"), LOWER_ALNUM)
            names = distinct.to_pylist()
            is_key = np.array([w in keys for w in names], bool)
            hits = np.flatnonzero(is_key[codes]) if len(names) else np.empty(0, np.int64)
            owner = np.searchsorted(offsets, hits, "right") - 1
            rows = []
            for d in np.unique(owner):
                own = hits[owner == d]
                a, b = offsets[d], offsets[d + 1]
                found: dict[str, tuple[list, list]] = {}
                for p in own:
                    for name, i in keys[names[codes[p]]]:
                        places, at = found.setdefault(name, ([], []))
                        places.append(p - a)
                        at.append(i)
                best = []
                for name, (places, at) in found.items():
                    template = known[name]
                    if len(set(at)) < least[name]:  # key words of a notice that are not among those it may lack
                        continue
                    for x, y in stretches(np.array(places), np.array(at), len(template), int(b - a)):
                        words = [names[c] for c in codes[a + x : a + y]]
                        for start, end, n in copies(words, template, coverage):
                            best.append((-n, -n / len(template), x + start, name, x + end))
                taken: list[tuple[int, int]] = []
                for _, cover, start, name, end in sorted(best):
                    k = bisect_left(taken, (start, end))
                    if (k and taken[k - 1][1] > start) or (k < len(taken) and taken[k][0] < end):
                        continue
                    taken.insert(k, (start, end))
                    rows.append((d, name, start, end, -cover))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("i").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())],
                ["doc_id", "licence", "start", "end", "coverage"],
            )

    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, licence string, start bigint, end bigint, coverage double")
