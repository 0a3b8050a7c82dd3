"""License scans by patience alignment.

A template is aligned with every window of a text that can hold enough of its words: words that occur once in both are
anchors, the longest increasing run of anchors is kept, and the gaps between anchors are aligned in the same way. The
share of the template's words that the alignment covers decides.

A window starts at any word and is long enough for a foreign word behind every word of the template. No alignment matches a word more often than window
and template both have it; the sum of that over all words is a bound that running sums give for all windows of a batch,
and only windows whose bound reaches the coverage are aligned. So no notice is missed for where it stands or which of its
words are changed, and texts without notices cost little. Nothing is shuffled.

Defined results: one row for each place where a template is found, so none for null, empty or clean texts; of overlapping
places of one template the best counts; repeated rows give repeated results; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from leafstack.llm._common import arrow_batches, pieces, release_memory
from leafstack.llm._units import ASCII_MARKS, Units, gather, ragged

#: Notices to look for. Fixed values, quoted from the public licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-source": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "all-rights-reserved": "All rights reserved.",
}

_WORD = re.compile(r"[\w][\w.\-]*[\w]|\w")
_MARKS = ASCII_MARKS.replace("_", "")  # what no word begins or ends with


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words without case, and where they are."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def _anchors(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Words that occur once in either range, as the longest run that rises in both."""
    once: dict[str, int] = {}
    for i in range(a0, a1):
        once[a[i]] = -1 if a[i] in once else i
    there: dict[str, int] = {}
    for j in range(b0, b1):
        if b[j] in once:
            there[b[j]] = -1 if b[j] in there else j
    pairs = sorted((i, j) for w, j in there.items() if j >= 0 and (i := once[w]) >= 0)
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [j]
        at[pile : pile + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, rising in both."""
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
        found = _anchors(a, b, a0, a1, b0, b1)
        if found:
            out += found
            edges = [(a0 - 1, b0 - 1), *found, (a1, b1)]
            todo += [(x + 1, z, y + 1, w) for (x, y), (z, w) in zip(edges, edges[1:]) if x + 1 < z and y + 1 < w]
    return sorted(out)


class Scanner:
    """Templates, and where in a text enough of their words stand close together."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.names = [name for name, _ in templates]
        self.templates = [words_of(text)[0] for _, text in templates]
        self.least = least
        self.need = [max(1, ceil(least * len(t) - 1e-9)) for t in self.templates]
        self.reach = [2 * len(t) + 2 for t in self.templates]
        self.code = {w: i + 1 for i, w in enumerate(sorted({w for t in self.templates for w in t}))}
        self.times = np.zeros((len(templates), len(self.code) + 1), np.int64)
        for k, t in enumerate(self.templates):
            np.add.at(self.times[k], [self.code[w] for w in t], 1)
        self.vocabulary = pa.array(list(self.code), pa.string())

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of all texts as numbers, 0 for those that no template has, and their bounds; a word never has white space."""
        units = Units.of(texts)
        bare = pc.utf8_trim(units.dictionary, characters=_MARKS)
        simple = pc.and_(pc.utf8_is_alnum(bare), pc.invert(pc.match_substring_regex(bare, "[\u0130\u03a3]"))).to_numpy(zero_copy_only=False)
        other = [[self.code.get(w.lower(), 0) for w in _WORD.findall(u)] for u in units.dictionary.filter(pa.array(~simple)).to_pylist()]
        flat, n = ragged(other)
        lengths = simple.astype(np.int64)
        lengths[~simple] = n
        out = np.zeros(lengths.sum(), np.int64)
        one = np.repeat(simple, lengths)
        found = pc.index_in(pc.utf8_lower(bare.filter(pa.array(simple))), value_set=self.vocabulary)
        out[one], out[~one] = pc.fill_null(found, -1).to_numpy(zero_copy_only=False) + 1, flat
        return gather(out, lengths, units.codes, units.bounds)

    def likely(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, template) where some window has as many words of the template, counted with repeats, as it needs."""
        for k, (need, reach) in enumerate(zip(self.need, self.reach)):
            if len(codes) < need:
                continue
            total = np.concatenate([[0], np.cumsum(self.times[k][codes] > 0, dtype=np.int32)])
            ends = np.repeat(bounds[1:], np.diff(bounds))
            here = np.arange(len(codes))
            found = np.nonzero(total[np.minimum(here + reach, ends)] - total[:-1] >= need)[0]
            for i in np.unique(np.searchsorted(bounds, found, "right") - 1).tolist():
                yield i, k

    def starts(self, codes: np.ndarray, k: int) -> np.ndarray:
        """The first words of the windows whose bound reaches what template ``k`` needs.

        A word counts in the windows that reach it and do not hold as many of it before it as the template has.
        """
        times, reach = self.times[k], self.reach[k]
        at = np.nonzero(times[codes])[0]
        by_word = np.argsort(codes[at], kind="stable")
        own = codes[at][by_word]
        first = np.searchsorted(own, own)
        earlier = np.arange(len(at)) - times[own]
        since = np.full(len(at), -1)
        since[by_word] = np.where(earlier >= first, at[by_word][np.maximum(earlier, 0)], -1)
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, np.maximum(since, at - reach) + 1, 1)
        np.add.at(change, at + 1, -1)
        return np.nonzero(np.cumsum(change[:-1]) >= self.need[k])[0]

    def scan(self, text: str, codes: np.ndarray, k: int) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, stop) of every place of template ``k``; ``codes`` are the text's words."""
        starts = self.starts(codes, k).tolist()
        if not starts:
            return []
        template, reach = self.templates[k], self.reach[k]
        hits, words, spans = set(), *words_of(text)
        for x in starts:
            pairs = patience(template, words[x : x + reach])
            if pairs and len(pairs) / len(template) >= self.least:
                hits.add((-len(pairs), pairs[-1][1] - pairs[0][1], x + pairs[0][1], x + pairs[-1][1]))
        return [(self.names[k], round(n / len(template), 4), spans[a][0], spans[b][1]) for a, b, n in chosen(hits)]


def chosen(hits: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(first, last, matched) of places that do not overlap, in order: the best coverage first, then the shortest place.

    ``hits``: (minus the matched words, length, first word, last word).
    """
    taken: list[tuple[int, int, int]] = []
    for matched, _, first, last in sorted(hits):
        k = bisect_left(taken, (first,))
        if (not k or taken[k - 1][1] < first) and (k == len(taken) or last < taken[k][0]):
            taken.insert(k, (first, last, -matched))
    return taken


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items()), least: float = 0.75) -> Scanner:
    """One per worker process and setting."""
    return Scanner(templates, least)


def scan(text: str, templates: tuple[tuple[str, str], ...] = tuple(TEMPLATES.items()), least: float = 0.75) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, stop) of every place in ``text`` that covers at least ``least`` of a template."""
    by = scanner(templates, least)
    codes, bounds = by.codes(pa.array([text]))
    return [hit for _, k in by.likely(codes, bounds) for hit in by.scan(text, codes, k)]


def find_licenses(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, str] | None = None, least: float = 0.75) -> DataFrame:
    """Columns ``keep``, license string, coverage double, start long, stop long (code points)."""
    arrow_batches(df.sparkSession)
    df, listed = df.select(*keep, text), tuple((templates or TEMPLATES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = scanner(listed, least)
        for batch in batches:
            for b in pieces(batch, text):
                codes, bounds = by.codes(b.column(text))
                hits = [(i, *hit) for i, k in by.likely(codes, bounds) for hit in by.scan(b.column(text)[i].as_py(), codes[bounds[i] : bounds[i + 1]], k)]
                rows = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(rows) for k in keep), pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.float64()), *(pa.array([h[k] for h in hits], pa.int64()) for k in (3, 4))],
                    names=[*keep, "license", "coverage", "start", "stop"],
                )
        release_memory()

    kinds = (("license", T.StringType()), ("coverage", T.DoubleType()), ("start", T.LongType()), ("stop", T.LongType()))
    return df.mapInArrow(run, T.StructType([*(df.schema[k] for k in keep), *(T.StructField(*k) for k in kinds)]))
