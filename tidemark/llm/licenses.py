"""License scans: winnowed fingerprints find candidates, banded alignment confirms them.

Texts and templates are sequences of words of ASCII letters, digits and all non-ASCII
characters, with ASCII letters lower-cased. Fingerprints are k-gram hashes picked by
winnowing, so any K + W - 1 words that a text shares with a template give a common one.
An inverted index holds the templates' fingerprints. Hits of one template that lie close
in the text and on close diagonals are one candidate; its stretch of text is aligned
with the template inside a band around these diagonals. A match is reported when at
least ``min_coverage`` of the template's words are matched in order.

Null and empty texts match nothing. Repeated rows report their matches each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

K, W = 3, 2
#: Words an alignment may drift from the candidate's diagonals, to either side.
BAND = 12

#: Wordings of license notices and of the openings of license texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal",
    "Unlicense-text": "This is free and unencumbered software released into the public domain",
    "All-rights-reserved": "All rights reserved",
}

_WORDS = np.full(256, 0x20, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _WORDS[_c] = _c
for _c in range(65, 91):
    _WORDS[_c] = _c + 32


def plain_words(data: np.ndarray, off: np.ndarray) -> tuple[tx.Words, np.ndarray]:
    """The words of texts and their hashes; case and punctuation don't count."""
    plain = _WORDS[data]
    w = tx.words(plain, off)
    return w, tx.word_hashes(plain, w)


def fingerprints(hashes: np.ndarray, first: np.ndarray, always: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes picked by winnowing, and all places of the k-grams ``always``; a text
    of K to K + W - 2 words gives all its k-grams."""
    grams = tx.window_hashes(hashes, K)
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, _ = tx.picks(hashes, K, W)
    at = at[tx.whole_windows(first, K + W - 1)] if len(at) else at
    count = np.diff(first)
    short = tx.ranges(first[:-1], np.where(count < K + W - 1, np.maximum(count - K + 1, 0), 0))
    found = [np.flatnonzero(grams == key) for key in always]
    found = [x[np.searchsorted(first, x, "right") == np.searchsorted(first, x + K - 1, "right")] for x in found]
    at = np.unique(np.concatenate([at, short, *found]))
    return at, grams[at]


@dataclass
class Index:
    """Templates as word hashes, and the inverted index of their fingerprints."""

    names: list[str]
    words: list[np.ndarray]
    key: np.ndarray
    template: np.ndarray
    place: np.ndarray
    #: k-grams of templates that are too short for winnowing to be sure of one.
    always: np.ndarray


def index_of(templates: dict[str, str]) -> Index:
    names, words, keys, owner, place, always = sorted(templates), [], [], [], [], []
    for i, name in enumerate(names):
        data, off = tx.bytes_of(pa.array([templates[name]]))
        w, h = plain_words(data, off)
        if len(h) < K:
            raise ValueError(f"{name}: a template needs at least {K} words")
        # All k-grams of a template are in the index: a text may hold a short piece of it only.
        grams = tx.window_hashes(h, K)
        if len(h) < K + W - 1:
            always.append(grams)
        words.append(h)
        keys.append(grams)
        owner.append(np.full(len(grams), i))
        place.append(np.arange(len(grams)))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return Index(names, words, key[order], np.concatenate(owner)[order], np.concatenate(place)[order], np.unique(np.concatenate([np.zeros(0, np.uint64), *always])))


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched, from, to): the most template words matched in order, with text place less
    template place from ``low`` to ``high``, and the text range of the matches."""
    width = high - low + 1
    best = np.zeros((len(template) + 1, width + 1), np.int32)  # one column more: nothing to the right
    for i in range(len(template)):
        j = i + low + np.arange(width)
        ok = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[ok] = text[j[ok]] == template[i]
        # Along a diagonal both move on; to the next diagonal the template alone does.
        step = np.maximum(best[i, :width] + same, best[i, 1:])
        best[i + 1, :width] = np.maximum.accumulate(step)
    d = int(best[-1, :width].argmax())
    matched, i, first, last = int(best[-1, d]), len(template), -1, -1
    while i > 0:
        if d > 0 and best[i, d - 1] == best[i, d]:
            d -= 1
        elif best[i - 1, d + 1] == best[i, d]:
            i, d = i - 1, d + 1
        else:
            j = i - 1 + low + d
            if best[i - 1, d] < best[i, d]:
                first, last = j, max(last, j)
            i -= 1
    return matched, first, last + 1


def scan(hashes: np.ndarray, first: np.ndarray, index: Index, min_coverage: float) -> list[tuple[int, int, int, int, int]]:
    """(text, template, matched, from, to) of all matches, in words of the text."""
    at, keys = fingerprints(hashes, first, index.always)
    lo, hi = np.searchsorted(index.key, keys, "left"), np.searchsorted(index.key, keys, "right")
    hit = np.flatnonzero(hi > lo)
    which = tx.ranges(lo[hit], (hi - lo)[hit])
    place = np.repeat(at[hit], (hi - lo)[hit])
    doc = np.searchsorted(first, place, "right") - 1
    template, where = index.template[which], index.place[which]
    order = np.lexsort((place, template, doc))
    found: list[tuple[int, int, int, int, int]] = []
    i, told = 0, ((-1, -1), 0)  # the last match's text and template, and where it ends
    rows = list(zip(doc[order].tolist(), template[order].tolist(), place[order].tolist(), where[order].tolist(), strict=True))
    while i < len(rows):
        d, t, p, o = rows[i]
        n = len(index.words[t])
        # One candidate: hits that one copy of the template, with gaps of the band, can hold.
        z, low, high = i, p - o, p - o
        while z < len(rows) and rows[z][:2] == (d, t) and rows[z][2] - p <= n + BAND:
            diagonal = rows[z][2] - rows[z][3]
            if max(high, diagonal) - min(low, diagonal) <= 2 * BAND:
                low, high = min(low, diagonal), max(high, diagonal)
            z += 1
        a, b = int(first[d]), int(first[d + 1])
        begin = max(a, low - BAND, told[1] if told[0] == (d, t) else 0)
        text = hashes[begin : min(b, high + BAND + n)]
        matched, s, e = align(text, index.words[t], low - BAND - begin, high + BAND - begin)
        if matched >= min_coverage * n:
            found.append((d, t, matched, begin + s - a, begin + e - a))
            told = ((d, t), begin + e)
            while z > i + 1 and rows[z - 1][2] >= begin + e:
                z -= 1
            i = z
        else:
            i += 1
            # Hits on the diagonals just tried cannot give more.
            while i < z and low <= rows[i][2] - rows[i][3] <= high:
                i += 1
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, matched_words, coverage, word_start, word_end, byte_start, byte_end):
    one row for each match; ends are exclusive."""
    index = index_of(TEMPLATES if templates is None else templates)
    names = ["doc_id", "license", "matched_words", "coverage", "word_start", "word_end", "byte_start", "byte_end"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tx.bytes_of(batch.column(1))
            ids = batch.column(0)
            for lo, hi in tx.slices(off):
                w, hashes = plain_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                found = scan(hashes, w.first, index, min_coverage)
                if not found:
                    continue
                d, t, matched, s, e = map(np.array, zip(*found, strict=True))
                base, start = off[lo + d] - off[lo], w.first[d]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(lo + d)),
                        pa.array([index.names[i] for i in t.tolist()], pa.string()),
                        pa.array(matched.astype(np.int64)),
                        pa.array(matched / np.array([len(index.words[i]) for i in t.tolist()])),
                        pa.array(s.astype(np.int64)),
                        pa.array(e.astype(np.int64)),
                        pa.array(w.start[start + s] - base),
                        pa.array(w.end[start + e - 1] - base),
                    ],
                    names=names,
                )

    return docs.select(F.col(doc_id).cast("bigint"), text).mapInArrow(
        scanned, "doc_id long, license string, matched_words long, coverage double, word_start long, word_end long, byte_start long, byte_end long"
    )
