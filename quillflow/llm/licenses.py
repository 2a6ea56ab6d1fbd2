"""Operator 8: license texts and notices in documents, by MinHash bands over overlapping windows.

Texts are words, shingles are pairs of neighbouring words. Templates are grouped by length into window widths, a
quarter apart; over every document, windows of each width slide by an eighth of it (by one word below 16), and a last
window ends with the text. A window's MinHash signature is a sliding minimum of K hashes, built by doubling, so all
widths share the work. Signatures in BANDS bands of ROWS look up the templates of that width. Band settings: a window
with Jaccard similarity s to a template meets it with probability 1 - (1 - s**2)**10: 0.94 at 0.5, 0.99 at 0.6, 0.999 at
0.7; a template that lies whole in a text has a window of 0.7 or more, and several of less.

Candidates are verified by exact shingle containment: the share of the template's distinct shingles in the window,
CONTAINMENT at least. Of overlapping matches in a document the one with the most shingles matched stays, then that of
the greater share, then the earlier. The templates are part of the program: notices, standard headers and characteristic
paragraphs, not the full texts of licenses, which are found by such a paragraph; templates takes others. Nothing grows
with the data, and there is no shuffle.

Defined results: null and empty texts, and those shorter than any template, match nothing; repeated rows match again; a
null doc_id stays null. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import spread
from .textcore import Words, chunks, mix, map_batches

BANDS, ROWS, CONTAINMENT = 10, 2, 0.8
K = BANDS * ROWS
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 64, K, dtype=np.uint64, endpoint=False) | _U(1)

#: Public notices and standard headers.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("reserved", "All rights reserved."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
)


def widths(longest: int) -> list[int]:
    """Window widths in words, each a quarter more than the last, up to the first that holds the longest template."""
    out = [3]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


def pair_hashes(words: Words) -> np.ndarray:
    """The hash of each word with the next; that of a text's last word means nothing."""
    h = words.hashes
    return mix(h[:-1] * _U(0x9E3779B97F4A7C15) + (h[1:] ^ _U(0x2545F4914F6CDD1D))) if len(h) > 1 else np.zeros(0, _U)


def minima(pairs: np.ndarray) -> list[np.ndarray]:
    """K 32-bit hashes of every pair."""
    return [((pairs * m) >> _U(32)).astype(np.uint32) for m in _MULTIPLIERS]


def band_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x.astype(_U) << _U(32)) | y


class Library:
    """Templates by window width: their shingle sets, and for each band a filter and a table of its keys."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in templates]
        words = next(chunks(pa.array([text for _, text in templates], pa.large_string()), limit=1 << 62)).words()
        if words.counts.min(initial=3) < 3:
            raise ValueError("a template needs three words")
        self.widths = widths(int(words.counts.max(initial=3)))
        pairs = pair_hashes(words)
        self.sets: list[frozenset[int]] = []
        self.sizes = words.counts
        self.least: dict[int, int] = {}  # distinct shingles of a width's smallest template
        self.tables: dict[int, list[tuple[np.ndarray, dict[int, list[int]]]]] = {}
        for i, n in enumerate(words.counts.tolist()):
            own = pairs[words.first[i] : words.first[i] + n - 1]
            self.sets.append(frozenset(own.tolist()))
            width = next(w for w in self.widths if w >= n)
            self.least[width] = min(self.least.get(width, n), len(self.sets[i]))
            bands = self.tables.setdefault(width, [(np.zeros(1 << 16, bool), defaultdict(list)) for _ in range(BANDS)])
            least = [h.min() for h in minima(own)]
            for b, (seen, table) in enumerate(bands):
                key = band_key(np.array([least[2 * b]]), np.array([least[2 * b + 1]]))
                seen[self.place(key)] = True
                table[int(key[0])].append(i)

    @staticmethod
    def place(keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(48)).astype(np.int64)

    def lookup(self, width: int, least: list[np.ndarray]) -> list[tuple[int, int]]:
        """(window, template) of windows of that width, given their K minima, that share a band."""
        found = set()
        for b, (seen, table) in enumerate(self.tables[width]):
            keys = band_key(least[2 * b], least[2 * b + 1])
            for i in np.flatnonzero(seen[self.place(keys)]).tolist():
                found.update((i, t) for t in table.get(int(keys[i]), ()))
        return sorted(found)


@lru_cache(maxsize=2)
def library(templates: tuple[tuple[str, str], ...]) -> Library:
    return Library(templates)


def windows(words: Words, width: int) -> np.ndarray:
    """First words of the windows of a width that lie in a text."""
    left = words.first[words.row + 1] - np.arange(len(words.row))
    at = np.arange(len(words.row)) - words.first[words.row]
    return np.flatnonzero((left >= width) & ((at % max(1, width // 8) == 0) | (left == width)))


def matches(words: Words, lib: Library, containment: float = CONTAINMENT) -> list[tuple[int, int, int, int, float]]:
    """(row, template, first word, last word, containment) of the matches that stay."""
    pairs = pair_hashes(words)
    if not len(pairs):
        return []
    level, reach = minima(pairs), 1
    found: dict[int, list[tuple]] = defaultdict(list)
    for width in lib.widths:
        span = width - 1  # pairs in a window
        while 2 * reach <= span:
            level = [np.minimum(x[: len(x) - reach], x[reach:]) if len(x) > reach else x[:0] for x in level]
            reach *= 2
        if width not in lib.tables:
            continue
        if width < 16:  # a window at every word: no selection before the lookup, and those that cross texts go after it
            more = max(0, len(pairs) - span + 1)
            least = [np.minimum(x[:more], x[span - reach : span - reach + more]) for x in level]
            candidates = [(i, width, t) for i, t in lib.lookup(width, least) if words.row[i] == words.row[i + span]]
        else:
            begin = windows(words, width)
            least = [np.minimum(x[begin], x[begin + span - reach]) for x in level]
            candidates = [(int(begin[i]), width, t) for i, t in lib.lookup(width, least)]
        # texts shorter than the window are one window each, if they have as many shingles as any template asks for
        short = np.flatnonzero((words.counts < width) & (words.counts >= 2) & (words.counts - 1 >= containment * lib.least[width] - 1e-9))
        if len(short):
            a, size = words.first[short], words.counts[short] - 1
            bounds = np.cumsum(size) - size
            own = pairs[np.repeat(a - bounds, size) + np.arange(int(size.sum()))]
            whole = [np.minimum.reduceat(h, bounds) for h in minima(own)]
            candidates += [(int(a[i]), int(words.counts[short[i]]), t) for i, t in lib.lookup(width, whole)]
        for start, n, t in candidates:
            own = pairs[start : start + n - 1].tolist()
            share = len(lib.sets[t].intersection(own)) / len(lib.sets[t])
            if share >= containment:
                hit = [i for i, x in enumerate(own) if x in lib.sets[t]]
                matched = share * len(lib.sets[t])
                found[int(words.row[start])].append((-matched, -share, start + hit[0], start + hit[-1] + 1, t, share))
    out = []
    for row, some in sorted(found.items()):
        taken: list[tuple[int, int]] = []
        for _, _, a, b, t, share in sorted(set(some)):
            if all(b < x or a > y for x, y in taken):
                taken.append((a, b))
                out.append((row, t, a, b, share))
    return out


def _rows(batch: pa.RecordBatch, templates: tuple[tuple[str, str], ...], containment: float) -> Iterator[pa.RecordBatch]:
    lib = library(templates)
    for chunk in chunks(batch.column(1)):
        words = chunk.words()
        found = matches(words, lib, containment)
        ids = batch.column(0).slice(chunk.rows.start, chunk.n).take(pa.array([x[0] for x in found], pa.int64()))
        first, last = ([int(x[i] - words.first[x[0]]) for x in found] for i in (2, 3))
        columns = [ids, pa.array([lib.names[x[1]] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array([round(x[4], 6) for x in found], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "template", "first_word", "last_word", "containment"])


def license_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, template, first_word, last_word, containment) of each match; words count from 0."""
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    return map_batches(rows, partial(_rows, templates=templates, containment=containment), "doc_id long, license string, template int, first_word int, last_word int, containment double")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
