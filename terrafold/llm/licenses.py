"""License scans: fingerprints of license sections pick candidates, banded alignment reports coverage and spans.

Words are compared without outer punctuation and with A-Z in lower case. A license is its whole text, cut at paragraphs
into sections of at most SECTION words; a notice or header is one of its own. A section's runs of GRAM words are hashed and
winnowed (the smallest of every WINNOW in a row), giving an inverted index from hash to (section, word). Sections of at
most SHORT words have all their runs of 2 words in it instead, as an edit leaves no more of them. All runs of
a document are looked up, so any GRAM + WINNOW - 1 words (2 for short ones) that it shares with a section meet the index. At the
first hit behind the last match the section is aligned to the document's words by dynamic programming within BAND
words of the hit's diagonal: matches count 1, other words in either are gaps. A section is found if its
matched words cover at least `coverage` of it.

Sections of a license that follow each other in a document are one match; what lies between is at most as long as the
sections left out and SLACK words (where an edit blurs the seam of two, a word there may count for both). A match reports its words against all of the license, and where in the license it begins:
the first section of MIT alone has a coverage of 0.2, its disclaimer alone is found as well. What a document holds of
a section that isn't found (less than `coverage` of it) doesn't count.

The index is a fixed table, whatever the corpus holds. Null, empty and blank texts match nothing. Texts are scanned
whole, however long; a license that occurs twice is reported twice. Rows that repeat report alike, each for itself; a null doc_id stays null.
Sections that tie for a place are taken in the order of the fixed table. Other columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH_LOWER, Words, mix64, powers, prefix_hash, row_blocks, span_hash, utf8

GRAM = 3
WINNOW = 2
BAND = 12
COVERAGE = 0.75
SECTION = 60
#: Shorter paragraphs, such as headings, go with their neighbour.
LEAST = 15
SHORT = 8
SLACK = 48

#: Licenses whose whole text is a file of license_texts.
WHOLE = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Unlicense")
#: One-line notices, headers of source files, and whole licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.\n\nYou should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
} | {name: (files(__package__) / "license_texts" / f"{name}.txt").read_text(encoding="utf-8") for name in WHOLE}


def _words(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    words = Words(raw, offsets, i, j)
    starts, ends = words.trimmed()
    return words, starts, ends, span_hash(prefix_hash(BYTE_HASH_LOWER[words.bytes]), starts, ends)


def _grams(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    weights, n = powers(0x5851F42D4C957F2D, GRAM), max(0, len(hashes) - size + 1)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * weights[k]
    return mix64(total)


def sections(text: str) -> list[str]:
    """Paragraphs in parts of near equal length; short ones go with the next, the last with the one before."""
    parts: list[list[str]] = []
    for paragraph in text.split("\n\n"):
        words = paragraph.split()
        many = -(-len(words) // SECTION)
        at = [len(words) * k // many for k in range(many + 1)] if many else [0]
        for a, b in zip(at[:-1], at[1:]):
            if parts and len(parts[-1]) < LEAST:
                parts[-1] += words[a:b]
            else:
                parts.append(words[a:b])
    if len(parts) > 1 and len(parts[-1]) < LEAST:
        parts[-2] += parts.pop()
    return [" ".join(p) for p in parts]


def _winnowed(grams: np.ndarray) -> np.ndarray:
    """Marks the grams that are the smallest of some WINNOW in a row (all, if there are fewer)."""
    keep = np.zeros(len(grams), bool)
    if len(grams) < WINNOW:
        keep[:] = True
        return keep
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINNOW)
    keep[np.arange(len(windows)) + windows.argmin(1)] = True
    return keep


class Index:
    """Words of the licenses' sections, and the inverted index of their grams."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        cut = [(t, part) for t, text in enumerate(templates.values()) for part in sections(text)]
        raw, offsets = utf8(pa.array([part for _, part in cut], pa.large_string()))
        words, _, _, hashes = _words(raw, offsets, 0, len(cut))
        self.words = [hashes[a:b].tolist() for a, b in zip(words.bounds[:-1], words.bounds[1:])]
        #: License of each section, words of the license before it, and words of each license.
        self.license = [t for t, _ in cut]
        self.total = [0] * len(self.names)
        self.offset = []
        for t, w in zip(self.license, self.words):
            self.offset.append(self.total[t])
            self.total[t] += len(w)
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, w in enumerate(self.words):
            grams = _grams(np.array(w, np.uint64), 2 if len(w) <= SHORT else GRAM)
            for k in np.flatnonzero(_winnowed(grams) | (len(w) <= SHORT)).tolist():
                self.places[int(grams[k])].append((s, k))
        self.keys = np.array(sorted(self.places), np.uint64)
        self.known: dict[tuple, tuple[int, int, int]] = {}


def align(template: np.ndarray, part: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first and last + 1 matched word of part): longest common subsequence within a band.

    Template word k lies near part word k + shift. Among best alignments the one that ends first and is shortest.
    """
    best = (0, 0, 0)
    row: dict[int, tuple[int, int]] = {}  # part word -> (matches, start) of alignments that end there or before
    for k in range(len(template)):
        new: dict[int, tuple[int, int]] = {}
        left = (0, 0)
        for x in range(max(0, k + shift - band), min(len(part), k + shift + band + 1)):
            value = max(left, row.get(x, (0, 0)))
            if template[k] == part[x]:
                before = row.get(x - 1, (0, 0))
                value = max(value, (before[0] + 1, before[1] if before[0] else x))
                if value[0] > best[0] or (value[0] == best[0] and x + 1 - value[1] < best[2] - best[1]):
                    best = (value[0], value[1], x + 1)
            new[x] = left = value
        row = new
    return best


def _sections_found(index: Index, hashes: np.ndarray, grams_at: np.ndarray, grams: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
    """(section, matched words, first and last + 1 word) in one document, from its hits on the index."""
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at, gram in zip(grams_at.tolist(), grams.tolist()):
        for s, k in index.places[gram]:
            hits[s].append((at, at - k))
    out = []
    for s, found in hits.items():
        section = index.words[s]
        done, failed = 0, None
        for at, d in found:
            if at < done or failed == d:
                continue
            a, b = max(done, d - BAND, 0), min(len(hashes), d + len(section) + BAND)
            part = hashes[a:b]
            key = (s, d - a, part.tobytes())
            if key not in index.known:
                if len(index.known) > 20_000:
                    index.known.clear()
                words = part.tolist()
                held = set(words)
                # no alignment matches more words than the part holds
                enough = sum(w in held for w in section) >= coverage * len(section)
                index.known[key] = align(section, words, d - a) if enough else (0, 0, 0)
            matched, first, end = index.known[key]
            if matched >= coverage * len(section):
                out.append((s, matched, a + first, a + end))
                done = a + end
            else:
                failed = d
    return sorted(set(out), key=lambda m: (m[2], m[0]))


def _matches(index: Index, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(license, matched words, words of the license before them, first and last + 1 word): sections in a row as one.

    Of a license's sections the row with the most matched words comes first; sections at places that it holds are left to it.
    """
    own: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for m in found:
        own[index.license[m[0]]].append(m)
    out = []
    for t, nodes in own.items():
        best: list[int] = []
        before: list[int] = []
        for s, matched, a, _ in nodes:
            top, link = 0, -1
            for x in range(len(best) - 1, -1, -1):
                s0, _, a0, b0 = nodes[x]
                if a0 < a - 2 * (index.total[t] + SLACK):
                    break
                between = index.offset[s] - index.offset[s0] - len(index.words[s0])
                if s0 < s and a0 < a and b0 - BAND <= a <= b0 + between + SLACK and best[x] > top:
                    top, link = best[x], x
            best.append(top + matched)
            before.append(link)
        spans: list[tuple[int, int]] = []

        def held(a: int, b: int) -> bool:
            k = bisect(spans, (a, b))  # noqa: B023
            return any(min(b, d) - max(a, c) > min(BAND, (b - a) // 2) for c, d in spans[max(0, k - 1) : k + 1])  # noqa: B023

        for y in sorted(range(len(nodes)), key=lambda y: (-best[y], y)):
            row = []
            while y >= 0 and not held(*nodes[y][2:]):
                row.append(nodes[y])
                y = before[y]
            if row:
                s, _, a, _ = row[-1]
                b = max(m[3] for m in row)
                insort(spans, (a, b))
                out.append((t, sum(m[1] for m in row), index.offset[s], a, b))
    return sorted(out, key=lambda m: (m[3], m[0]))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row a match: doc_id, license, matched words, coverage of the license, span in code points, words of the license before the match.

    The argument `coverage` is what a section needs to be found.
    """
    index = Index(templates or TEMPLATES)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched_words", pa.int32()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("license_offset", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for i, j in row_blocks(offsets):
                words, starts, ends, hashes = _words(raw, offsets, i, j)
                hits_at, hits = [], []
                for size in (2, GRAM):
                    grams = _grams(hashes, size)
                    if not len(grams):
                        continue
                    spot = np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)
                    at = np.flatnonzero(index.keys[spot] == grams)
                    # a gram belongs to a document if it doesn't reach into the next one
                    at = at[at + size <= words.bounds[np.searchsorted(words.bounds, at, side="right")]]
                    hits_at.append(at)
                    hits.append(grams[at])
                if not sum(map(len, hits)):
                    continue
                at = np.concatenate(hits_at)
                order = np.argsort(at, kind="stable")
                at, grams = at[order], np.concatenate(hits)[order]
                row = np.searchsorted(words.bounds, at, side="right") - 1
                points = np.concatenate([[0], np.cumsum((words.bytes & 0xC0) != 0x80)])
                rows = []
                first = np.flatnonzero(np.diff(row, prepend=-1))
                for x, y in zip(first.tolist(), [*first[1:].tolist(), len(row)]):
                    r = int(row[x])
                    lo, hi = words.bounds[r], words.bounds[r + 1]
                    base = points[words.rows[r]]
                    doc_id = batch.column(0)[i + r].as_py()
                    for t, matched, offset, a, b in _matches(index, _sections_found(index, hashes[lo:hi], at[x:y] - lo, grams[x:y], coverage)):
                        rows.append({"doc_id": doc_id, "license": index.names[t], "matched_words": matched, "coverage": matched / index.total[t], "start": int(points[starts[lo + a]] - base), "end": int(points[ends[lo + b - 1]] - base), "license_offset": offset})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, license string, matched_words int, coverage double, start long, end long, license_offset int")
