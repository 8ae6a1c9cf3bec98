"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts are lower-cased words without outer marks, in 5-word shingles. Templates
whose number of shingles rounds up to the same power of two L share windows of L
shingles with a stride of L / 8 (1 at least), so a window starts within half a
stride of any occurrence. A band is one minimum of an independent hash; it
equals a template's with probability J, the Jaccard similarity of window and
template. bands_for() takes the least J that a passage with 0.8 of a template's
shingles can have in the best window and sets the number of bands so that all
miss with probability MISS at most. For a window that any band retrieves, the
template's shingles are counted, as the words themselves, in the window widened
by one stride on each side; containment of 0.8 or more is a match.

Comment leaders don't matter: a word of marks alone is no word, on either side.
Before bands are computed, a text's shingles are looked up among the templates': a
window that shares a band minimum with a template holds that template's shingle, so
windows without any hold no candidate, and most texts cost one pass. A template
half of whose shingles in its region are also those of one that has more there is
not reported, since kindred licenses share most of their text.

Defined results: a null text has no words; a template of fewer than 5 words is one
shingle and matches texts of just these words; of kindred templates with equally
many shingles the one with the higher containment stays, then the first by name; a
template is reported once a text, where it is found best, first of equals; repeated rows get equal
answers; texts are scanned whole, in chunks of shingles; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, prepare, slices, text_or_empty

SHINGLE = 5
LEAST = 0.8
MISS = 1e-6
SEED = 7
MARKS = b".,;:!?\"'()[]{}<>*#`/|%~=_+-"
CHUNK = 1 << 15  # shingles that are hashed at a time

#: Notices of public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}

SCHEMA = pa.schema([("doc_id", pa.int64()), ("template", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())])


def words_of(text: str) -> list[bytes]:
    return [w for w in (x.strip(MARKS) for x in text.encode("utf-8", "surrogatepass").lower().split()) if w]


def shingles(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(size)), strict=False)]


def bands_for(shingles: int, length: int, least: float, miss: float = MISS) -> int:
    """Bands for a template of so many shingles in windows of `length`."""
    shared = math.ceil(least * shingles) - (max(1, length // 8) // 2)
    j = max(shared, 1) / (shingles + length - max(shared, 1))
    return 1 if j >= 1 else math.ceil(math.log(miss) / math.log(1 - j))


class Scanner:
    """The templates' groups, signatures and shingles; holds a word's hash once it has been seen."""

    def __init__(self, templates: dict[str, str], least: float = LEAST, miss: float = MISS, limit: int = 250_000):
        self.least, self.limit, self.hashes = least, limit, {}
        self.groups: dict[int, list[tuple[str, Counter]]] = {}
        self.bands: dict[int, int] = {}
        texts = {name: words_of(text) for name, text in templates.items()}
        for name, words in texts.items():
            if words:
                n = max(1, len(words) - SHINGLE + 1)
                length = 1 << (n - 1).bit_length()
                self.groups.setdefault(length, []).append((name, Counter(shingles(words))))
                self.bands[length] = max(self.bands.get(length, 1), bands_for(n, length, least, miss))
        rng = np.random.default_rng(SEED)
        most = max(self.bands.values(), default=1)
        self.mul = rng.integers(1, 1 << 62, most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 62, most, dtype=np.uint64)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(self._shingle_hashes(words) for words in texts.values() if words)]))
        self.tables = {length: np.stack([self._minima(self._shingle_hashes(texts[name]), length).min(axis=0) for name, _ in group]) for length, group in self.groups.items()}

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.hashes)
        if len(self.hashes) + len(new) > self.limit:
            self.hashes, new = {}, set(words)
        self.hashes.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def _shingle_hashes(self, words: list[bytes]) -> np.ndarray:
        h = self._word_hashes(words)
        if len(h) < SHINGLE:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64) if len(h) else h
        out = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            out = (out ^ h[i : len(out) + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def _minima(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """hashes x bands, the upper 32 bits of each band's permutation."""
        n = self.bands[length]
        return ((hashes[:, None] * self.mul[:n] + self.add[:n]) >> np.uint64(32)).astype(np.uint32)

    def _candidates(self, hashes: np.ndarray, hits: np.ndarray, length: int):
        """(first shingle of a window, template of the group) that share a band. hits: the places of shingles that any template has."""
        stride = max(1, length // 8)
        per = length // stride
        step = max(1, CHUNK // stride) * stride
        for at in range(0, max(1, len(hashes) - length + stride), step):
            if np.searchsorted(hits, at) == np.searchsorted(hits, at + step + length - stride):
                continue
            part = self._minima(hashes[at : at + step + length - stride], length)
            blocks = np.minimum.reduceat(part, np.arange(0, len(part), stride), axis=0)
            windows = blocks[: max(1, len(blocks) - per + 1)].copy()
            for k in range(1, per):
                more = blocks[k : k + len(windows)]
                windows[: len(more)] = np.minimum(windows[: len(more)], more)
            for t, signature in enumerate(self.tables[length]):
                for w in np.nonzero((windows == signature).any(axis=1))[0].tolist():
                    yield at + w * stride, t

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """template, best containment, first word and words of the region where it was found."""
        words = words_of(text)
        if not words:
            return []
        hashes = self._shingle_hashes(words)
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        hits = np.nonzero(self.known[at] == hashes)[0] if len(self.known) else at[:0]
        if not len(hits):
            return []
        begin, end = int(hits[0]), int(hits[-1]) + 1
        best: dict[str, tuple[str, float, int, int]] = {}
        places: dict[str, set[int]] = {}  # of the template's shingles in that region
        for length, group in self.groups.items():
            stride = max(1, length // 8)
            # Windows from one window's length before the first hit to the last one, on the same grid as over the whole text.
            low = max(0, begin - length) // stride * stride
            for place, t in self._candidates(hashes[low : end + length], hits - low, length):
                name, wanted = group[t]
                first = max(0, low + place - stride)
                region = words[first : low + place + length + stride + SHINGLE - 1]
                runs = shingles(region)
                held = Counter(runs)
                found = sum(min(n, held[s]) for s, n in wanted.items()) / sum(wanted.values())
                if found >= self.least and (name not in best or found > best[name][1]):
                    best[name] = (name, found, first, len(region))
                    places[name] = {first + i for i, run in enumerate(runs) if run in wanted}
        kept: list[tuple[str, float, int, int]] = []
        for match in sorted(best.values(), key=lambda m: (-len(places[m[0]]), -m[1], m[0])):
            own = places[match[0]]
            if all(2 * len(own & places[m[0]]) < len(own) for m in kept):
                kept.append(match)
        return sorted(kept)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, miss: float = MISS) -> DataFrame:
    """doc_id, template, containment, first_word, words: one row for each template that a document holds."""
    prepare(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(chosen, least, miss)
        for batch in slices(batches):
            rows = {name: [] for name in SCHEMA.names}
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for found in scanner.scan(text):
                    for name, value in zip(SCHEMA.names, (doc, *found), strict=True):
                        rows[name].append(value)
            yield arrow_batch(rows, SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, template string, containment double, first_word long, words long")
