"""Operator 1: licence notices found by MinHash bands over overlapping windows, then by exact containment.

A template of n words has n - 4 shingles of five words (fewer words: one of all). Texts are read in
windows of as many shingles, each an eighth of a window after the one before, and windows meet templates on bands of ROWS
minima of permuted shingle hashes. A template whose shingles lie to 0.8 in some window
overlaps the nearest window read by Jaccard 0.58 or more; BANDS bands retrieve it with probability
1 - (1 - 0.58 ** 2) ** 16 > 0.998. Templates of up to four shingles need all of them, and windows are read at every
word: one band finds them for certain. Retrieved places are verified: a notice is there if one of the windows around
(at any word, as far as the text goes) holds 0.8 of the template's distinct shingles.

Words are lower-cased in ASCII, runs of letters, digits and bytes beyond ASCII. Templates are parameters,
held in memory by each task; minima are shared by all window sizes, so their number costs little.

Defined cases: null and empty texts hold nothing; a text shorter than a template is one window; templates without words
are left out; equal templates are all reported; rows may repeat; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import WORDS, column_bytes, per_batch, table

K, BANDS, ROWS, CONTAINED = 5, 16, 2, 0.8
CHUNK = 500_000
_MOST = np.uint64((1 << 64) - 1)

#: Whole licences and notices in their published wording.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS '
    "FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
    "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-notice",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-text", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("bsd-3-text", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    (
        "bsl-1.0-text",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is '
        "furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated "
        "by a source language processor.",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR '
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT "
        "OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("mit", "Released under the MIT License."),
    ("mit-grant", _MIT_GRANT),
    (
        "mit-text",
        _MIT_GRANT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain.",
    ),
    (
        "zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Of a sequence of word hashes: a hash for each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        out ^= out >> np.uint64(29)
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minima of all windows of w values."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if span < w else x


class Scanner:
    def __init__(self, templates=TEMPLATES, contained: float = CONTAINED, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
        self.contained = contained
        self.hashes: dict[bytes, int] = {}
        #: (shingle size, shingles a window) -> templates: name, distinct shingles
        self.groups: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = defaultdict(list)
        for name, text in templates:
            ws = self.numbers(words_of(text.encode()))
            k = min(K, len(ws))
            if k:
                self.groups[k, len(ws) - k + 1].append((name, np.unique(shingle_hashes(ws, k))))
        self.tables = {}
        for (k, w), held in self.groups.items():
            bands = 1 if w < 5 else BANDS
            rows = []
            for b in range(bands):
                found: dict[int, list[int]] = defaultdict(list)
                for t, (_, s) in enumerate(held):
                    found[int(self._band(b, lambda p, s=s: np.array([self._permuted(s, p).min()]))[0])].append(t)
                rows.append((np.array(sorted(found), np.uint64), [found[x] for x in sorted(found)]))
            self.tables[k, w] = rows

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.hashes) > 500_000:
            self.hashes.clear()
        seen, digest = self.hashes, xxhash.xxh3_64_intdigest
        for w in set(words):
            if w not in seen:
                seen[w] = digest(w)
        return np.array([seen[w] for w in words], np.uint64)

    def _permuted(self, shingles: np.ndarray, p: int) -> np.ndarray:
        x = (shingles ^ self.salts[p]) * self.factors[p]
        return x ^ (x >> np.uint64(32))

    def _band(self, b: int, minima) -> np.ndarray:
        key = np.uint64(b)
        for r in range(ROWS):
            key = (key ^ minima(b * ROWS + r)) * np.uint64(0xD1B54A32D192ED03)
        return key

    def scan(self, texts: list[bytes | None]) -> list[dict[str, list[tuple[int, int, float]]]]:
        """For each text: template -> places (first word, end, best containment), overlapping ones united."""
        out: list[dict] = [{} for _ in texts]
        numbers: list[np.ndarray] = []
        first, size = 0, 0
        for k, text in enumerate(texts):
            numbers.append(self.numbers(words_of(text)))
            size += len(numbers[-1])
            if size >= CHUNK or k == len(texts) - 1:
                self._chunk(numbers, out[first : k + 1])
                first, size, numbers = k + 1, 0, []
        return out

    def _chunk(self, numbers: list[np.ndarray], out: list[dict]) -> None:
        ends = np.cumsum([len(n) for n in numbers])
        every = np.concatenate([*numbers, np.empty(0, np.uint64)])
        of = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
        for k in sorted({k for k, _ in self.tables}):
            sizes = sorted(w for k_, w in self.tables if k_ == k)
            shingles = shingle_hashes(every, k)
            if not len(shingles):
                continue
            retrieved: dict[int, set] = {w: set() for w in sizes}
            for b in range(BANDS):
                if got := [w for w in sizes if b < len(self.tables[k, w])]:
                    minima = [self._minima(self._permuted(shingles, b * ROWS + r), got) for r in range(ROWS)]
                    for w in got:
                        self._met(b, k, w, [m[w] for m in minima], retrieved[w])
            for w in sizes:
                self._verified(sorted(retrieved[w]), k, w, stride(w), shingles, of, ends, out)

    @staticmethod
    def _minima(x: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
        """For each window size the minima of the windows read, the last ones as far as the texts go; halves of windows are shared."""
        n, span, out = len(x), 1, {}
        x = np.concatenate((x, np.full(max(sizes), _MOST)))
        for w in sizes:
            while 2 * span <= w:
                x, span = np.minimum(x[:-span], x[span:]), 2 * span
            at = np.arange(0, n, stride(w))
            out[w] = np.minimum(x[at], x[at + w - span])
        return out

    def _met(self, b: int, k: int, w: int, minima: list[np.ndarray], into: set) -> None:
        keys, held = self.tables[k, w][b]
        got = self._band(b, lambda p: minima[p - b * ROWS])
        at = np.searchsorted(keys, got)
        for i in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == got).tolist():
            into |= {(i * stride(w), t) for t in held[at[i]]}

    def _verified(self, retrieved, k, w, step, shingles, of, ends, out) -> None:
        for at, t in retrieved:
            name, wanted = self.groups[k, w][t]
            for p in range(max(0, at - step), min(len(shingles) - 1, at + step) + 1):
                doc = int(of[p])
                start = int(ends[doc - 1]) if doc else 0
                last = min(p + w, int(ends[doc]) - k + 1)  # no shingle reaches into the next text
                if last <= p:
                    continue
                share = len(np.intersect1d(shingles[p:last], wanted)) / len(wanted)
                if share >= self.contained:
                    places = out[doc].setdefault(name, [])
                    a, b = p - start, last - start + k - 1
                    if places and a <= places[-1][1] and places[-1][0] <= b:
                        places[-1] = (min(a, places[-1][0]), max(b, places[-1][1]), max(share, places[-1][2]))
                    else:
                        places.append((a, b, share))


def stride(w: int) -> int:
    return 1 if w < 5 else max(1, w // 8)


def find(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_licenses, licenses (names, comma-joined), places (name:first word:end), best."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def make():
        scanner = Scanner(templates, contained)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scanner.scan(column_bytes(batch, "text"))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted(f)) for f in found], pa.string()),
                    pa.array([",".join(f"{n}:{a}:{b}" for n in sorted(f) for a, b, _ in f[n]) for f in found], pa.string()),
                    pa.array([max((s for p in f.values() for *_, s in p), default=0.0) for f in found], pa.float64()),
                ],
                ["doc_id", "n_licenses", "licenses", "places", "best"],
            )

        return one

    return source.mapInArrow(per_batch(make), f"doc_id {dict(source.dtypes)['doc_id']}, n_licenses long, licenses string, places string, best double")


def op1_minhash_licenses(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
