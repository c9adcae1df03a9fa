"""Licence scans: stretches of text compared with licence templates by Dice coefficient.

Texts are normalised to words of letters, digits and non-ASCII bytes (A-Z in lower case).
A stretch and a template are compared by their sets of word bigrams:
``2 * |A & B| / (|A| + |B|)``.  A coefficient of t needs a stretch of between
t / (2 - t) and (2 - t) / t of the template's size, and so at least the former share of
its bigrams in the text; templates that miss that bound are not compared at all.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel
from .suffixtree import Lookup
from .textkernel import U64, mix
from .workspace import Workspace

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

# Licence texts and notices, without names and years.
TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause-line": "Released under the BSD 3-Clause License.",
}
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"].replace(
    "THIS SOFTWARE IS PROVIDED BY",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY",
)


def _bigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int64 hashes of word bigrams, their rows, the rows' first word positions); a bigram's position is that of its first word."""
    data = textkernel.LOWER[data]
    begin, end, rows = textkernel.word_bounds(data, starts, textkernel.SIGNS)
    words = textkernel.word_hashes(data, begin, end)
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[1:] == rows[:-1])
    return mix(words[at] * U64(0x9E3779B97F4A7C15) + words[at + 1]).view(np.int64), rows[at], at


class Templates:
    """Distinct bigrams of each template, and one table of them all."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.names, self.threshold = list(texts), threshold
        self.sets = []
        for text in texts.values():
            data = np.frombuffer(text.encode(), np.uint8)
            self.sets.append(np.unique(_bigrams(data, np.array([0, len(data)]))[0]))
        self.table = Lookup(np.unique(np.concatenate(self.sets)))
        self.member = np.zeros((len(self.sets), len(self.table.keys)), bool)
        for k, own in enumerate(self.sets):
            self.member[k, self.table(own)] = True
        self.size = np.array([len(s) for s in self.sets])
        #: bigrams that a text needs of each template: the lower size bound
        self.need = np.ceil(self.size * threshold / (2 - threshold) - 1e-9).astype(int)

    def matches(self, codes: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(template, first, last + 1, common, size) of stretches of one text's bigrams, by template, then place.

        A stretch begins and ends with bigrams of its template, since others only lower the
        coefficient.  The best counts (the first of equals), then the best that doesn't
        overlap it, and so on.
        """
        index = self.table(codes)
        known = np.flatnonzero(index >= 0)
        if not len(known):
            return []
        present = np.zeros(len(self.table.keys), bool)
        present[index[known]] = True
        out, before = [], _last_places(codes)
        for k in np.flatnonzero((self.member & present).sum(axis=1) >= self.need):
            own = (index >= 0) & self.member[k, index]
            most = int((self.member[k] & present).sum())
            hits = np.flatnonzero(own).tolist()
            scored = [b for a in hits if (b := self._best(k, a, len(codes), own, before, most))]
            heapq.heapify(scored)
            taken: list[tuple[int, int]] = []  # disjoint and sorted
            while scored:
                _, first, last, common, size = heapq.heappop(scored)
                at = bisect.bisect_left(taken, (first, last))
                if at and taken[at - 1][1] > first or at < len(taken) and taken[at][0] == first:
                    continue
                if at < len(taken) and taken[at][0] < last:  # the best from here that ends before
                    if shorter := self._best(k, first, taken[at][0], own, before, most):
                        heapq.heappush(scored, shorter)
                    continue
                taken.insert(at, (first, last))
                out.append((int(k), first, last, common, size))
        return sorted(out)

    def _best(self, k: int, first: int, stop: int, own: np.ndarray, before: np.ndarray, most: int) -> tuple[float, int, int, int, int] | None:
        """(-dice, first, last + 1, common, size) of the best stretch from first that ends by stop, if it is a match.

        own: places of the template's bigrams; before: last places of the same bigram; most:
        how many of the template's bigrams the text has.
        """
        whole = int(self.size[k])
        limit = int(whole * (2 - self.threshold) / self.threshold + 1e-9)
        length = limit + 1
        while True:
            end = min(first + length, stop)
            new = before[first:end] < first
            sizes = np.cumsum(new)
            at = np.flatnonzero(own[first:end] & new)
            if end == stop or sizes[-1] > limit or len(at) == most:
                break
            length *= 2
        common, size = np.arange(1, len(at) + 1), sizes[at]
        j = int(np.argmax(2 * common / (size + whole)))
        if 2 * common[j] < self.threshold * (size[j] + whole):
            return None
        return -2 * int(common[j]) / (int(size[j]) + whole), first, first + int(at[j]) + 1, int(common[j]), int(size[j])


def _last_places(codes: np.ndarray) -> np.ndarray:
    """For every place the last one before it with the same code, or -1."""
    order = np.argsort(codes, kind="stable")
    out = np.full(len(codes), -1, np.int64)
    same = codes[order][1:] == codes[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def scan(spark: SparkSession, docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_matches, license, dice, matches (array of struct<license, word, n_words, dice>).

    word is the stretch's first word in the normalised text, n_words its length; license and
    dice are those of the best match (the longest of equals, then the first by name).  Texts
    without a match, null and empty ones have n_matches 0 and nulls.  A null id stays null;
    repeated rows are answered one by one; other columns are ignored; an empty table gives an
    empty result.
    """
    Workspace(spark, "licenses")  # bounds the Arrow batches
    known = spark.sparkContext.broadcast(Templates(templates, threshold))
    struct = pa.struct([("license", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("dice", pa.float64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sheet = known.value
        for batch in batches:
            for row, data, starts in textkernel.text_slices(batch.column("text")):
                n_rows = len(starts) - 1
                codes, rows, _ = _bigrams(data, starts)
                edges = np.searchsorted(rows, np.arange(n_rows + 1))
                counts = np.bincount(rows[sheet.table(codes) >= 0], minlength=n_rows)
                found = []
                for r in range(n_rows):
                    some = sheet.matches(codes[edges[r] : edges[r + 1]]) if counts[r] >= sheet.need.min() else []
                    found.append([{"license": sheet.names[k], "word": a, "n_words": b - a + 1, "dice": 2 * common / (size + int(sheet.size[k]))} for k, a, b, common, size in some])
                best = [min(f, key=lambda m: (-m["dice"], -m["n_words"], m["license"])) if f else None for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n_rows),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([b and b["license"] for b in best], pa.string()),
                        pa.array([b and b["dice"] for b in best], pa.float64()),
                        pa.array(found, pa.list_(struct)),
                    ],
                    names=["doc_id", "n_matches", "license", "dice", "matches"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scanned, "doc_id long, n_matches long, license string, dice double, matches array<struct<license: string, word: long, n_words: long, dice: double>>")
