"""License scans by patience alignment of documents with license notices.

A notice's distinctive words are chosen so that no alignment of the required coverage can avoid all of them (pigeonhole); only texts with one leave the JVM, and
in a text every occurrence of one places a window as long as the notice and all the words that the density admits between its words. In a window the alignment anchors on words that are
unique both there and in the notice, keeps the longest increasing subsequence of the anchors, and aligns the gaps between them in the same way, until
none has anchors of its own; gaps so small as ``SMALL`` are then aligned exactly. Coverage is the share of the notice's words aligned; density the share of the aligned stretch that they fill.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, doc_texts, table

COVERAGE = 0.8
DENSITY = 0.6

NOTICES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions
        of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "MIT-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause-third": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "LGPL-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software
        Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "GPL-warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
        the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. This notice may not be removed or altered from any source distribution.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

#: Gaps without an anchor that are aligned by a table: the product of their lengths is at most this.
SMALL = 2500

#: Words too common to be distinctive.
COMMON = frozenset("a all an and any are as at be by code copies copy for form free from in into is it may notice of on or other permission person provided public shall software source subject such terms that the this to under use used version with without work you your following conditions 2 3 4 0 v".split())
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, given by rising first part, whose second part rises too (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
        back.append(piles[at - 1] if at else -1)
    out = []
    k = piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(text: list[str], notice: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """A longest common subsequence of text[a:b] and notice[c:d], by its table."""
    best = [[0] * (d - c + 1) for _ in range(b - a + 1)]
    for i in range(b - a - 1, -1, -1):
        for j in range(d - c - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if text[a + i] == notice[c + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < b - a and j < d - c:
        if text[a + i] == notice[c + j]:
            out.append((a + i, c + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(text: list[str], notice: list[str]) -> list[tuple[int, int]]:
    """Aligned (text position, notice position) pairs, both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(notice))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == notice[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == notice[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(text[a:b]).items() if n == 1} & {w for w, n in Counter(notice[c:d]).items() if n == 1}
        if not once:
            if (b - a) * (d - c) <= SMALL:
                out += common(text, notice, a, b, c, d)
            continue
        where = {w: k for k, w in enumerate(notice[c:d], c) if w in once}
        anchors = increasing([(k, where[w]) for k, w in enumerate(text[a:b], a) if w in once])
        out += anchors
        for (x, y), (z, v) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if z - x > 1 and v - y > 1:
                todo.append((x + 1, z, y + 1, v))
    return sorted(out)


def densest(pairs: list[tuple[int, int]], least: int, density: float) -> list[tuple[int, int]]:
    """The longest run of an alignment's pairs, at least so many, that fills its stretch of text so densely; of equals the densest, then the earliest."""
    for n in range(len(pairs), least - 1, -1):
        runs = [(pairs[k + n - 1][0] - pairs[k][0] + 1, k) for k in range(len(pairs) - n + 1)]
        length, k = min(runs)
        if n / length >= density:
            return pairs[k : k + n]
    return []


class Scanner:
    def __init__(self, notices: dict[str, str] | None = None, coverage: float = COVERAGE, density: float = DENSITY) -> None:
        self.coverage, self.density = coverage, density
        self.notices = [(name, words(text)) for name, text in (NOTICES if notices is None else notices).items()]
        self.notices = [(name, w) for name, w in self.notices if w]
        #: notice number and position by distinctive word
        self.places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, w) in enumerate(self.notices):
            need = len(w) - self.required(w) + 1  # of any so many positions an alignment has one
            rank = sorted(range(len(w)), key=lambda i: (w[i] in COMMON, -len(w[i]), i))
            for i in rank[:need]:
                self.places.setdefault(w[i], []).append((k, i))

    def required(self, notice: list[str]) -> int:
        return max(1, -int(-self.coverage * len(notice) // 1))

    def pattern(self) -> str:
        """A Java regular expression that every text with a hit matches."""
        return r"(?iU)(?<![\p{L}\p{N}])(?:" + "|".join(sorted(map(re.escape, self.places))) + r")(?![\p{L}\p{N}])"

    def scan(self, text: str) -> list[tuple[str, float, float, int, int, int]]:
        """(license, coverage, density, first word, end word, words aligned) of every hit; hits do not overlap."""
        w = words(text)
        spots = [(p, k, i) for p, word in enumerate(w) for k, i in self.places.get(word, ())]
        hits, seen = set(), set()
        for p, k, i in spots:
            name, notice = self.notices[k]
            n, least = len(notice), self.required(notice)
            # Words of a stretch that are not the notice's: at most this many, all on one side of p at worst.
            most = int(n / self.density - n) + 1 if self.density > 0 else len(w)
            for slack in {max(1, n // 4), most}:
                a, b = max(0, p - i - slack), min(len(w), p - i + n + slack)
                found = []
                if (k, a, b) not in seen:
                    seen.add((k, a, b))
                    found.append([(a + x, y) for x, y in align(w[a:b], notice)])
                if slack == most:  # through the word itself, whatever is not unique in the window
                    left, right = align(w[a:p], notice[:i]), align(w[p + 1 : b], notice[i + 1 :])
                    found.append([*((a + x, y) for x, y in left), (p, i), *((p + 1 + x, i + 1 + y) for x, y in right)])
                for pairs in found:
                    if pairs := densest(pairs, least, self.density):
                        first, end = pairs[0][0], pairs[-1][0] + 1
                        hits.add((-len(pairs), -len(pairs) / n, -len(pairs) / (end - first), first, end, name))
        taken: list[tuple[int, int]] = []
        out = []
        for n, cover, dense, first, end, name in sorted(hits):
            if all(end <= x or first >= y for x, y in taken):
                taken.append((first, end))
                out.append((name, round(-cover, 4), round(-dense, 4), first, end, -n))
        return sorted(out, key=lambda h: h[3])


def scan(docs: DataFrame, notices: dict[str, str] | None = None, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """One row for each hit: (doc_id, license, coverage, density, first_word, end_word, n_aligned), words counted from 0.

    * Null and empty texts, and texts without a notice, give no row. A null doc_id stays null.
    * Texts of any length are scanned whole; a notice that occurs several times gives several rows. Of overlapping hits, of one notice or several, the
      one with most words aligned stays, then that of most coverage, then the densest, the earliest, and the first by name.
    * Repeated rows each give their rows. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    scanner = Scanner(notices, coverage, density)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"at": pa.int64(), "license": pa.string(), "coverage": pa.float64(), "density": pa.float64(), "first_word": pa.int32(), "end_word": pa.int32(), "n_aligned": pa.int32()}
        for batch, texts in arrow_batches(batches):
            rows = [(i, *hit) for i, text in enumerate(texts) for hit in scanner.scan(text)]
            at, *rest = (pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds.values(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *rest], ["doc_id", *list(kinds)[1:]])

    rows = doc_texts(docs)
    if not scanner.places:
        rows = rows.where("false")
    else:
        rows = rows.where(rows["text"].rlike(scanner.pattern()))
    return rows.mapInArrow(run, "doc_id bigint, license string, coverage double, density double, first_word int, end_word int, n_aligned int")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
