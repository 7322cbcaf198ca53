"""License scan by conditional compression, confirmed by exact wording differences.

A notice that reaches ``SIMILARITY`` shares runs of words with its template: of ``n`` words, at least
``n / 3 - 1`` neighbouring pairs. Whole texts are read as one sequence of words, across lines and blank
lines, and the stretches that hold so many of a template's pairs are its candidate blocks; a text without
them cannot hold the notice. Each block is compressed by zstandard on its own and with its template as
a raw dictionary; templates are ranked by how much the dictionary saves, as a share of the block's own
compressed size. In that order all that save anything are confirmed by the best word-by-word alignment of any part of
the block: the similarity is the share of words that agree, and the differences are listed. Of notices that overlap the one with most
agreeing words stays, so a line may hold several notices and a notice may run over many lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import repeat

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import query, table

# Public notices, headers and texts of licenses, under the SPDX name they stand for; what
# follows a name in parentheses tells several of one license apart.
TEMPLATES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the 2-Clause BSD License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0 (header)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "MIT (text)": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause (text)": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause (text)": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC (text)": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib (text)": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may
not be removed or altered from any source distribution.""",
    "Unlicense (text)": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means.""",
    "GPL-2.0 (header)": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0 (header)": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "AGPL-3.0 (header)": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "MPL-2.0 (header)": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
SIMILARITY = 0.8
_WORD = re.compile(r"[\w.+-]*\w")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def spdx(name: str) -> str:
    """The license that a template stands for."""
    return name.partition(" (")[0]


@dataclass
class Notice:
    """A confirmed template on words ``start`` to ``end`` of a text."""

    name: str
    start: int
    end: int
    agree: int
    similarity: float
    saving: float
    differences: str


def _scores(target: list[str], found: list[str], price: float) -> np.ndarray:
    """Best ``2 agree - price * words`` of a part of ``found`` that ends before word j, over the first i words of ``target``.

    Words of ``target`` that are left out cost nothing; a part may begin anywhere.
    """
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in (target, found))
    slope = price * np.arange(len(found) + 1)
    scores = np.zeros((len(target) + 1, len(found) + 1))
    for i, word in enumerate(a):
        row = scores[i].copy()
        np.maximum(row[1:], np.where(b == word, scores[i, :-1] + 2 - price, 0), out=row[1:])
        scores[i + 1] = np.maximum.accumulate(row + slope) - slope
    return scores


def _agreeing(target: list[str], found: list[str], scores: np.ndarray, price: float) -> list[tuple[int, int]]:
    """Word pairs that agree in the best part, in order; of equal ways the one that ends last."""
    i, j = len(target), int(scores[-1].argmax())
    pairs = []
    while i and scores[i, j] > 1e-9:
        if scores[i, j] <= scores[i - 1, j] + 1e-9:
            i -= 1
        elif j and target[i - 1] == found[j - 1] and scores[i, j] <= scores[i - 1, j - 1] + 2 - price + 1e-9:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        else:
            j -= 1
    return pairs[::-1]


def aligned(target: list[str], found: list[str], least: float = 0.0) -> tuple[int, int, int, float]:
    """``start, end, agree, similarity`` of the part of ``found`` that agrees best with ``target``; zeros if none reaches ``least``.

    The similarity is ``2 agree / (words of both)`` of the best alignment of the best part: while some part
    exceeds the similarity reached, at that price of a word, its similarity is the next price.
    """
    best, price = (0, 0, 0, 0.0), max(least - 1e-6, 0.0)
    # no more words can agree than both hold, in whatever order
    common = round(SequenceMatcher(None, target, found, autojunk=False).quick_ratio() * (len(target) + len(found)) / 2)
    if 2 * common < price * (len(target) + common):
        return best
    while True:
        scores = _scores(target, found, price)
        if scores[-1].max() <= price * len(target) + 1e-9:
            return best
        pairs = _agreeing(target, found, scores, price)
        if not pairs:
            return best
        start, end = pairs[0][1], pairs[-1][1] + 1
        similarity = 2 * len(pairs) / (len(target) + end - start)
        if similarity <= best[3]:
            return best
        best, price = (start, end, len(pairs), similarity), similarity


def differences(target: list[str], part: list[str]) -> str:
    """Words of ``target`` and what stands for them in ``part``, wherever the two do not agree."""
    pairs = [(-1, -1), *_agreeing(target, part, _scores(target, part, 1e-6), 1e-6), (len(target), len(part))]
    return "; ".join(
        f"{' '.join(target[a + 1:c])} => {' '.join(part[b + 1:d])}"
        for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False) if c > a + 1 or d > b + 1)


class Scanner:
    """Templates as words, word pairs and primed compressors."""

    def __init__(self, templates: Mapping[str, str]):
        self.words = {name: words(text) for name, text in templates.items()}
        vocabulary = sorted({w for ws in self.words.values() for w in ws})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.size = len(vocabulary)
        self.pairs = {}
        self.known = np.zeros(self.size * self.size, bool)
        for name, ws in self.words.items():
            codes = np.array([self.number[a] * self.size + self.number[b] for a, b in zip(ws, ws[1:], strict=False)], np.int64)
            self.pairs[name] = np.unique(codes)
            self.known[codes] = True
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.primed = {
            name: zstandard.ZstdCompressor(
                level=3, write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict(" ".join(self.words[name]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name in templates
        }

    def saving(self, block: str, name: str) -> float:
        data = block.encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        return (alone - len(self.primed[name].compress(data))) / alone

    def stretches(self, found: list[str]) -> Iterator[tuple[str, int, int]]:
        """``template, first word, last word`` of what may hold it."""
        at = np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, len(found))
        both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0)) if len(at) > 1 else np.zeros(0, np.int64)
        codes = at[both] * self.size + at[both + 1]
        held = self.known[codes]
        both, codes = both[held], codes[held]
        if not len(both):
            return
        for name, pairs in self.pairs.items():
            n = len(self.words[name])
            need = max(1, math.ceil(n / 3 - 1))
            places = both[np.isin(codes, pairs)]
            if len(places) < need:
                continue
            # a notice has at most half as many words again; so many pairs must fit into that
            reach = math.ceil(1.5 * n)
            counts = np.searchsorted(places, places + reach) - np.arange(len(places))
            step, done = max(1, n // 2), -1
            for place in places[counts >= need].tolist():
                if place <= done:
                    continue
                # any notice with this pair lies within; the next step begins half a template further
                yield name, max(0, place - step - 2), min(len(found), place + 2 * n + 2)
                done = place + step

    def notices(self, text: str) -> list[tuple[int, int, Notice]]:
        """``first line, last line, notice`` of a whole text, in order."""
        low = text.lower()
        found = _WORD.findall(low)
        ranked = sorted(((self.saving(" ".join(found[first:last]), name), name, first, last) for name, first, last in self.stretches(found)), key=lambda r: (-r[0], *r[1:]))
        confirmed = []
        for saving, name, first, last in ranked:
            start, end, agree, similarity = aligned(self.words[name], found[first:last], SIMILARITY)
            if similarity < SIMILARITY:
                continue
            start, end = first + start, first + end
            # a short notice may save only without the words around it
            own = self.saving(" ".join(found[start:end]), name)
            if max(saving, own) > 0:
                confirmed.append(Notice(name, start, end, agree, similarity, own if own > 0 else saving, ""))
        kept: list[Notice] = []
        for notice in sorted(confirmed, key=lambda c: (-c.agree, -c.similarity, -c.saving, c.name)):
            if all(notice.end <= k.start or notice.start >= k.end for k in kept):
                notice.differences = differences(self.words[notice.name], found[notice.start:notice.end])
                kept.append(notice)
        spans = [m.span() for m in _WORD.finditer(low)] if kept else []
        lines = lambda at: low.count("\n", 0, at)
        return [(lines(spans[n.start][0]), lines(spans[n.end - 1][0]), n) for n in sorted(kept, key=lambda n: n.start)]


def licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, line_no, last_line, license, saving, similarity, differences`` per notice.

    Line numbers start at 0. Texts are read whole. Null and empty texts hold nothing; repeated rows
    each give their rows; a null doc_id is kept. Other columns are ignored.
    """
    names = ["doc_id", "line_no", "last_line", "license", "saving", "similarity", "differences"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for first, last, n in scanner.notices(text):
                    rows.append((None if doc is None else int(doc), first, last, spdx(n.name), n.saving, n.similarity, n.differences))
            yield pd.DataFrame(rows, columns=names, dtype=object).astype({"doc_id": "Int64", "line_no": "int32", "last_line": "int32", "saving": float, "similarity": float})

    # ids as text: beside nulls, pandas would round large numbers
    given = docs.where("text is not null").selectExpr("CAST(CAST(doc_id AS BIGINT) AS STRING) AS doc_id", "text")
    return given.mapInPandas(
        scan, "doc_id long, line_no int, last_line int, license string, saving double, similarity double, differences string")


@query("op7_license_scan")
def op7(spark, folder):
    return licenses(table(spark, folder, "documents"))
