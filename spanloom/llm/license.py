"""Licence scan: normalised text held against licence templates by the Dice coefficient over word bigrams.

Words are lower-cased (A-Z) runs of letters, digits and other signs that aren't ASCII, but for U+0080 to U+00BF and U+2000 to U+203F (no-break
space, (c) sign, curly quotes, dashes), which part words like white space and ASCII punctuation do: so quotes, comment marks and the wrapping of
lines don't matter. Templates leave out copyright lines, which stand before a licence's wording.

Units of a text are: for each template of W words every window of W words, each line, and the whole text. Two sets of bigrams A and B have Dice
2 |A and B| / (|A| + |B|). At LEAST or more that bounds |A| by |B| LEAST / (2 - LEAST) and its inverse, and the bigrams shared from below:
a template is compared only with units of fitting size, and only where so many of its bigrams stand.

Of matches that overlap the best stays: they are taken by bigrams shared (so a licence in full goes before its own first sentence), then Dice, then
template in the list's order, then place, each unless it overlaps one taken.

Null and empty texts have no unit. Repeated rows: the same result each. Very long texts: whole, in time proportional to their length. Other
columns, whatever their names, aren't read. No templates: no match. Empty table: an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import rows_of, utf8
from spanloom.llm.decontam import Vocabulary, Words

LEAST = Fraction(8, 10)
WARRANTY = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
GNU_NOTICE = "is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GNU_WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."


def _gnu(what: str, name: str) -> list[str]:
    notice = f"{what} {GNU_NOTICE.format(name)}"
    return [notice, f"{notice} {what} {GNU_WARRANTY.format(name)}"]


#: Usual wordings of licence notices, and the licences in full that are short.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        APACHE_NOTICE,
        f"""{APACHE_NOTICE} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "BSD-2-Clause": [f"{BSD_HEAD}: 1. {BSD_SOURCE} 2. {BSD_BINARY} {BSD_WARRANTY}"],
    "BSD-3-Clause": [
        BSD_HEAD,
        f"""{BSD_HEAD}: 1. {BSD_SOURCE} 2. {BSD_BINARY} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission. {BSD_WARRANTY}""",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", *_gnu("This program", "General Public License")],
    "AGPL-3.0": _gnu("This program", "Affero General Public License"),
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", *_gnu("This library", "Lesser General Public License")],
    "ISC": [ISC_GRANT, f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_WARRANTY}"],
    "0BSD": [f"{ISC_GRANT}. {ISC_WARRANTY}"],
    "MIT": [
        "Released under the MIT License.",
        MIT_GRANT,
        f"""{MIT_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. {WARRANTY}""",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
        a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
        act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. {WARRANTY.replace("OR COPYRIGHT HOLDERS ", "")}""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
        anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
        be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
    ],
}


def _flat(templates: dict[str, str | list[str]]) -> list[tuple[str, str]]:
    return [(name, " ".join(t.split())) for name, texts in templates.items() for t in ([texts] if isinstance(texts, str) else texts)]


def _words(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of texts, their bytes and offsets; signs beyond ASCII that part words are blanks."""
    raw, offsets = utf8(texts)
    plain = raw.copy()
    if len(raw) > 2:
        general = np.nonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80))[0]
        for k in range(3):
            plain[general + k] = 0x20
    if len(raw) > 1:
        latin = np.nonzero(raw[:-1] == 0xC2)[0]
        plain[latin] = plain[latin + 1] = 0x20
    return Words(plain, offsets), raw, offsets


class Scanner:
    def __init__(self, templates: dict[str, str | list[str]], least: Fraction = LEAST):
        self.least, flat = least, _flat(templates)
        self.names = [name for name, _ in flat]
        words, _, _ = _words(pa.array([t for _, t in flat], pa.large_string()))
        self.vocabulary = Vocabulary(words)
        self.size = words.count.tolist()
        spoken = words.bytes_of(range(len(words.starts)))
        ends = np.cumsum(words.count).tolist()
        said = [spoken[e - n : e] for n, e in zip(self.size, ends, strict=True)]
        self.sets = [set(zip(w, w[1:], strict=False)) for w in said]
        n = [len(s) for s in self.sets]
        self.low, self.high = [ceil(x * least / (2 - least)) for x in n], [floor(x * (2 - least) / least) for x in n]
        # all bigrams by number, and whose they are
        self.base = len(self.vocabulary.number) + 1
        number = self.vocabulary.number
        codes = [sorted((number[a] + 1) * self.base + number[b] + 1 for a, b in s) for s in self.sets]
        self.pairs = np.unique(np.concatenate([np.empty(0, np.int64), *(np.array(c, np.int64) for c in codes)]))
        self.of = np.zeros((len(self.sets), len(self.pairs)), bool)
        for k, c in enumerate(codes):
            self.of[k, np.searchsorted(self.pairs, c)] = True

    def _dice(self, k: int, own: set) -> tuple[int, int] | None:
        over, under = 2 * len(own & self.sets[k]), len(own) + len(self.sets[k])
        return (over, under) if over >= self.least * under and over else None

    def _slid(self, k: int, words: list[bytes], at: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, over, under) of the windows of one template that match; at: places of its bigrams."""
        size, need = self.size[k], self.low[k]
        starts = []
        for j in range(len(at) - need + 1):
            if at[j + need - 1] - at[j] <= size - 2:
                starts.append((max(0, at[j + need - 1] - size + 2), min(at[j], len(words) - size) + 1))
        counts: dict[tuple[bytes, bytes], int] = {}
        begin = end = shared = 0  # of the bigrams counted
        for since, to in starts:
            for s in range(max(since, begin), to):
                if s >= end:
                    counts, begin, end, shared = {}, s, s, 0
                while end < s + size - 1:
                    pair = words[end], words[end + 1]
                    n = counts[pair] = counts.get(pair, 0) + 1
                    shared += n == 1 and pair in self.sets[k]
                    end += 1
                while begin < s:
                    pair = words[begin], words[begin + 1]
                    n = counts[pair] = counts[pair] - 1
                    if not n:
                        del counts[pair]
                        shared -= pair in self.sets[k]
                    begin += 1
                if 2 * shared >= self.least * (len(counts) + len(self.sets[k])):
                    yield s, 2 * shared, len(counts) + len(self.sets[k])

    def matches(self, texts: pa.Array) -> list[list[tuple[int, int, int, int, int]]]:
        """Of each text the matches taken: (template, twice the bigrams shared, bigrams of both, first word, end)."""
        words, raw, offsets = _words(texts)
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        code = self.vocabulary.codes(words)
        if not len(self.pairs) or len(code) < 2:
            return out
        last = np.cumsum(words.count)
        pair = code[:-1] * self.base + code[1:]
        known = (code[:-1] > 0) & (code[1:] > 0)
        known[last[(last > 0) & (last < len(code))] - 1] = False  # not from text to text
        place = np.nonzero(known)[0]
        at = np.minimum(np.searchsorted(self.pairs, pair[place]), len(self.pairs) - 1)
        same = self.pairs[at] == pair[place]
        place, at = place[same], at[same]
        text = np.searchsorted(last, place, side="right")
        likely: dict[int, list[int]] = {}
        for k in range(len(self.sets)):
            often = np.bincount(text, self.of[k, at], len(out)) >= max(1, self.low[k])
            for d in np.nonzero(often)[0].tolist():
                likely.setdefault(d, []).append(k)
        for d, templates in likely.items():
            base = int(last[d] - words.count[d])
            own = words.bytes_of(range(base, int(last[d])))
            mine = slice(int(np.searchsorted(place, base)), int(np.searchsorted(place, last[d])))
            breaks = np.nonzero(raw[offsets[d] : offsets[d + 1]] == 0x0A)[0] + offsets[d]
            line_ends = [*np.searchsorted(words.starts[base : last[d]], breaks).tolist(), len(own)]
            units = [(a, b) for a, b in zip([0, *line_ends], line_ends, strict=False)]
            if len(units) > 1:
                units.append((0, len(own)))
            found = []
            for k in templates:
                hits = (place[mine][self.of[k, at[mine]]] - base).tolist()
                found += [(k, over, under, s, s + self.size[k]) for s, over, under in self._slid(k, own, hits)]
                for a, b in units:
                    if b - a > self.low[k] and bisect_left(hits, b - 1) - bisect_left(hits, a) >= self.low[k]:
                        bigrams = set(zip(own[a : b - 1], own[a + 1 : b], strict=True))
                        if self.low[k] <= len(bigrams) <= self.high[k] and (x := self._dice(k, bigrams)):
                            found.append((k, *x, a, b))
            found.sort(key=lambda x: (-x[1], x[2], x[0], x[3], x[4]))
            taken: list[tuple[int, int]] = []  # in order of place
            for x in found:
                j = bisect_left(taken, (x[4], 0))
                if not j or taken[j - 1][1] <= x[3]:
                    taken.insert(j, (x[3], x[4]))
                    out[d].append(x)
        return out


def op1(docs: DataFrame, templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """doc_id, n_matches (matches taken), licenses (those found, sorted, comma-joined), best_license and best_dice (of the match taken first; null: none)."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in rows_of(batches, 4 << 20):
            out = []
            for found in scanner.matches(batch.column(1)):
                best = found[0] if found else None
                out.append((len(found), ",".join(sorted({scanner.names[x[0]] for x in found})), best and scanner.names[best[0]], best and best[1] / best[2]))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True))], ["doc_id", "n_matches", "licenses", "best_license", "best_dice"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_matches long, licenses string, best_license string, best_dice double")


def oracle_sql() -> str:
    """The same by DuckDB: all windows, lines and whole texts, of the texts in which enough of a template's bigrams stand."""
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(_flat(TEMPLATES)))
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{C0}}-\\x{{1FFF}}\\x{{2040}}-\\x{{10FFFF}}]+')"
    pairs = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
    return f"""
WITH RECURSIVE t AS (SELECT k, name, len(w) AS size, list_distinct({pairs.format('w')}) AS s FROM (SELECT k, name, {words.format('text')} AS w FROM (VALUES {values}) v(k, name, text))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT r, w, {pairs.format('w')} AS b, text FROM (SELECT r, text, {words.format('text')} AS w FROM d) WHERE len(w) > 1),
h AS (SELECT r, k, count(*) AS n FROM (SELECT r, unnest(b) AS x FROM p) q JOIN (SELECT k, unnest(s) AS x FROM t) y USING (x) GROUP BY r, k),
c AS (SELECT h.r, h.k, size, s FROM h JOIN t USING (k) WHERE 12 * h.n >= 8 * len(s)),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS j FROM p WHERE r IN (SELECT r FROM c)),
m AS (SELECT r, j, len({words.format('line')}) AS n FROM l),
u AS (SELECT r, CAST(sum(n) OVER (PARTITION BY r ORDER BY j ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS a, CAST(sum(n) OVER (PARTITION BY r ORDER BY j ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM m
  UNION ALL SELECT r, 0, len(w) FROM p WHERE r IN (SELECT r FROM c)),
x AS (SELECT c.r, k, s, a, e FROM c JOIN u USING (r) WHERE e - a > 1 AND 12 * (e - a - 1) >= 8 * len(s)
  UNION ALL SELECT c.r, k, s, a, a + size FROM (SELECT c.*, unnest(range(0, len(w) - size + 1)) AS a FROM c JOIN p USING (r) WHERE len(w) >= size) c),
o AS (SELECT r, k, a, e, len(s) AS ns, list_distinct(b[a + 1 : e - 1]) AS own, s FROM x JOIN p USING (r)),
g AS (SELECT r, k, a, e, 2 * len(list_intersect(own, s)) AS o, len(own) + ns AS n FROM o WHERE 12 * len(own) >= 8 * ns AND 8 * len(own) <= 12 * ns),
f AS (SELECT r, list({{'o': o, 'n': n, 'k': k, 'a': a, 'e': e}} ORDER BY o DESC, n, k, a, e) AS rest FROM g WHERE 10 * o >= 8 * n GROUP BY r),
z(r, rest, taken, step) AS (
  SELECT r, rest, [rest[1]], 1 FROM f
  UNION ALL SELECT r, list_filter(rest, lambda y: y.a >= taken[step].e OR y.e <= taken[step].a), list_append(taken, list_filter(rest, lambda y: y.a >= taken[step].e OR y.e <= taken[step].a)[1]), step + 1
  FROM z WHERE len(list_filter(rest, lambda y: y.a >= taken[step].e OR y.e <= taken[step].a)) > 0),
q AS (SELECT r, arg_max(taken, step) AS taken FROM z GROUP BY r),
n AS (SELECT r, len(taken) AS c, taken[1].k AS k, CAST(taken[1].o AS DOUBLE) / taken[1].n AS dice, (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM (SELECT unnest(taken).k AS k) y JOIN t USING (k)) AS names FROM q)
SELECT doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_matches, coalesce(names, '') AS licenses, t.name AS best_license, dice AS best_dice FROM d LEFT JOIN n USING (r) LEFT JOIN t ON t.k = n.k
"""
