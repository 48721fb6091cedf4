"""License scans by patience alignment.

A stretch of a text is aligned with a template: words unique to both are matched, the longest increasing subsequence of
the matches are the anchors, and the gaps between anchors are aligned the same way; equal words at a gap's ends are matched
first. Coverage is the share of the template's words that the alignment matches.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, rows_of, text_list

#: Notices by name.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
#: Least coverage, and length of a stretch against the template's.
COVERAGE, STRETCH = 0.8, 1.5
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing in both, by patience."""
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
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = increasing([(i, at[a[i]]) for i in range(a0, a1) if a[i] in at])
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            out += anchors
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first place, that increases in the second."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(last[p - 1] if p else -1)
        tops[p : p + 1] = [j]
        last[p : p + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel: no alignment has more pairs."""
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        if at := row & places.get(w, 0):
            row = ((row + at) | (row - at)) & full
    return len(b) - row.bit_count()


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, stretch: float = STRETCH):
        self.coverage = coverage
        self.items = []
        for name, text in sorted(templates.items()):
            words = words_of(text)
            if words:
                self.items.append((name, words, Counter(words), max(len(words), int(len(words) * stretch))))
        self.vocabulary = {w for _, words, _, _ in self.items for w in words}

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, first word, end, matched words) of each stretch that covers a template, by place."""
        text_words = words_of(text)
        some = self.vocabulary.intersection(text_words)
        if not some:
            return []
        found = []
        for name, words, need, span in self.items:
            least = self.coverage * len(words)
            if sum(n for w, n in need.items() if w in some) >= least:
                found += [(name, *hit) for hit in self._stretches(text_words, words, need, span, least)]
        return sorted(found, key=lambda x: (x[2], x[0]))

    def _stretches(self, text: list[str], words: list[str], need: Counter, span: int, least: float) -> list[tuple[float, int, int, int]]:
        # windows of `span` words that have enough of the template's words, whatever their order; then the alignment
        inside: Counter[str] = Counter()
        shared, hits, windows = 0, [], []
        for i, w in enumerate(text):
            if w in need:
                inside[w] += 1
                shared += inside[w] <= need[w]
            if i >= span and (v := text[i - span]) in need:
                shared -= inside[v] <= need[v]
                inside[v] -= 1
            if shared >= least:
                start = max(0, i - span + 1)
                if windows and start <= windows[-1][1]:
                    windows[-1][1] = i
                else:
                    windows.append([start, i])
        for start, end in windows:
            hits += self._between(text, start, end + 1, words, need, span, least)
        return [(n / len(words), first, last, n) for first, last, n in hits]

    def _between(self, text: list[str], at: int, stop: int, words: list[str], need: Counter, span: int, least: float) -> list[tuple[int, int, int]]:
        # (first word, end, matched words) of hits from left to right: every start is tried, so none steps over another
        hits = []
        while stop - at >= least:
            best = self._at(text, at, stop, words, span, least) if text[at] in need else None
            if best is None:
                at += 1
                continue
            # the window may end inside the stretch: of the starts before it, the one that matches most, then the tightest
            for k in range(at + 1, best[1] - math.ceil(least) + 1):
                if text[k] in need and (hit := self._at(text, k, stop, words, span, least)) and (hit[2], hit[0] - hit[1]) > (best[2], best[0] - best[1]):
                    best = hit
            if best[0] - at >= least:
                hits += self._between(text, at, best[0], words, need, span, least)
            hits.append(best)
            at = best[1]
        return hits

    def _at(self, text: list[str], at: int, stop: int, words: list[str], span: int, least: float) -> tuple[int, int, int] | None:
        # windows of a span, and of the template's length: the shorter one has no second copy that takes the anchors away
        best = None
        if longest_common(text[at : min(stop, at + span)], words) < least:
            return None
        for size in sorted({span, len(words)}, reverse=True):
            pairs = self._dense(align(text[at : min(stop, at + size)], words), span, least)
            if pairs and (best is None or len(pairs) > best[2]):
                best = at + pairs[0][0], at + pairs[-1][0] + 1, len(pairs)
        return best

    @staticmethod
    def _dense(pairs: list[tuple[int, int]], span: int, least: float) -> list[tuple[int, int]]:
        """The most pairs within `span` words, if they are enough."""
        best: list[tuple[int, int]] = []
        lo = 0
        for hi in range(len(pairs)):
            while pairs[hi][0] - pairs[lo][0] >= span:
                lo += 1
            if hi - lo + 1 > len(best):
                best = pairs[lo : hi + 1]
        return best if len(best) >= least else []


FOUND = "license string, coverage double, first_word bigint, end_word bigint, n_matched bigint"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, coverage: float = COVERAGE, stretch: float = STRETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word, n_matched) of every stretch that covers a template.

    Whole texts are scanned, without a shuffle. A null or empty text has no rows; repeated rows are scanned each; a null id
    stays null. Templates without words are passed over. Other columns aren't read.
    """
    bound_batches(docs.sparkSession)
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage, stretch)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            at, rows = [], []
            for i, text in enumerate(text_list(b.column(1))):
                for hit in scanner.scan(text):
                    at.append(i)
                    rows.append(hit)
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *(x.split()[0] for x in FOUND.split(", "))])

    return source.mapInArrow(run, f"doc_id {kind.simpleString()}, {FOUND}")
