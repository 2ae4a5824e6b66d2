"""Licence scan by a generalised suffix automaton over the words of licence templates.

Whole texts are streamed through the automaton, which keeps the longest suffix of the words read
that occurs in any template (the matching statistics). Maximal matches of at least ``MIN_MATCH``
words become anchors; anchors that follow each other in text and template within ``GAP`` words are
chained into a covered span; a template whose chain covers ``COVER`` of its words gives its label.
Base phrases are templates too: a place counts where the current match ends in the whole phrase.

Words: A-Z lower-cased, then runs of [0-9a-z] and characters from U+0080. Null counts as empty and
has no words. Rows stand alone, so ties, repeated rows and empty tables need nothing special; other
columns are not read. A batch's texts are in memory, bounded by bytes unless one text is longer; the words of a text are
made block by block, and what is kept of them is one entry a phrase place or anchor.

The score is 1 - (1 - c)(1 - p), c the largest share of a template that a chain covers, p 0.5 where a base phrase occurs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import lean, ship

# Base phrases with labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Public licence texts and the notices that licences ask for, with labels.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""),
    ("apache", """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,
non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display,
publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("bsd-3", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("gpl", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should
have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should
have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should
have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
in perpetuity of all present and future rights to this software under copyright law."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1.
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
removed or altered from any source distribution."""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so."""),
    ("cc-by", """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA
94042, USA."""),
    ("cc-by-sa", """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy
of this license, visit http://creativecommons.org/licenses/by-sa/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain
View, CA 94042, USA."""),
    ("cc0", """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or
neighboring rights to this work."""),
)
MIN_MATCH, GAP, COVER, BLOCK = 4, 16, 0.6, 1 << 20

_TO_SPACE = bytes(
    (b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of about BLOCK bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TO_SPACE)
    at = 0
    while at < len(data):
        end = len(data) if at + BLOCK >= len(data) else data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Automaton:
    """Suffix automaton of several word sequences. State 0 is the empty string."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].append((t, i))
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if (p := self.link[v]) > 0:  # what ends here also ends with every suffix
                self.ends[p] += self.ends[v]
        self.ends = [list(dict.fromkeys(x)) for x in self.ends]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the longest string of p followed by w, taken out of q."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new


class Scanner:
    def __init__(self):
        split = lambda s: next(words_of(s), [])
        phrases, texts = [split(p) for p, _ in PHRASES], [split(t) for _, t in TEMPLATES]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for s in phrases + texts for w in s))}
        self.auto = Automaton([[self.ids[w] for w in s] for s in phrases + texts])
        self.labels = [label for _, label in PHRASES] + [label for label, _ in TEMPLATES]
        self.sizes = [len(s) for s in phrases + texts]
        self.n_phrases = len(PHRASES)
        #: Phrases, with lengths, that end wherever the automaton is in a state: its own and its suffixes'.
        self.phrases_at: list[list[tuple[int, int]]] = [[] for _ in self.auto.ends]
        for v in sorted(range(1, len(self.auto.ends)), key=self.auto.length.__getitem__):
            up, longest = self.auto.link[v], self.auto.length
            own = [(t, self.sizes[t]) for t, i in self.auto.ends[v] if t < self.n_phrases and i == self.sizes[t] - 1 and longest[up] < self.sizes[t] <= longest[v]]
            self.phrases_at[v] = self.phrases_at[up] + own

    def scan(self, text: str | None) -> dict:
        """n_words, phrase places (start, phrase), and per template its best covered span and all disjoint ones."""
        edges, link, length, phrases_at = self.auto.next, self.auto.link, self.auto.length, self.phrases_at
        v = size = n = 0
        places: list[tuple[int, int]] = []
        anchors: list[tuple[int, int, int]] = []  # start, length, state
        get = self.ids.get
        for block in words_of(text):
            for i, w in enumerate(map(get, block), n):
                if w is None:
                    if v:
                        if size >= MIN_MATCH:
                            anchors.append((i - size, size, v))
                        v = size = 0
                    continue
                if w not in edges[v]:
                    if size >= MIN_MATCH:
                        anchors.append((i - size, size, v))
                    while v and w not in edges[v]:
                        v = link[v]
                        size = length[v]
                if w in edges[v]:
                    v = edges[v][w]
                    size += 1
                    for t, k in phrases_at[v]:
                        if size >= k:
                            places.append((i - k + 1, t))
            n += len(block)
        if size >= MIN_MATCH:
            anchors.append((n - size, size, v))
        best, whole = self._chain(anchors)
        return {"n_words": n, "places": places, "covers": best, "spans": {t: self._disjoint(c) for t, c in whole.items()}}

    def _chain(self, anchors: list[tuple[int, int, int]]) -> tuple[dict[int, tuple[float, int, int]], dict[int, list[tuple[float, int, int]]]]:
        """template -> (share of its words covered, first word, last word): the best chain, and all that reach COVER."""
        best: dict[int, tuple[float, int, int]] = {}
        whole: dict[int, list[tuple[float, int, int]]] = {}
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> (text end, template end, covered, first)
        for start, size, v in anchors:
            for t, i in self.auto.ends[v]:
                if t < self.n_phrases:
                    continue
                near = [c for c in open_.get(t, ()) if start - c[0] <= GAP]
                base = max((c for c in near if c[0] <= start and c[1] <= i - size + 1 and i - size + 1 - c[1] <= GAP), key=lambda c: c[2], default=None)
                chain = (start + size, i + 1, size + (base[2] if base else 0), base[3] if base else start)
                open_[t] = [*near, chain]
                share = chain[2] / self.sizes[t]
                if share > best.get(t, (0.0,))[0]:
                    best[t] = (share, chain[3], chain[0] - 1)
                if share >= COVER:
                    whole.setdefault(t, []).append((share, chain[3], chain[0] - 1))
        return best, whole

    @staticmethod
    def _disjoint(chains: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
        """Of chains that overlap, the one of the larger share, then the earlier one; by first word."""
        out: list[tuple[float, int, int]] = []
        for c in sorted(chains, key=lambda c: -c[0]):
            at = bisect_left(out, c[1], key=lambda o: o[1])
            if (at == 0 or out[at - 1][2] < c[1]) and (at == len(out) or c[2] < out[at][1]):
                out.insert(at, c)
        return out


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())])))]
)


def scan_text(text: str | None) -> dict:
    s = scanner()
    got = s.scan(text)
    base = {s.labels[t] for _, t in got["places"]}
    found = {t: c for t, c in got["covers"].items() if c[0] >= COVER}
    starts = [i for i, _ in got["places"]]
    return {
        "n_words": got["n_words"],
        "n_base": len(starts),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s.labels[t] for t in found})),
        "score": 1 - (1 - min(1.0, max((c[0] for c in got["covers"].values()), default=0.0))) * (0.5 if base else 1),
        "spans": [{"label": s.labels[t], "first": a, "last": b, "cover": c} for t in sorted(found) for c, a, b in got["spans"][t]],
    }


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: word counts, base places and labels, all labels, score, covered spans."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [scan_text(t) | {"doc_id": i} for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, OUT)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        lean(run),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>",
    )
