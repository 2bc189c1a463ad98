"""License scans: fixed phrases, and template markup compiled to token automata.

A template is wording with two kinds of regions: ``<<beginOptional>> ... <<endOptional>>`` may be absent, and
``<<var;n>>`` stands for any n words or fewer.  Everything else is mandatory and must match word for word.  Text and
templates are folded alike (A-Z lower; words are runs of letters, digits and characters beyond ASCII), so case and
punctuation never matter, but for ``<<end>>``: there the text's word must not go on behind a hyphen, plus sign or dot (an identifier's end).
A template compiles to states over its words with free moves around optional regions; a text is accepted where a run from the
template's first words reaches the end.  Templates of whole licences score ``WHOLE``, those of notices that only name one ``NOTICE``, phrases alone ``PHRASE``.

Null or empty text: no words.  Rows are independent (no shuffle); repeated rows get equal results; an empty table gives an empty
result; very long texts are read whole, an automaton runs only where its first words stand; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.words import ALNUM

#: Fixed: base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

WHOLE, NOTICE, PHRASE = 1.0, 0.9, 0.5

_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY <<var;20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL <<var;20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>><<var;1>><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<beginOptional>><<var;1>><<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)

#: Fixed: public wordings of licences and notices: label, score, template.
TEMPLATES = [
    ("mit", WHOLE, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL <<var;20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd-2-clause", WHOLE, _BSD + _DISCLAIMER),
    ("bsd-3-clause", WHOLE, _BSD + "<<beginOptional>><<var;1>><<endOptional>> Neither the name of <<var;20>> nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>his<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _DISCLAIMER),
    ("isc", WHOLE, "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND <<var;10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("zlib", WHOLE, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "<<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "<<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution"),
    ("apache", WHOLE, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;4>> except in compliance with the License. You may obtain a copy of the License at <<var;12>> '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License'),
    ("gpl", WHOLE, "<<var;8>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version <<var;2>> of the License, or (at your option) any later version. "
        "<<var;10>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl", WHOLE, "<<var;8>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version <<var;2>> of the License, or (at your option) any later version. "
        "<<var;10>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details"),
    ("mpl", WHOLE, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;6>>"),
    ("mit", NOTICE, "<<beginOptional>>This <<var;3>> is<<endOptional>> Released under the MIT License"),
    ("mit", NOTICE, "SPDX-License-Identifier: MIT<<end>>"),
    ("mit-0", NOTICE, "SPDX-License-Identifier: MIT-0<<end>>"),
    ("apache", NOTICE, "Licensed under the Apache License, Version 2.0"),
    ("apache", NOTICE, "SPDX-License-Identifier: Apache-2.0<<end>>"),
    ("gpl", NOTICE, "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License"),
    ("gpl", NOTICE, "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", NOTICE, "SPDX-License-Identifier: GPL"),
    ("lgpl", NOTICE, "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License"),
    ("lgpl", NOTICE, "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", NOTICE, "SPDX-License-Identifier: LGPL"),
    ("agpl", NOTICE, "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Affero General Public License"),
    ("agpl", NOTICE, "SPDX-License-Identifier: AGPL"),
    ("bsd-2-clause", NOTICE, "SPDX-License-Identifier: BSD-2-Clause<<end>>"),
    ("bsd-3-clause", NOTICE, "SPDX-License-Identifier: BSD-3-Clause<<end>>"),
    ("isc", NOTICE, "SPDX-License-Identifier: ISC<<end>>"),
    ("mpl", NOTICE, "SPDX-License-Identifier: MPL-2.0<<end>>"),
    *[
        (label, NOTICE, f"Licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC {words} 4.0")
        for label, words in (("cc-by", "BY"), ("cc-by-sa", "BY-SA"), ("cc-by-nc", "BY-NC"), ("cc-by-nc-sa", "BY-NC-SA"), ("cc-by-nd", "BY-ND"), ("cc-by-nc-nd", "BY-NC-ND"))
    ],
]

MARKUP = re.compile(r"<<(beginOptional|endOptional|end|var;(\d+))>>")
GOES_ON = b"-+."


class Automaton:
    """States are places in the list of words; ``free`` holds moves that take no word, ``any`` those that take any."""

    def __init__(self, label: str, score: float, template: str):
        self.label, self.score, self.word, self.free, self.any, self.whole = label, score, [], {}, set(), False
        opened: list[int] = []
        runs: list[list[bytes]] = [[]]
        at = 0
        for m in [*MARKUP.finditer(template), None]:
            text = template[at : m.start() if m else len(template)]
            for w in text.encode().translate(ALNUM).split():
                self.word.append(w)
                if not opened:
                    runs[-1].append(w)
            at = m.end() if m else at
            if m is None:
                break
            if m[1] == "end":
                if template[at:].strip():
                    raise ValueError(f"{label}: only the last word can have an end")
                self.whole = True
            elif m[1] == "beginOptional":
                opened.append(len(self.word))
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError(f"{label}: an optional region ends that never began")
                self.free.setdefault(opened.pop(), []).append(len(self.word))
            else:
                for k in range(int(m[2])):
                    self.any.add(len(self.word))
                    self.free.setdefault(len(self.word), []).append(len(self.word) + int(m[2]) - k)
                    self.word.append(b"")
            runs.append([])
        if opened or not any(runs):
            raise ValueError(f"{label}: an open optional region, or no mandatory word")
        #: The longest mandatory run: a text without it needs no automaton.
        self.anchor = b" ".join(max(runs, key=lambda r: len(b" ".join(r))))
        self.start = self._close({0})
        self.firsts = {self.word[s] for s in self.start if s < len(self.word) and s not in self.any}
        self.anywhere = any(s in self.any for s in self.start)  # words of a region come first

    def _close(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts_at(self, words: list[bytes], at: int) -> int:
        """The word after the shortest accepted run from at, or -1."""
        states, end = self.start, len(self.word)
        while end not in states:
            if at >= len(words) or not states:
                return -1
            w = words[at]
            states = self._close({s + 1 for s in states if s < end and (s in self.any or self.word[s] == w)})
            at += 1
        return at

    def find(self, words: list[bytes], text: bytes, goes_on) -> bool:
        """Whether a run is accepted; text is the words with spaces around, goes_on says whether a word does so behind a hyphen, plus sign or dot."""
        anchor, at, seen, place = b" " + self.anchor + b" ", -1, 0, 0
        if anchor not in text:
            return False
        if not self.anywhere:
            return any(w in self.firsts and (end := self.accepts_at(words, i)) >= 0 and not (self.whole and goes_on(end - 1)) for i, w in enumerate(words))
        while (at := text.find(anchor, at + 1)) >= 0:  # the region before the anchor is bounded
            place += text.count(b" ", seen, at)
            seen = at
            if any(self.accepts_at(words, i) >= 0 for i in range(max(0, place - len(self.word)), place + 1)):
                return True
        return False


@lru_cache(4)
def compiled(templates: tuple[tuple[str, float, str], ...]) -> list[Automaton]:
    return [Automaton(*t) for t in templates]


def _places(text: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers where the phrase stands."""
    at, word, seen = text.find(phrase), 0, 0
    while at >= 0:
        word += text.count(b" ", seen, at)
        seen = at
        yield word
        at = text.find(phrase, at + 1)


def scan(text: str | None, phrases: list[tuple[str, str]], automata: list[Automaton]) -> tuple:
    raw = (text or "").encode()
    folded = raw.translate(ALNUM)
    words = folded.split()
    joined = b" %b " % b" ".join(words) if words else b" "
    places, base, more, ends = [], set(), {}, []
    for phrase, label in phrases:
        found = list(_places(joined, b" %b " % phrase.encode()))
        if found:
            base.add(label)
            places += found

    def goes_on(i: int) -> bool:
        if not ends:
            ends.extend(m.end() for m in re.finditer(rb"[^ ]+", folded))
        return ends[i] + 1 < len(raw) and raw[ends[i]] in GOES_ON and folded[ends[i] + 1] != 32

    for a in automata:
        if a.score > more.get(a.label, 0.0) and a.find(words, joined, goes_on):
            more[a.label] = a.score
    score = max(more.values(), default=PHRASE if base else 0.0)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more.keys())), score)


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def find_licenses(df: DataFrame, templates: list[tuple[str, float, str]] | None = None, phrases: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score (of the best template that accepts, or of a phrase alone)."""
    templates, phrases = tuple(TEMPLATES if templates is None else templates), PHRASES if phrases is None else phrases
    compiled(templates)  # errors in markup show here
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in COLUMNS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        for batch in batches:
            rows = [scan(t.as_py(), phrases, automata) for t in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["_id", *names])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, {COLUMNS}").withColumnRenamed("_id", id_col)
