"""Licence notices: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.common import alnum_words, small_batches

# Phrases whose places every scan reports, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_PERMISSIVE_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY {{12}} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "[[1. ]]Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "[[2. ]]Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_COPYRIGHT = "Copyright [[(c) ]][[© ]]{{8}} [[All rights reserved ]]"

# Identifiers of the SPDX list, by label.
SPDX = {
    "agpl": ["AGPL-3.0"], "apache-2.0": ["Apache-2.0"], "boost": ["BSL-1.0"], "bsd": ["0BSD", "BSD-2-Clause", "BSD-3-Clause"], "cc-by": ["CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"],
    "cc0": ["CC0-1.0"], "epl": ["EPL-1.0", "EPL-2.0"], "eupl": ["EUPL-1.1", "EUPL-1.2"], "gpl": ["GPL-2.0", "GPL-3.0"], "isc": ["ISC"], "lgpl": ["LGPL-2.0", "LGPL-2.1", "LGPL-3.0"], "mit": ["MIT", "MIT-0"], "mpl-2.0": ["MPL-2.0"], "unlicense": ["Unlicense"], "zlib": ["Zlib"],
}


def _gnu(kind: str) -> list[str]:
    """Notices and the head of a GNU licence; ``kind`` is what stands before General."""
    name = f"GNU {kind}General Public License"
    warranty = (
        "This {{3}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the {name} for more details"
    )
    return [
        f"[[This {{{{3}}}} is ]]licensed under the {name}[[, version {{{{1}}}}]][[ or [[at your option ]]any later version]]",
        f"under the terms of the {name} as published by the Free Software Foundation",
        f"This {{{{3}}}} is free software[[;]][[:]] you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation[[;]] "
        f"either version {{{{3}}}} of the License, or [[(at your option) ]]any later version. {warranty}",
        f"{name} Version {{{{2}}}} {{{{2}}}} {{{{1}}}} Copyright (C) {{{{12}}}} Free Software Foundation",
    ]


# Wording of public licences and of notices that refer to them.  [[ ... ]] may be missing, {{n}} stands for 1 to n words.
TEMPLATES = {
    "apache-2.0": [
        "Apache License Version 2.0, January 2004",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document",
        "Licensed under the Apache License[[, Version 2.0]][[ (the License); you may not use this file except in compliance with the License]]",
        "[[This work is ]]licensed under [[the ]]Apache 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at {{12}} "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "mit": [
        "MIT License",
        "released under the MIT License",
        "licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files [[(the Software), ]]to deal in the Software without restriction",
        f"[[{_COPYRIGHT}]]Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph) ]]shall be included in all copies or substantial portions of the Software. "
        + _PERMISSIVE_WARRANTY,
    ],
    "gpl": _gnu(""),
    "lgpl": _gnu("Lesser ") + _gnu("Library "),
    "agpl": _gnu("Affero "),
    "epl": [
        "Eclipse Public License[[ -]] v[[ersion]] {{2}}",
        "under the terms of the Eclipse Public License[[ v]][[ version]] {{2}}",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License[[ v]][[ version]] {{2}} which is available at {{12}}",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT",
    ],
    "eupl": ["Licensed under the EUPL[[, Version {{2}}]]", "European Union Public Licence[[ v]][[ version]] {{2}}"],
    "cc-by": [
        "Creative Commons Attribution[[-NonCommercial]][[-ShareAlike]][[-NoDerivatives]] {{2}} International",
        "Creative Commons Attribution[[-NonCommercial]][[-ShareAlike]][[-NoDerivatives]] {{2}} Unported",
        "licensed under [[a ]]CC BY[[-NC]][[-SA]][[-ND]][[ {{2}}]]",
        "licensed under a Creative Commons Attribution[[-{{2}}]] {{3}} License",
        "This work is licensed under [[a ]][[the ]]Creative Commons Attribution[[-NonCommercial]][[-ShareAlike]][[-NoDerivatives]][[-NoDerivs]] {{3}} [[Unported ]][[International ]]License. To view a copy of this license, visit {{12}} or send a letter to Creative Commons",
    ],
    "bsd": [
        "BSD {{1}}-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted[[ provided that the following conditions are met]]",
        "licensed under the [[{{1}} clause ]]BSD License",
        f"[[{_COPYRIGHT}]]{_BSD_CONDITIONS}[[[[3. ]]Neither the name of {{{{8}}}} nor the names of [[its ]][[{{{{4}}}} ]]contributors may be used to endorse or promote products derived from this software without specific prior written permission. ]]{_BSD_WARRANTY}",
    ],
    "mpl-2.0": [
        "Mozilla Public License[[,]] Version 2.0",
        "subject to the terms of the Mozilla Public License[[, v. 2.0]]",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {{8}}",
    ],
    "isc": [
        "Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted",
        f"[[{_COPYRIGHT}]]Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND {{8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "boost": [
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means",
    ],
    "cc0": ["To the extent possible under law, {{12}} waived all copyright and related or neighboring rights to {{12}}", "licensed under [[the ]]CC0"],
    "reserved": ["[[Copyright [[(c) ]]{{6}} ]]All rights reserved"],
    "copyright": ["Copyright (c) {{1}} [[by ]]{{4}} All rights reserved"],
}

for _label, _ids in SPDX.items():
    TEMPLATES[_label] = [*TEMPLATES[_label], *(f"SPDX-License-Identifier: {x}" for x in _ids)]

#: A template that starts within so many words after one of these verbs with "not" before it says nothing of the text.
DENIED, DENIED_WORDS = {b"licensed", b"released", b"distributed", b"covered", b"available"}, 8
#: A phrase of so many words counts half.
HALF_WORDS = 2


class Automaton:
    """All templates in one automaton over words: states, word moves, moves on any word, moves without a word."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self.on_word: list[dict[bytes, list[int]]] = []
        self.on_any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, tuple[str, int]] = {}
        self._start = self._state()
        for label, texts in templates.items():
            for text in texts:
                start = self._state()
                self.free[self._start].append(start)
                literal = sum(len(alnum_words(x.encode())) for x in re.split(r"\[\[|\]\]|\{\{\d+\}\}", text))
                self.accepts[self._compile(text, start)] = (label, literal)
        self.begin = self._closure({self._start})
        #: words that can start a match; a template never starts with a replaceable region
        self.anchors = {w for s in self.begin for w in self.on_word[s]}
        #: of each of those the words that can come next, or None if any can or none must
        self.second = {w: self._next_words(w) for w in self.anchors}

    def _state(self) -> int:
        for moves, empty in ((self.on_word, {}), (self.on_any, []), (self.free, [])):
            moves.append(empty)
        return len(self.free) - 1

    def _compile(self, text: str, at: int) -> int:
        """Add a template from state ``at`` on; its last state.  Optional regions may nest."""
        opened: list[int] = []
        for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|(?:(?!\[\[|\]\]|\{\{).)+", text):
            if part == "[[":
                entry = self._state()  # of its own, so that a missing region is passed by, never entered again
                self.free[at].append(entry)
                opened.append(at)
                at = entry
            elif part == "]]":
                after = self._state()
                self.free[at].append(after)
                self.free[opened.pop()].append(after)
                at = after
            elif part.startswith("{{"):
                after, n = self._state(), int(part[2:-2])
                for _ in range(n):
                    following = self._state()
                    self.on_any[at].append(following)
                    self.free[following].append(after)
                    at = following
                at = after
            else:
                for w in alnum_words(part.encode()):
                    following = self._state()
                    self.on_word[at].setdefault(w, []).append(following)
                    at = following
        return at

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def _next_words(self, word: bytes) -> set[bytes] | None:
        states = self._closure({s for x in self.begin for s in self.on_word[x].get(word, ())})
        if any(self.on_any[s] or s in self.accepts for s in states):
            return None
        return {w for s in states for w in self.on_word[s]}

    def goes_on(self, words: list[bytes], at: int) -> bool:
        """Whether the word at a place and the next one can start a match: most places are ruled out here."""
        wanted = self.second[words[at]]
        return wanted is None or (at + 1 < len(words) and words[at + 1] in wanted)

    def match(self, words: list[bytes], at: int) -> dict[str, tuple[int, int]]:
        """By label: (literal words of the template, words matched) of the longest match from ``at`` on."""
        found: dict[str, tuple[int, int]] = {}
        states = self.begin
        for k in range(at, len(words)):
            states = self._closure({s for x in states for s in (*self.on_word[x].get(words[k], ()), *self.on_any[x])})
            if not states:
                break
            for s in states:
                if s in self.accepts:
                    label, literal = self.accepts[s]
                    found[label] = max(found.get(label, (0, 0)), (literal, k + 1 - at))
        return found


def _scanner():
    automaton = Automaton(TEMPLATES)
    phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]
    by_first: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = {}
    for words, label in phrases:
        by_first.setdefault(words[0], []).append((words, label))
    start = automaton.anchors | by_first.keys()

    def scan(text: bytes | None) -> tuple:
        words = alnum_words(text)
        places, base, labels, longest = [], set(), set(), 0
        no = [k for k, w in enumerate(words) if w == b"not" and words[k + 1 : k + 2] and words[k + 1] in DENIED]
        denied = {k + n for k in no for n in range(1, DENIED_WORDS + 1)}
        for k in [k for k, w in enumerate(words) if w in start]:
            for phrase, label in by_first.get(words[k], ()):
                if tuple(words[k : k + len(phrase)]) == phrase:
                    places.append(k)
                    base.add(label)
                    longest = max(longest, len(phrase))
            if words[k] in automaton.anchors and k not in denied and automaton.goes_on(words, k):
                for label, (_, matched) in automaton.match(words, k).items():
                    labels.add(label)
                    longest = max(longest, matched)
        first, last = (places[0], places[-1]) if places else (None, None)
        return len(words), len(places), first, last, sorted(base), sorted(base | labels), longest / (longest + HALF_WORDS)

    return scan


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels array, labels array, score) for every row.

    Base phrases are reported wherever their words stand consecutively, overlapping or not.  Labels
    also hold the templates accepted from any word on: mandatory words stand there exactly and in order,
    optional regions may be missing, replaceable ones hold any words up to their number; a template that starts
    within DENIED_WORDS words after "not licensed" and the like is no match.  score grows with
    the longest match: n / (n + 2) for n words, 0 without a match.  A null or empty text has no words, no
    labels and score 0.  Texts are read whole; repeated rows each get their row; an empty table gives an
    empty one; other columns may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = list(map(scan, batch.column(1).to_pylist()))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
    )
