"""License scans by template markup: licenses as templates with optional and replaceable regions, as token automata.

A template is text in which ``<<opt>> ... <<end>>`` may be left out, ``<<var:n>>`` stands for one to n words of any kind
and ``<<var:n|original>>`` is the same with a note of what usually stands there. Only words count. All templates are
compiled into one automaton whose states are sets of places, worked out as texts need them; it accepts a passage if all
mandatory words stand there exactly. A template has to begin with two mandatory words, whose hashes find the places in a
text at which the automaton starts.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.session import batch, texts
from scorewright.llm.texts import chunks, shingles, words

# --- fixed values: phrases and license wordings -----------------------------------------------------------------------

BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

TEMPLATES = {
    "apache-2.0": [
        "Licensed under <<opt>>the<<end>> Apache License <<opt>>Version<<end>> 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at <<var:12|http://www.apache.org/licenses/LICENSE-2.0>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
    ],
    "gpl-3.0": ["GNU General Public License <<opt>>as published by the Free Software Foundation either<<end>> version 3"],
    "gpl-2.0": ["GNU General Public License <<opt>>as published by the Free Software Foundation either<<end>> version 2"],
    "mit": [
        "under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var:12|this software and
        associated documentation files (the "Software")>> to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>> shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:20|THE AUTHORS OR COPYRIGHT
        HOLDERS>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    ],
    "isc": [
        """Permission to use, copy, modify, <<opt>>and/or<<end>> distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies.""",
    ],
    "bsd-2-clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: <<opt>>1.<<end>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<opt>>2.<<end>> Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    ],
    "bsd-3-clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: <<opt>>1.<<end>> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<opt>>2.<<end>> Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. <<opt>>3.<<end>> Neither the name of
        <<var:20|the copyright holder>> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
    ],
    "cc-by-4.0": ["Licensed under <<opt>>a<<end>> <<opt>>Creative Commons<<end>> CC BY 4.0"],
    "cc-by-nc-4.0": ["CC BY NC 4.0"],
    "cc-by-sa-4.0": ["CC BY SA 4.0"],
    "cc-by-nd-4.0": ["CC BY ND 4.0"],
    "cc-by-nc-sa-4.0": ["CC BY NC SA 4.0"],
}

# --- compilation ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(opt|end|var:(\d+)(?:\|[^>]*)?)>>", re.S)
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ANY = ""


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(_ASCII_LOWER))


@dataclass
class Automaton:
    """Places with steps on words (ANY for every word) and free steps, and what is accepted at which place."""

    steps: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    accepts: dict[int, tuple[str, bool]] = field(default_factory=dict)
    starts: set[tuple[str, str]] = field(default_factory=set)
    known: dict[tuple[frozenset[int], str], frozenset[int]] = field(default_factory=dict)

    def _place(self) -> int:
        self.steps.append({})
        self.free.append([])
        return len(self.steps) - 1

    def _word(self, place: int, word: str) -> int:
        after = self._place()
        self.steps[place].setdefault(word, []).append(after)
        return after

    def add(self, template: str, label: str, base: bool) -> None:
        place, opened, position = 0, [], 0
        pieces = []
        for mark in _MARK.finditer(template):
            pieces += [(template[position : mark.start()], None), ("", mark)]
            position = mark.end()
        pieces.append((template[position:], None))
        first = tokens(pieces[0][0])
        for text, mark in pieces:
            for word in tokens(text):
                place = self._word(place, word)
            if mark is None:
                continue
            if mark[1] == "opt":
                opened.append(place)
            elif mark[1] == "end":
                self.free[opened.pop()].append(place)
            else:
                end = self._place()
                for _ in range(int(mark[2])):
                    place = self._word(place, ANY)
                    self.free[place].append(end)
                place = end
        if len(first) < 2 or opened or place == 0:
            raise ValueError(f"a template begins with two words and closes its regions: {template[:40]}")
        self.accepts[place] = (label, base)
        self.starts.add((first[0], first[1]))

    def closed(self, places: set[int]) -> frozenset[int]:
        todo = list(places)
        while todo:
            for after in self.free[todo.pop()]:
                if after not in places:
                    places.add(after)
                    todo.append(after)
        return frozenset(places)

    def step(self, places: frozenset[int], word: str) -> frozenset[int]:
        """One step of all places at once; what was worked out is kept, since license texts are few."""
        if (places, word) not in self.known:
            after = {a for p in places for w in (word, ANY) for a in self.steps[p].get(w, ())}
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[places, word] = self.closed(after)
        return self.known[places, word]

    def matches(self, word, start: int, count: int) -> Iterator[tuple[str, bool, int]]:
        """(label, base, end) of everything accepted from a word on; of one label the longest passage.

        :param word: a function from a place to the word there
        """
        places, at, found = self.closed({0}), start, {}
        while places and at < count:
            places = self.step(places, word(at))
            at += 1
            for place in places:
                if place in self.accepts:
                    found[self.accepts[place]] = at
        return ((label, base, end) for (label, base), end in found.items())


def compiled(base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES) -> Automaton:
    automaton = Automaton()
    for phrase, label in base.items():
        automaton.add(phrase, label, True)
    for label, wordings in templates.items():
        for wording in wordings:
            automaton.add(wording, label, False)
    return automaton


def start_hashes(automaton: Automaton) -> np.ndarray:
    pairs = [" ".join(pair) for pair in sorted(automaton.starts)]
    found = []
    for chunk in chunks(pa.array(pairs, pa.string())):
        own = words(chunk)
        found.append(shingles(own.hashes(), own.offsets, 2, short=False)[0])
    return np.unique(np.concatenate(found))


# --- scan -------------------------------------------------------------------------------------------------------------

_FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_passages long"


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """A row per row: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_passages).

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. ``n_base`` counts the places of
    base phrases, ``first_word`` and ``last_word`` are the first and last of them (null for none), counted in words.
    Labels are distinct, sorted, comma-joined, empty for none; ``labels`` has those of templates too. The score is 1 if a
    template was accepted, 0.5 if only base phrases were found, else 0. ``n_passages`` counts places from which a
    template was accepted. Null and empty texts have no words; null keys and repeated rows stay; an empty table gives
    no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(base, templates)
        begins = start_hashes(automaton)
        mask = np.zeros(1 << 16, bool)
        mask[(begins & np.uint64(0xFFFF)).astype(np.int64)] = True
        for rows in batches:
            for chunk in chunks(rows.column(1)):
                own = words(chunk)
                count = own.counts()
                pairs, offsets = shingles(own.hashes(), own.offsets, 2, short=False)
                hit = np.flatnonzero(mask[(pairs & np.uint64(0xFFFF)).astype(np.int64)])
                hit = hit[np.isin(pairs[hit], begins)]
                size = len(count)
                bases: list[list[int]] = [[] for _ in range(size)]
                labels: list[set[str]] = [set() for _ in range(size)]
                base_labels: list[set[str]] = [set() for _ in range(size)]
                passages = np.zeros(size, np.int64)
                for row, place in zip((np.searchsorted(offsets, hit, "right") - 1).tolist(), hit.tolist()):
                    first = int(own.offsets[row])

                    def word(at: int, first: int = first) -> str:
                        return own.data[own.start[first + at] : own.end[first + at]].tobytes().decode()

                    at = place - int(offsets[row])
                    accepted = False
                    for label, is_base, _ in automaton.matches(word, at, int(count[row])):
                        labels[row].add(label)
                        if is_base:
                            base_labels[row].add(label)
                            bases[row].append(at)
                        else:
                            accepted = True
                    passages[row] += accepted
                score = np.where(passages > 0, 1.0, np.where([len(b) > 0 for b in bases], 0.5, 0.0))
                yield batch(
                    _FOUND,
                    rows.column(0).slice(chunk.first, size),
                    count.astype(np.int64),
                    np.array([len(b) for b in bases], np.int64),
                    pa.array([b[0] if b else None for b in bases], pa.int64()),
                    pa.array([b[-1] if b else None for b in bases], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base_labels], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    score,
                    passages,
                )

    return texts(docs, key, text).mapInArrow(run, _FOUND)
