"""License texts by template-markup matching.

Templates are license wording with two kinds of markup, in the way of the
public SPDX templates: ``<<beginOptional>> ... <<endOptional>>`` may be absent,
and ``<<var;max=N>>`` stands for up to N words of any wording. Each is compiled
to a nondeterministic automaton over words. A place in a text is accepted when
the automaton runs through, that is when all mandatory words stand there
exactly. Notices, which name a license, and whole license texts have labels of
their own, so a license text whose conditions are altered is not accepted as that
license. A template's anchor, its longest run of mandatory words, is sought
first as a plain byte string, so automata run only near an anchor.

Words: A-Z lower-cased, then maximal runs of a-z, 0-9 and anything beyond ASCII.

Defined results: a null doc_id is kept as such; a null text is empty; a text without words has n_words 0, no
places, empty labels and score 0; repeated rows give repeated results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, texts_of

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices, which refer to a license, and whole license texts, all in template markup.
NOTICES = {
    "apache-2.0": "licensed under the apache license <<beginOptional>> version <<endOptional>> 2 0 <<beginOptional>> the license you may not use this file except in compliance with the license <<endOptional>>",
    "mit": "<<beginOptional>> this <<var;max=4>> is <<endOptional>> <<beginOptional>> released <<endOptional>> <<beginOptional>> licensed <<endOptional>> under the <<beginOptional>> terms of the <<endOptional>> mit license",
    "gpl-3.0": "<<beginOptional>> this <<var;max=4>> is <<endOptional>> licensed under the <<beginOptional>> terms of the <<endOptional>> gnu general public license <<beginOptional>> as published by the free software foundation <<endOptional>> <<beginOptional>> either <<endOptional>> version 3 <<beginOptional>> of the license <<endOptional>> <<beginOptional>> or <<beginOptional>> at your option <<endOptional>> any later version <<endOptional>>",
    "cc-by-nc-4.0": "licensed under <<beginOptional>> a <<endOptional>> <<beginOptional>> creative commons <<endOptional>> cc by nc 4 0 <<beginOptional>> international <<endOptional>>",
    "cc-by-4.0": "licensed under <<beginOptional>> a <<endOptional>> <<beginOptional>> creative commons <<endOptional>> cc by 4 0 <<beginOptional>> international <<endOptional>>",
    "all-rights-reserved": "<<beginOptional>> copyright <<var;max=10>> <<endOptional>> all rights reserved",
}
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_HOLDER = "<<beginOptional>> copyright <<var;max=20>> <<beginOptional>> all rights reserved <<endOptional>> <<endOptional>>"
_CONDITIONS = f"""{_HOLDER} Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>> 1 <<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>> 2 <<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
TEXTS = {
    "mit-license": f"""<<beginOptional>> <<beginOptional>> the <<endOptional>> mit license <<endOptional>> {_HOLDER}
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>> (including the next paragraph) <<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": f"{_CONDITIONS} {_DISCLAIMER}",
    "bsd-3-clause": f"{_CONDITIONS} <<beginOptional>> 3 <<endOptional>> Neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}",
    "isc-license": f"""<<beginOptional>> isc license <<endOptional>> {_HOLDER} Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED AS IS AND <<var;max=6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL <<var;max=6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-license": f"""<<beginOptional>> zlib license <<endOptional>> {_HOLDER} This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
<<beginOptional>> 1 <<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<beginOptional>> 2 <<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<beginOptional>> 3 <<endOptional>> This notice may not be removed or altered from any source distribution.""",
    "apache-2.0-header": """<<beginOptional>> copyright <<var;max=20>> <<endOptional>> Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<var;max=8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this <<var;max=4>> You can obtain one at <<beginOptional>> http <<endOptional>> <<beginOptional>> https <<endOptional>> mozilla.org/MPL/2.0/""",
    "gpl-header": """This <<var;max=8>> is free software <<beginOptional>> you can redistribute it and/or modify it <<endOptional>> under the terms of the GNU General Public License as published by the Free Software Foundation <<beginOptional>> either <<endOptional>> version <<var;max=1>> of the License
<<beginOptional>> or (at your option) any later version <<endOptional>>. This <<var;max=8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
}
#: Identifiers of licenses as words, in a file's one-line tag.
IDENTIFIERS = {
    "mit": "mit", "isc": "isc", "zlib": "zlib", "apache-2.0": "apache 2 0", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "mpl-2.0": "mpl 2 0", "cc0-1.0": "cc0 1 0",
    "gpl-2.0": "gpl 2 0", "gpl-3.0": "gpl 3 0", "lgpl-2.1": "lgpl 2 1", "lgpl-3.0": "lgpl 3 0", "agpl-3.0": "agpl 3 0",
}
TAGS = {f"spdx-{k}": f"spdx license identifier {v}" for k, v in IDENTIFIERS.items()}
TEMPLATES = NOTICES | TEXTS | TAGS

FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MARK = re.compile(r"<<([^>]*)>>|((?:(?!<<).)+)", re.S)


class Automaton:
    """A template as states: ``edges[s]`` is (word or None for any, next state), ``free[s]`` are moves without a word."""

    def __init__(self, markup: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        open_at: list[int] = []
        runs: list[tuple[int, int, list[bytes]]] = []  # mandatory runs: words before at most, length, words
        before, run = 0, []

        def state() -> int:
            self.edges.append([])
            self.free.append([])
            return len(self.edges) - 1

        now = 0
        for mark, wording in MARK.findall(markup):
            for word in wording.encode().translate(FOLD).split():
                new = state()
                self.edges[now].append((word, new))
                now = new
                if not open_at:
                    run.append(word)
                before += 1
            if not mark:
                continue
            if run:
                runs.append((before - len(run), len(run), run))
                run = []
            if mark == "beginOptional":
                new = state()
                self.free[now].append(new)
                open_at.append(now)
                now = new
            elif mark == "endOptional":
                new = state()
                self.free[now].append(new)
                self.free[open_at.pop()].append(new)
                now = new
            else:
                most = int(mark.partition("max=")[2])
                end = state()
                self.free[now].append(end)
                for _ in range(most):
                    new = state()
                    self.edges[now].append((None, new))
                    self.free[new].append(end)
                    now = new
                now = end
                before += most
        if run:
            runs.append((before - len(run), len(run), run))
        if open_at or not runs:
            raise ValueError("a template needs closed optional parts and mandatory words")
        self.final = now
        self.before, _, words = max(runs, key=lambda r: r[1])
        self.anchor = b" " + b" ".join(words) + b" "

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def accept(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted place from ``start``, or -1."""
        states, end, i = self.closure({0}), -1, start
        while states:
            if self.final in states:
                end = i
            if i == len(words):
                break
            word = words[i]
            states = self.closure({t for s in states for w, t in self.edges[s] if w is None or w == word})
            i += 1
        return end

    def places(self, words: list[bytes], joined: bytes):
        """Accepted places, leftmost start and then longest, not overlapping."""
        done = 0
        for word in word_places(joined, self.anchor):
            for start in range(max(done, word - self.before), word + 1):
                if (end := self.accept(words, start)) > word:
                    yield start, end
                    done = end
                    break


def word_places(joined: bytes, sought: bytes):
    """The indexes of the words at which ``sought`` begins, in a time that follows the text's length."""
    at, last, word = joined.find(sought), 0, 0
    while at >= 0:
        word += joined.count(b" ", last, at)
        yield word
        last = at
        at = joined.find(sought, at + 1)


def scan(text: str, automata: dict[str, Automaton]) -> tuple:
    words = text.encode().translate(FOLD).split()
    if not words:
        return 0, 0, None, None, [], [], [], 0.0
    joined = b" " + b" ".join(words) + b" "
    starts, base, places = [], set(), []
    covered: list[tuple[int, int]] = []
    for phrase, label in PHRASES.items():
        sought, n = b" " + phrase.encode() + b" ", phrase.count(" ") + 1
        for i in word_places(joined, sought):
            starts.append(i)
            covered.append((i, i + n))
            base.add(label)
    for label, automaton in automata.items():
        for start, end in automaton.places(words, joined):
            places.append({"label": label, "start": start, "end": end})
            covered.append((start, end))
    share, last = 0, 0
    for start, end in sorted(covered):
        share += max(0, end - max(start, last))
        last = max(last, end)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | {p["label"] for p in places}), places, share / len(words)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row a document: n_words, n_base, first_word, last_word, base_labels, labels (arrays), places, score.

    ``score`` is the share of the words that accepted places cover.
    """
    source = texts_of(docs, id_col, text_col)
    markup = TEMPLATES if templates is None else templates
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "places", "score"]
    types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.list_(place), pa.float64()]

    def make():
        automata = {k: Automaton(v) for k, v in markup.items()}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = zip(*(scan(t, automata) for t in batch.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

        return step

    kinds = ["long"] * 4 + ["array<string>"] * 2 + ["array<struct<label:string,start:bigint,end:bigint>>", "double"]
    return per_batch(source, make, f"doc_id {dict(source.dtypes)['doc_id']}, " + ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))
