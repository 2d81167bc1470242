"""License scans by template-markup matching.

A template is license wording with marked regions, in the manner of the SPDX guidelines:

    <<beginOptional>> ... <<endOptional>>      may be there or not, nests
    <<var;name="who";original="...";match="...">>   replaceable: for .+ any wording, as many tokens as the
                                               text has, else one of the alternatives a|b|c in match
    <<notBefore;match="...">>                  at the end: not accepted where this wording follows

It is compiled to an automaton over tokens. A text is accepted where a stretch of its tokens spells
all mandatory wording exactly, in order, with optional regions whole or absent. Every place where an
automaton's first tokens occur is tried, in the whole text. Where a template has wording of any length, one
pass from a text's end finds the places that lead to acceptance.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_text, id_and_text, runs, slices, tokenize

MAX_VAR = 12  # of as_regex(), for SQL
_PART = re.compile(r"<<\s*(beginOptional|endOptional|var|notBefore)\b(.*?)>>", re.S)
_MATCH = re.compile(r"match\s*=\s*\"(.*?)\"", re.S)

# what the query's SQL compares: openings only, with regions of MAX_VAR tokens
SQL_TEMPLATES = {
    "MIT-notice": 'Released under the <<beginOptional>>terms of the<<endOptional>> MIT License<<beginOptional>>, see <<var;name="file";original="LICENSE";match=".+">> for details<<endOptional>>.',
    "Apache-2.0-notice": 'Licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0<<beginOptional>> (the "License")<<endOptional>>',
    "GPL-notice": 'This work is licensed under the GNU General Public License, <<beginOptional>>version<<endOptional>> <<var;name="version";original="3";match="2|3|2.0|3.0">>',
    "CC-notice": '<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC <<var;name="kind";original="BY";match="BY|BY-SA|BY-NC|BY-ND|BY-NC-SA|BY-NC-ND">> <<var;name="version";original="4.0";match="2.0|2.5|3.0|4.0">>',
    "all-rights-reserved": 'All rights reserved',
    "copyright-notice": 'Copyright <<beginOptional>>(c)<<endOptional>> <<var;name="holder";original="year holder";match=".+">> All rights reserved',
    "BSD-notice": 'Redistribution and use in source and binary forms, with or without modification, are permitted <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the following conditions are met',
    "MIT": 'Permission is hereby granted, free of charge, to any <<var;name="who";original="person";match="person|person or organization">> obtaining a copy of this software and associated documentation files<<beginOptional>> (the "Software")<<endOptional>>, to deal in the Software without restriction',
}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the following conditions are met:
<<beginOptional>><<var;name="1";original="1";match="1|a|i">><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>><<var;name="2";original="2";match="2|b|ii">><<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY <<var;name="who";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_BSD_THIRD = """<<beginOptional>><<var;name="3";original="3";match="3|4|c|iii">><<endOptional>> Neither the name of <<var;name="holder";original="the copyright holder";match=".+">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_FSF = """free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the %(name)s as published by the Free Software Foundation<<var;name="only";original="";match="; either|, either||;">> version %(version)s <<beginOptional>>of the License<<endOptional>><<beginOptional>>, or (at your option) any later version<<endOptional>>.
<<var;name="program";original="This program";match=".+">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the %(name)s for more details.
You should have received a copy of the %(name)s along with"""


def _fsf(name: str, versions: str) -> str:
    return _FSF % {"name": name, "version": f'<<var;name="version";original="{versions.split("|")[-1]}";match="{versions}">>'}


_MIT = """Permission is hereby granted, free of charge, to any <<var;name="who";original="person";match="person|person or organization">> obtaining a copy of this software and associated documentation files<<beginOptional>> (the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

TEMPLATES = {
    "MIT-notice": 'Released under the <<beginOptional>>terms of the<<endOptional>> MIT License<<beginOptional>>, see <<var;name="file";original="LICENSE";match=".+">> for details<<endOptional>>.',
    "Apache-2.0-notice": 'Licensed under the Apache License<<beginOptional>>, Version<<endOptional>> 2.0<<beginOptional>> (the "License")<<endOptional>>',
    "GPL-notice": 'This work is licensed under the GNU General Public License, <<beginOptional>>version<<endOptional>> <<var;name="version";original="3";match="2|3|2.0|3.0">>',
    "CC-notice": '<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a Creative Commons<<endOptional>> CC <<var;name="kind";original="BY";match="BY|BY-SA|BY-NC|BY-ND|BY-NC-SA|BY-NC-ND">> <<var;name="version";original="4.0";match="2.0|2.5|3.0|4.0">>',
    "all-rights-reserved": 'All rights reserved',
    "copyright-notice": 'Copyright <<beginOptional>>(c)<<endOptional>> <<var;name="holder";original="year holder";match=".+">> All rights reserved',
    "BSD-2-Clause": _BSD % "",
    "BSD-3-Clause": _BSD % _BSD_THIRD,
    "MIT": _MIT + '<<notBefore;match="Except as contained in this notice">>',
    "X11": _MIT + ' Except as contained in this notice, the name<<var;name="plural";original="";match="|s|(s)">> of <<var;name="holder";original="the X Consortium";match=".+">> shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization',
    "ISC": """Permission to use, copy, modify, <<var;name="and";original="and/or";match="and|and/or">> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="who";original="THE AUTHOR";match=".+">> <<var;name="s";original="DISCLAIMS";match="DISCLAIMS|DISCLAIM">> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="liable";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name="url";original="http://www.apache.org/licenses/LICENSE-2.0";match="http://www.apache.org/licenses/LICENSE-2.0|https://www.apache.org/licenses/LICENSE-2.0">>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL": _fsf("GNU General Public License", "1|2|3"),
    "LGPL": _fsf('GNU <<var;name="kind";original="Lesser";match="Lesser|Library">> General Public License', "2|2.1|3"),
    "AGPL": _fsf("GNU Affero General Public License", "3"),
}


def words(text: str) -> list[str]:
    """Tokens as common.tokenize makes them."""
    return [x for x in (re.sub(r"[\W_]+", "", w) for w in text.lower().split()) if x]


class Automaton:
    """States are numbered; edges (token, state) consume a token, moves are free. State 0 starts, `end` accepts."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[set[int]] = [set()]
        here, opened, at, self.refused = 0, [], 0, []
        for m in _PART.finditer(template):
            here = self._words(here, template[at : m.start()])
            at = m.end()
            if self.refused:
                raise ValueError("notBefore isn't at the end")
            if m[1] == "notBefore":
                self.refused = words(_MATCH.search(m[2])[1])
            elif m[1] == "beginOptional":
                opened.append(here)
                inner = self._state()
                self.free[here].add(inner)
                here = inner
            elif m[1] == "endOptional":
                if not opened:
                    raise ValueError("an optional region ends that didn't begin")
                out = self._state()
                self.free[here].add(out)
                self.free[opened.pop()].add(out)
                here = out
            else:
                here = self._variable(here, (_MATCH.search(m[2]) or [None, ".+"])[1])
        if opened:
            raise ValueError("an optional region doesn't end")
        if self.refused and words(template[at:]):
            raise ValueError("notBefore isn't at the end")
        self.end = self._words(here, template[at:])
        self.closed = [self._closure({k}) for k in range(len(self.edges))]
        if self.end in self.closed[0]:
            raise ValueError("the template has no mandatory wording")
        self.first = {t for s in self.closed[0] for t, _ in self.edges[s]}
        if None in self.first:
            raise ValueError("a template can't begin with free wording")

    def _state(self) -> int:
        self.edges.append([])
        self.free.append(set())
        return len(self.edges) - 1

    def _words(self, here: int, text: str) -> int:
        for w in words(text):
            following = self._state()
            self.edges[here].append((w, following))
            here = following
        return here

    def _variable(self, here: int, match: str) -> int:
        out = self._state()
        if match.startswith("."):
            any_ = self._state()
            self.free[here].add(any_)
            self.edges[any_].append((None, any_))
            self.free[any_].add(out)
        else:
            if re.search(r"[\[\]{}*+?^$\\]", match):
                raise ValueError(f"match is neither .+ nor alternatives: {match}")
            for choice in match.split("|"):
                self.free[self._words(here, choice)].add(out)
        return out

    def _closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def compile(self, code: dict[str, int]) -> "Automaton":
        """Fill in tokens' codes; None stands for any."""
        self.steps = [[(None if t is None else code[t], to) for s in closed for t, to in self.edges[s]] for closed in self.closed]
        self.into: dict[int | None, list[tuple[int, int]]] = {}  # by token: (state, state after it)
        for s, steps in enumerate(self.steps):
            for t, to in steps:
                self.into.setdefault(t, []).append((s, to))
        self.done = {s for s, closed in enumerate(self.closed) if self.end in closed}
        self.no = [code[t] for t in self.refused]
        return self

    def accepts(self, codes, at: int, stop: int) -> bool:
        """Whether a stretch may end before this place."""
        k = len(self.no)
        return not k or at + k > stop or list(codes[at : at + k]) != self.no

    def places(self, codes, start: int, stop: int) -> set[int]:
        """All places that an accepted stretch begins at: from the end, the states that lead to acceptance."""
        out, anyway, none = set(), self.into.get(None, []), []
        good = set(self.done) if self.accepts(codes, stop, stop) else set()
        for at in range(stop - 1, start - 1, -1):
            before = {s for s, to in self.into.get(codes[at], none) if to in good}
            before.update(s for s, to in anyway if to in good)
            if 0 in before:
                out.add(at)
            if self.accepts(codes, at, stop):
                before |= self.done
            good = before
        return out

    def longest(self, codes, start: int, stop: int) -> int:
        """End of the longest stretch accepted from start, -1 if none."""
        states, found = {0}, -1
        for at in range(start, stop):
            c = codes[at]
            states = {to for s in states for t, to in self.steps[s] if t is None or t == c}
            if not states:
                return found
            if not self.done.isdisjoint(states) and self.accepts(codes, at + 1, stop):
                found = at + 1
        return found

    def vocabulary(self) -> set[str]:
        return {t for e in self.edges for t, _ in e if t is not None}.union(self.refused)

    def free_wording(self) -> bool:
        return any(t is None for e in self.edges for t, _ in e)


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and template that it holds: doc_id, license, first_token (where the first
    accepted stretch begins, in tokens), n_tokens (of the longest stretch accepted from there), n_places
    (how many places of the document one begins at).

    Null, empty and token-free texts hold nothing; rows without doc_id are left out. Rows that repeat
    a doc_id count as one: the least first_token, the most n_tokens there, the most places. Templates may
    overlap in a text: each is reported. An empty table gives no rows. Extra columns aren't read.
    """
    automata = {name: Automaton(t) for name, t in (templates or TEMPLATES).items()}
    known = sorted({w for a in automata.values() for w in a.vocabulary()})
    code = {w: k for k, w in enumerate(known)}
    hashes = hash_text(known)
    by_hash = np.argsort(hashes)
    table = hashes[by_hash]
    for a in automata.values():
        a.compile(code)
    heads = {name: np.array([code[w] for w in a.first]) for name, a in automata.items()}

    def work(batches):
        for b in slices(batches):
            tok, doc = tokenize(b.column(1))
            at = np.minimum(np.searchsorted(table, tok), len(table) - 1)
            codes = np.where(table[at] == tok, by_hash[at], -1)
            first, lengths = runs(doc)
            begins, ends = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            begins[doc[first]], ends[doc[first]] = first, first + lengths
            ids = np.asarray(b.column(0))
            out = {k: [] for k in ("doc_id", "license", "first_token", "n_tokens", "n_places")}
            for name, a in automata.items():
                seen: dict[int, list[int]] = {}
                # a place must have a first token, followed by one that can be second
                place = np.flatnonzero(np.isin(codes, heads[name]))
                second = {t for s in a.closed[0] for _, to in a.edges[s] for x in a.closed[to] for t, _ in a.edges[x]}
                done = any(a.end in a.closed[to] for s in a.closed[0] for _, to in a.edges[s])
                if not done and None not in second:
                    place = place[place + 1 < len(codes)]
                    place = place[np.isin(codes[place + 1], [code[w] for w in second])]
                if a.free_wording():  # each text once, whatever the number of places
                    texts, first_place = np.unique(doc[place], return_index=True)
                    for k, p in zip(texts.tolist(), place[first_place].tolist()):
                        stop = int(ends[k])
                        own = codes[p:stop].tolist()
                        good = a.places(own, 0, stop - p)
                        if good:
                            low = min(good)
                            seen[k] = [p + low, p + a.longest(own, low, stop - p), len(good)]
                    place = place[:0]
                for p in place.tolist():
                    k = int(doc[p])
                    stop = a.longest(codes, p, int(ends[k]))
                    if stop >= 0:
                        if k in seen:
                            seen[k][2] += 1
                        else:
                            seen[k] = [p, stop, 1]
                for k, (p, stop, n) in seen.items():
                    for column, v in zip(out, (ids[k], name, p - begins[k], stop - p, n)):
                        out[column].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "license" else pa.int64()) for k, v in out.items()})

    found = id_and_text(docs).mapInArrow(work, "doc_id long, license string, first_token long, n_tokens long, n_places long")
    best = F.min(F.struct(F.col("first_token"), (-F.col("n_tokens")).alias("n"))).alias("b")
    return found.groupBy("doc_id", "license").agg(best, F.max("n_places").alias("n_places")).select("doc_id", "license", F.col("b.first_token").alias("first_token"), (-F.col("b.n")).alias("n_tokens"), "n_places")


def as_regex(template: str) -> str:
    """The template, its free regions of MAX_VAR tokens at most, as a regular expression over a text whose every token stands between two spaces of its own: for SQL."""
    out, at = "", 0

    def spell(text: str) -> str:
        return "".join(f" {w} " for w in words(text))

    for m in _PART.finditer(template):
        out += spell(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            out += "(?:"
        elif m[1] == "endOptional":
            out += ")?"
        elif m[1] == "notBefore":
            out += "(?!" + spell(_MATCH.search(m[2])[1]) + ")"
        else:
            match = (_MATCH.search(m[2]) or [None, ".+"])[1]
            out += "(?: [^ ]+ ){0,%d}" % MAX_VAR if match.startswith(".") else "(?:" + "|".join(spell(c) for c in match.split("|")) + ")"
    return out + spell(template[at:])
