"""License scan: phrases, and license texts matched against templates with optional and replaceable regions.

A template is text with marks: ``<<beginOptional>> ... <<endOptional>>`` encloses words that may be missing, and
``<<var;name=...;words=N>>`` stands for up to N words of any kind. It is compiled into an automaton over words whose
states are bits of one number. Its anchor, the longest run of mandatory words, is looked up first; from there the
automaton of what follows runs forward and that of what precedes, reversed, runs backward. A place is accepted if
both reach their end: all mandatory wording stands there exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import slices

# The phrases to count and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_O, _E = "<<beginOptional>>", "<<endOptional>>"
_Q, _HOLDER = "<<var;name=quote;words=1>>", "<<var;name=holder;words=30>>"
_UNDER = f"{_O}This <<var;name=work;words=4>> is{_E} {_O}dual{_E} {_O}licensed{_E} {_O}released{_E} {_O}distributed{_E} {_O}available{_E} under {_O}the terms of{_E}"
_NO_WARRANTY = (
    f"THE SOFTWARE IS PROVIDED {_Q}AS IS{_Q}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE <<var;name=who;words=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_FIRST = (
    f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: {_O}1{_E} "
    f"Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. {_O}2{_E} "
    f"Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_LAST = (
    f"THIS SOFTWARE IS PROVIDED BY <<var;name=who;words=16>> {_Q}AS IS{_Q} AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL <<var;name=who;words=16>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, version: str) -> str:
    """The notice that the Free Software Foundation asks for."""
    return (
        f"{_O}This program{_E} {_O}<<var;name=work;words=6>>{_E} is free software{_O};{_E} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. {_O}This program{_E} {_O}<<var;name=work;words=6>>{_E} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


#: label -> template: the wording of licenses, and of the notices that refer to them.
TEMPLATES = {
    "agpl-3.0-header": _gnu("GNU Affero General Public License", "3"),
    "apache-2.0-header": (
        f"Licensed under the Apache License, Version 2.0 (the {_Q}License{_Q}); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name=url;words=8>> "
        f"Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an {_Q}AS IS{_Q} BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-notice": f"{_UNDER} {_O}the{_E} Apache License{_O},{_E} {_O}Version{_E} 2.0{_O} (the {_Q}License{_Q}){_E}",
    "bsd-2-clause": _BSD_FIRST + _BSD_LAST,
    "bsd-3-clause": (
        f"{_BSD_FIRST} {_O}3{_E} Neither the name of <<var;name=who;words=16>> nor the names of {_O}its{_E} {_O}the{_E} {_O}other{_E} contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_LAST}"
    ),
    "cc-by-4.0-notice": f"{_UNDER} {_O}a{_E} {_O}the{_E} Creative Commons Attribution 4.0 {_O}International{_E} {_O}Public{_E} License",
    "cc-by-nc-4.0-notice": f"{_UNDER} {_O}the{_E} {_O}a Creative Commons Attribution NonCommercial 4.0 International License{_E} {_O}license{_E} CC BY-NC 4.0",
    "cc-by-sa-4.0-notice": f"{_UNDER} {_O}a{_E} {_O}the{_E} Creative Commons Attribution{_O}-{_E}ShareAlike 4.0 {_O}International{_E} {_O}Public{_E} License",
    "gpl-2.0-header": _gnu("GNU General Public License", "2"),
    "gpl-3.0-header": _gnu("GNU General Public License", "3"),
    "gpl-3.0-notice": f"{_UNDER} the GNU General Public License{_O},{_E} {_O}as published by the Free Software Foundation, either{_E} version 3{_O} of the License, or (at your option) any later version{_E}",
    "isc": (
        f"Permission to use, copy, modify, and{_O}/or{_E} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        f"THE SOFTWARE IS PROVIDED {_Q}AS IS{_Q} AND <<var;name=who;words=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL <<var;name=who;words=12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-2.1-header": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0-header": _gnu("GNU Lesser General Public License", "3"),
    "mit": (
        f"{_O}MIT License{_E} {_O}Copyright (c) {_HOLDER}{_E} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        f"documentation files (the {_Q}Software{_Q}), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        f"The above copyright notice and this permission notice {_O}(including the next paragraph){_E} shall be included in all copies or substantial portions of the Software. {_NO_WARRANTY}"
    ),
    "mit-notice": f"{_UNDER} {_O}the{_E} {_O}terms of the{_E} MIT License",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name=url;words=8>>"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        f"This software is provided {_Q}as-is{_Q}, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        f"{_O}1{_E} The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        f"{_O}2{_E} Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. {_O}3{_E} This notice may not be removed or altered from any source distribution."
    ),
}

_SPLIT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPLIT).split()


# ---- templates ---------------------------------------------------------------------------------------------------


def parse(template: str) -> list:
    """The template as a list of words (bytes), ("any", n) and ("optional", list)."""
    stack: list[list] = [[]]
    for part in re.split(r"(<<.*?>>)", template):
        if part == _O:
            stack.append([])
        elif part == _E:
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif part.startswith("<<var"):
            stack[-1].append(("any", int(re.search(r"words=(\d+)", part)[1])))
        else:
            stack[-1].extend(words_of(part))
    if len(stack) != 1:
        raise ValueError("optional regions are not closed")
    return stack[0]


def as_regex(parts: list) -> str:
    """The same language over words that each follow one blank."""
    out = ""
    for p in parts:
        if isinstance(p, bytes):
            out += " " + p.decode()
        elif p[0] == "any":
            out += f"(?: [^ ]+){{0,{p[1]}}}"
        else:
            out += f"(?:{as_regex(p[1])})?"
    return out


@dataclass
class Automaton:
    """States are bits; takes[word] are the states that the word leaves, any the states that every word leaves, and a
    state's only way on is the next bit. skip[s] has s and the states reached from it without a word."""

    takes: dict[bytes, int] = field(default_factory=dict)
    any: int = 0
    skip: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, parts: list) -> Automaton:
        out, free = cls(), []
        size = 0

        def walk(parts: list) -> None:
            nonlocal size
            for p in parts:
                at = size
                if isinstance(p, bytes):
                    out.takes[p] = out.takes.get(p, 0) | 1 << at
                    size += 1
                elif p[0] == "any":
                    for k in range(p[1]):
                        out.any |= 1 << (at + k)
                        free.append((at + k, at + p[1]))
                    size += p[1]
                else:
                    walk(p[1])
                    free.append((at, size))

        walk(parts)
        to: dict[int, set[int]] = {}
        for a, b in free:
            to.setdefault(a, set()).add(b)
        out.skip = [0] * (size + 1)
        for s in range(size, -1, -1):
            out.skip[s] = 1 << s
            for b in to.get(s, ()):
                out.skip[s] |= out.skip[b] if b > s else 0
        return out

    def reach(self, words: list[bytes], at: int, step: int) -> int | None:
        """The furthest place to which the words from ``at`` on, in steps of 1 or -1, are accepted; None if nowhere."""
        end = 1 << (len(self.skip) - 1)
        now, found = self.skip[0], None
        while True:
            if now & end:
                found = at
            if not 0 <= at < len(words):
                return found
            moved = (now & (self.takes.get(words[at], 0) | self.any)) << 1
            if not moved:
                return found
            now = 0
            while moved:
                low = moved & -moved
                now |= self.skip[low.bit_length() - 1]
                moved ^= low
            at += step


def _reversed(parts: list) -> list:
    return [("optional", _reversed(p[1])) if isinstance(p, tuple) and p[0] == "optional" else p for p in reversed(parts)]


class Template:
    def __init__(self, label: str, text: str) -> None:
        self.label, self.parts = label, parse(text)
        runs, k = [], 0
        while k < len(self.parts):
            n = k
            while n < len(self.parts) and isinstance(self.parts[n], bytes):
                n += 1
            if n > k:
                runs.append((sum(map(len, self.parts[k:n])), k, n))
            k = max(n, k + 1)
        if not runs:
            raise ValueError(f"{label}: no mandatory words")
        _, lo, hi = max(runs, key=lambda r: (r[0], -r[1]))
        self.anchor = self.parts[lo:hi]
        self.before, self.after = Automaton.of(_reversed(self.parts[:lo])), Automaton.of(self.parts[hi:])

    def spans(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """(first word, word after the last) at every place of the anchor that is accepted."""
        out = []
        for at in places(self.anchor, joined):
            start, end = self.before.reach(words, at - 1, -1), self.after.reach(words, at + len(self.anchor), 1)
            if start is not None and end is not None:
                out.append((start + 1, end))
        return out


def places(phrase: list[bytes], joined: bytes) -> list[int]:
    """Word numbers at which the phrase stands in words joined by (and enclosed in) blanks."""
    mark, out, at, word, since = b" " + b" ".join(phrase) + b" ", [], 0, 0, 0
    while (at := joined.find(mark, at)) >= 0:
        word += joined.count(b" ", since, at)
        since = at
        out.append(word)
        at += 1
    return out


# ---- operator ----------------------------------------------------------------------------------------------------

_OUT = "id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,end:int>>"


def _scanned(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    base = [(words_of(p), label) for p, label in phrases.items()]
    compiled = [Template(label, text) for label, text in templates.items()]
    keys = {max(p, key=len) for p, _ in base} | {max(t.anchor, key=len) for t in compiled}
    screen = re.compile(b"|".join(map(re.escape, sorted(keys))))
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
    for b in slices(batches, "text"):
        rows = []
        for text in b.column("text").to_pylist():
            flat = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPLIT)
            words = flat.split()
            if not screen.search(flat):
                rows.append((len(words), 0, None, None, "", "", 0.0, []))
                continue
            joined = b" " + b" ".join(words) + b" "
            starts, labels, spans = [], set(), []
            for phrase, label in base:
                if at := places(phrase, joined):
                    starts += at
                    labels.add(label)
                    spans += [{"label": label, "first": k, "end": k + len(phrase)} for k in at]
            more = set()
            for t in compiled:
                for lo, hi in t.spans(words, joined):
                    more.add(t.label)
                    spans.append({"label": t.label, "first": lo, "end": hi})
            rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if more else 0.5 if labels else 0.0, spans))
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of ``docs``.

    n_base: places where a phrase's words stand consecutively; first_word and last_word: their smallest and largest
    start. base_labels: labels of the phrases found; labels: those and the labels of the templates accepted; both
    sorted and joined by commas, empty if there are none. score: 1 with a template, 0.5 with phrases only, else 0.
    spans: where each was found, in words. A null text is empty. Null ids and repeated rows stay; an empty table gives
    an empty result; other columns are not read."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(lambda batches: _scanned(batches, phrases, templates), _OUT.format(id=source.schema["id"].dataType.simpleString()))
    return out.withColumnRenamed("id", id_col)


def license_sql() -> str:
    """DuckDB SQL for the same columns but spans; templates become regular expressions over joined words."""

    def at(phrase: str) -> str:
        own = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(own))
        return f"list_filter(range(1, len(w) - {len(own) - 2}), lambda i: {test})"

    some = ", ".join(f"{at(p)} AS p{k}" for k, p in enumerate(PHRASES))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))
    more = ", ".join(f"CASE WHEN regexp_matches(j, '{as_regex(parse(t))} ') THEN '{label}' END" for label, t in TEMPLATES.items())
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j, {some} FROM d
), l AS (
  SELECT doc_id, len(w) AS n, {every} AS starts, list_filter([{base}], lambda x: x IS NOT NULL) AS b, list_filter([{more}], lambda x: x IS NOT NULL) AS t FROM p
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) - 1 AS BIGINT) AS first_word, CAST(list_max(starts) - 1 AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(b)), ',') AS base_labels, array_to_string(list_sort(list_distinct(b || t)), ',') AS labels,
  CAST(CASE WHEN len(t) > 0 THEN 1 WHEN len(b) > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM l
"""
