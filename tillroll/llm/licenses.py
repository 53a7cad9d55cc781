"""Licence scans by template markup.

A template is licence wording with optional regions (`<<beginOptional>> … <<endOptional>>`, may nest)
and replaceable regions (`<<var;words="0-12">>`, that many words of any kind).  It is compiled into an
automaton over words: mandatory wording must match word by word, an optional region may be missing, a
replaceable region takes any words.  Case, punctuation and line breaks do not count.

Texts: null counts as empty and has no words; an empty template set finds nothing.  A template must
begin with mandatory wording; every place where it is accepted counts, at its longest reading.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tillroll.llm.text import ALNUM, map_texts

WORD_TABLE = ALNUM.tobytes()
MARK = re.compile(r"<<(.*?)>>", re.S)


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    #: What a match says about the text: a mere mention less than a whole notice.
    weight: float = 1.0
    base: bool = False


# The wording of public licences.  An opening says which licence is meant; only the whole wording,
# nothing added, left out or changed, says that its terms hold.
MIT_OPENING = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words="1-12">> (the'
    ' <<var;words="1-3">>), to deal in the <<var;words="1-3">> without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, <<beginOptional>>sublicense,<<endOptional>>"
    " and/or sell copies"
)
MIT_TERMS = """
    of the <<var;words="1-3">>, and to permit persons to whom the <<var;words="1-3">>
    <<beginOptional>>is<<endOptional>> <<beginOptional>>are<<endOptional>> furnished to do so, subject to the following
    conditions: The above copyright notice and this permission notice
    <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial
    portions of the <<var;words="1-3">>."""
AS_IS = """
    THE <<var;words="1-3">> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
    LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
    SHALL <<var;words="1-10">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
    TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE <<var;words="1-3">> OR THE USE OR OTHER DEALINGS
    IN THE <<var;words="1-3">>."""
ISC_OPENING = (
    "Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>/or<<endOptional>>"
    " distribute this software for any purpose with or without fee is hereby granted, provided that the above"
    " copyright notice"
)
ISC_TERMS = """
    and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1-12">>
    DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
    FITNESS. IN NO EVENT SHALL <<var;words="1-12">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
    NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
    SOFTWARE."""
BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted"
    " <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the"
    " following conditions are met"
)
BSD_TERMS = """
    <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this
    list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form
    must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""
BSD_NAMES = """
    <<beginOptional>>3.<<endOptional>> Neither the name of <<var;words="1-12">> nor the names of
    <<var;words="1-4">> may be used to endorse or promote products derived from this software without specific prior
    written permission."""
BSD_DISCLAIMER = """
    THIS SOFTWARE IS PROVIDED BY <<var;words="1-12">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
    EVENT SHALL <<var;words="1-12">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
    DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
    STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
    EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE_OPENING = "This is free and unencumbered software released into the public domain"
UNLICENSE_TERMS = """
    Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
    form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
    that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
    the software to the public domain. We make this dedication for the benefit of the public at large and to the
    detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
    perpetuity of all present and future rights to this software under copyright law."""
ZLIB = """
    This software is provided 'as-is', without any express or implied warranty. In no event will the
    <<var;words="1-6">> be held liable for any damages arising from the use of this software. Permission is granted to
    anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
    it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software
    must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
    product, an acknowledgment in the product documentation would be appreciated but is not required.
    <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be
    misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed
    or altered from any source distribution."""
APACHE_HEADER = """
    Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;words="1-8">> except in
    compliance with the License. You may obtain a copy of the License at <<var;words="1-10">> Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
    WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
    governing permissions and limitations under the License."""

TEMPLATES = (
    Template("mit", "mit license", 0.5, True),
    Template("apache", "apache license", 0.5, True),
    Template("gpl", "general public license", 0.5, True),
    Template("mit-opening", MIT_OPENING, 0.7),
    Template("mit-text", MIT_OPENING + MIT_TERMS + AS_IS),
    Template("isc-opening", ISC_OPENING, 0.7),
    Template("isc-text", ISC_OPENING + ISC_TERMS),
    Template("bsd-opening", BSD_OPENING, 0.7),
    Template("bsd-2-text", BSD_OPENING + BSD_TERMS + BSD_DISCLAIMER),
    Template("bsd-3-text", BSD_OPENING + BSD_TERMS + BSD_NAMES + BSD_DISCLAIMER),
    Template("unlicense-opening", UNLICENSE_OPENING, 0.7),
    Template("unlicense-text", UNLICENSE_OPENING + UNLICENSE_TERMS + AS_IS),
    Template("zlib-text", ZLIB),
    Template("apache-2.0-header", APACHE_HEADER),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the License); you may not use"
        ' <<var;words="1-8">> except in compliance with the License<<endOptional>>',
    ),
    Template(
        "gpl-notice",
        'licensed under the <<beginOptional>>terms of the<<endOptional>> GNU <<var;words="0-1">> General Public'
        " License<<beginOptional>>, version<<endOptional>> <<beginOptional>>2<<endOptional>>"
        " <<beginOptional>>3<<endOptional>>",
    ),
    Template(
        "gpl-notice",
        'redistribute it and/or modify it under the terms of the GNU <<var;words="0-1">> General Public License'
        " <<beginOptional>>as published by the Free Software Foundation<<endOptional>>",
    ),
    Template(
        "mit-notice",
        'under the <<beginOptional>>terms of the<<endOptional>> MIT License <<beginOptional>>(see <<var;words="1-4">>'
        " for details)<<endOptional>>",
    ),
    Template(
        "cc-by",
        "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY"
        "<<beginOptional>>-NC<<endOptional>><<beginOptional>>-SA<<endOptional>><<beginOptional>>-ND<<endOptional>>"
        ' <<beginOptional>><<var;words="1-2">><<endOptional>>',
    ),
    Template(
        "cc-by",
        "licensed under a Creative Commons Attribution"
        "<<beginOptional>>-NonCommercial<<endOptional>><<beginOptional>>-ShareAlike<<endOptional>>"
        "<<beginOptional>>-NoDerivatives<<endOptional>> <<beginOptional>>4.0<<endOptional>>"
        " <<beginOptional>>International<<endOptional>> License",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    Template("spdx", "SPDX-License-Identifier: <<var;words=\"1-4\">>"),
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def parse(markup: str) -> list:
    """A list of words (bytes), optional regions (lists) and replaceable regions (pairs of bounds)."""
    stack: list[list] = [[]]
    for k, piece in enumerate(MARK.split(markup)):
        if k % 2 == 0:
            stack[-1].extend(split_words(piece.encode()))
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional" and len(stack) > 1:
            region = stack.pop()
            stack[-1].append(region)
        elif found := re.fullmatch(r'var;(?:.*;)?words="(\d+)-(\d+)"', piece):
            stack[-1].append((int(found[1]), int(found[2])))
        else:
            raise ValueError(f"unknown markup <<{piece}>>")
    if len(stack) > 1 or not stack[0] or not isinstance(stack[0][0], bytes):
        raise ValueError("a template begins with mandatory wording and closes its optional regions")
    return stack[0]


class Automaton:
    """Accepts sequences of words; states are sets of positions, made when first needed."""

    def __init__(self, parts: list):
        self.by_word: list[dict[bytes, int]] = []
        self.any_word: list[int | None] = []
        self.free: list[list[int]] = []
        start = self._state()
        self.final = self._build(parts, start)
        self.start = self._closure({start})
        self.steps: dict[tuple, frozenset] = {}
        self.head = b" ".join(parts[: next((k for k, p in enumerate(parts) if not isinstance(p, bytes)), len(parts))])

    def _state(self) -> int:
        self.by_word.append({})
        self.any_word.append(None)
        self.free.append([])
        return len(self.free) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, bytes):
                to = self._state()
                self.by_word[at][part] = to
            elif isinstance(part, list):
                inner = self._state()
                self.free[at].append(inner)
                to = self._build(part, inner)
                self.free[at].append(to)
            else:
                low, high = part
                leave = []
                to = at
                for k in range(high):
                    if k >= low:
                        leave.append(to)
                    nxt = self._state()
                    self.any_word[to] = nxt
                    to = nxt
                for state in leave:
                    self.free[state].append(to)
            # Later parts get edges of their own, even where two regions meet.
            at = self._state()
            self.free[to].append(at)
        return at

    def _closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if any(word in self.by_word[s] for s in states) else None)
        found = self.steps.get(key)
        if found is None:
            to = {t for s in states for t in (self.by_word[s].get(word), self.any_word[s]) if t is not None}
            found = self.steps[key] = self._closure(to)
        return found

    def match(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from `start`."""
        states, end, at = self.start, None, start
        while states:
            if self.final in states:
                end = at
            if at == len(words):
                break
            states = self.step(states, words[at])
            at += 1
        return end


class Scanner:
    def __init__(self, templates: tuple[Template, ...]):
        self.automata = [(k, Automaton(parse(t.markup))) for k, t in enumerate(templates)]
        self.heads = {}
        for k, automaton in self.automata:
            self.heads.setdefault(b" " + automaton.head + b" ", []).append((k, automaton))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and (template, first word, end) of every place, in order."""
        words = split_words(text)
        line = b" " + b" ".join(words) + b" "
        found = []
        for head, automata in self.heads.items():
            at = line.find(head)
            seen = place = 0
            while at >= 0:
                place += line.count(b" ", seen, at)
                seen = at
                for k, automaton in automata:
                    if (end := automaton.match(words, place)) is not None:
                        found.append((k, place, end))
                at = line.find(head, at + 1)
        return len(words), sorted(found, key=lambda m: (m[1], m[0]))


MATCHES = "array<struct<label:string,base:boolean,weight:double,start:bigint,stop:bigint>>"


def find_licenses(docs: DataFrame, keep: list[Column | str], templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Adds `n_words` and `matches` (places in words, end exclusive) to the columns `keep`; one pass, no shuffle."""
    import pyarrow as pa

    struct = pa.list_(
        pa.struct([("label", pa.string()), ("base", pa.bool_()), ("weight", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())])
    )
    scanner = Scanner(templates)

    def work(texts):
        counts, matches = [], []
        for text in texts:
            n, found = scanner.scan(text)
            counts.append(n)
            rows = ((templates[k], first, end) for k, first, end in found)
            matches.append([dict(label=t.label, base=t.base, weight=t.weight, start=a, stop=b) for t, a, b in rows])
        return [pa.array(counts, pa.int64()), pa.array(matches, struct)]

    return map_texts(docs, keep, [("n_words", "bigint"), ("matches", MATCHES)], work)


def as_regex(markup: str) -> str:
    """The template over words that are each followed by a blank, for checks outside Spark."""

    def form(parts):
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += part.decode() + " "
            elif isinstance(part, list):
                out += f"(?:{form(part)})?"
            else:
                out += f"(?:[^ ]+ ){{{part[0]},{part[1]}}}"
        return out

    return form(parse(markup))
