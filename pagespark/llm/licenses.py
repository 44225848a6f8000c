"""License scan: token automata compiled from template markup, accepting texts whose mandatory wording matches exactly.

Markup: ``<<beginOptional>> ... <<endOptional>>`` may be absent; ``<<var;max=N>>`` stands for any N words or fewer; ``<<alt;a b|c>>``
is one of the listed wordings. Everything else is mandatory. Wording is compared word by word after the words' rule
(A-Z lower-cased, words of letters, digits and non-ASCII characters), so punctuation and line breaks never matter.

All templates and the base phrases make one token automaton (states are sets of places in templates, built when first
reached; at most ``MAX_STATES`` are remembered, beyond which they are built again). It is run from every word that can
begin a template and stops as soon as no template can go on, so a place costs at most the longest template's words. Texts are scanned as
bytes and words are counted by array arithmetic: no list of a long text's words is ever made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, packed, unpacked

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IS_WORD = bytes(int(bool(WORD.match(bytes([b])))) for b in range(256))
MARK = re.compile(r"<<(beginOptional|endOptional|var;max=\d+|alt;[^>]*)>>")
MAX_STATES = 20_000
PHRASE, STATEMENT, NOTICE = 0.5, 0.9, 1.0  # how strongly a place speaks for its label


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    weight: float


# The phrases of the contract, and the public wording of licenses and their notices.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """<<beginOptional>>3<<endOptional>> Neither the name of <<var;max=12>> nor the names of <<alt;its|the>> contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-2-clause", f"{BSD_HEAD} {BSD_TAIL}"),
    ("bsd-3-clause", f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
a copy of the License at"""),
    ("gpl-2.0-or-later", """This <<alt;program|file|library>> is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of
the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3.0-or-later", """This <<alt;program|file|library>> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."""),
    ("unlicense", """This is free and unencumbered software released into the public domain."""),
]
PUBLISHED = "<<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> <<alt;version|v>>"
STATEMENTS = [
    ("gpl-2.0", f"GNU General Public License {PUBLISHED} 2"),
    ("gpl-3.0", f"GNU General Public License {PUBLISHED} 3"),
    ("lgpl", "GNU <<alt;Lesser|Library>> General Public License"),
    ("agpl-3.0", f"GNU Affero General Public License {PUBLISHED} 3"),
    ("apache-2.0", "Apache License <<beginOptional>>version<<endOptional>> 2.0"),
    ("mit", "<<alt;released|licensed|distributed|available>> under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 <<beginOptional>>International<<endOptional>>"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0"),
    ("cc0-1.0", "CC0 1.0"),
    ("all-rights-reserved", "Copyright <<beginOptional>>(c)<<endOptional>> <<var;max=10>> all rights reserved"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
TEMPLATES = tuple([Template(*t, NOTICE) for t in NOTICES] + [Template(*t, STATEMENT) for t in STATEMENTS])
BASE = tuple(Template(*t, PHRASE) for t in PHRASES)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def parse(markup: str) -> list:
    """Items of a template: a word (bytes), ("opt", items), ("any", most words) or ("alt", [items, ...])."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*MARK.finditer(markup), None]:
        stack[-1] += words_of(markup[at:mark.start() if mark else len(markup)])
        if mark is None:
            break
        at, kind = mark.end(), mark[1]
        if kind == "beginOptional":
            stack.append([])
        elif kind == "endOptional":
            if len(stack) == 1:
                raise ValueError("an optional region ends that has not begun")
            items = stack.pop()
            if items:
                stack[-1].append(("opt", items))
        elif kind.startswith("var"):
            stack[-1].append(("any", int(kind.rsplit("=", 1)[1])))
        else:
            stack[-1].append(("alt", [words_of(a) for a in kind[4:].split("|")]))
    if len(stack) != 1:
        raise ValueError("an optional region does not end")
    if not stack[0] or not isinstance(stack[0][0], bytes) and stack[0][0][0] != "alt":
        raise ValueError("a template begins with mandatory wording")
    return stack[0]


class Automaton:
    """One token automaton of many templates; ``run`` gives the accepted templates from one word on."""

    def __init__(self, templates: Sequence[Template], max_states: int = MAX_STATES):
        self.templates, self.max_states = tuple(templates), max_states
        self.step: list[dict[bytes | None, set[int]]] = []  # of a place: word (None: any) -> places
        self.free: list[set[int]] = []
        self.accept: dict[int, int] = {}
        begin = self._place()
        for n, t in enumerate(self.templates):
            end = self._chain(begin, parse(t.markup))
            self.accept[end] = n
        self.start = self._closed({begin})
        self.vocabulary = {w for s in self.step for w in s if w is not None}
        firsts = sorted({w for p in self.start for w in self.step[p] if w is not None}, key=lambda w: (-len(w), w))
        edge = rb"[0-9a-z\x80-\xff]"
        self.first = re.compile(rb"(?<!%b)(?:%b)(?!%b)" % (edge, b"|".join(map(re.escape, firsts)), edge))
        self.known: dict[tuple[frozenset, bytes | None], frozenset] = {}

    def _place(self) -> int:
        self.step.append({})
        self.free.append(set())
        return len(self.step) - 1

    def _edge(self, at: int, word: bytes | None) -> int:
        to = self._place()
        self.step[at].setdefault(word, set()).add(to)
        return to

    def _chain(self, at: int, items: Sequence) -> int:
        for item in items:
            if isinstance(item, bytes):
                at = self._edge(at, item)
            elif item[0] == "any":
                end = self._place()
                self.free[at].add(end)
                for _ in range(item[1]):
                    at = self._edge(at, None)
                    self.free[at].add(end)
                at = end
            else:
                end = self._place()
                for branch in ([item[1]] if item[0] == "opt" else item[1]):
                    self.free[self._chain(at, branch)].add(end)
                if item[0] == "opt":
                    self.free[at].add(end)
                at = end
        return at

    def _closed(self, places: set[int]) -> frozenset:
        todo, out = list(places), set(places)
        while todo:
            for p in self.free[todo.pop()] - out:
                out.add(p)
                todo.append(p)
        return frozenset(out)

    def _next(self, state: frozenset, word: bytes) -> frozenset:
        key = (state, word if word in self.vocabulary else None)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.max_states:
                self.known.clear()
            found = self._closed({t for p in state for w in {key[1], None} for t in self.step[p].get(w, ())})
            self.known[key] = found
        return found

    def run(self, data: bytes, at: int) -> dict[int, int]:
        """Template -> number of words of its longest match that begins with the word at byte ``at``."""
        state, ends = self.start, {}
        for n, m in enumerate(WORD.finditer(data, at), 1):
            state = self._next(state, m[0])
            if not state:
                break
            for p in state & self.accept.keys():
                ends[self.accept[p]] = n
        return ends


@lru_cache(maxsize=4)
def automaton(templates: tuple[Template, ...]) -> Automaton:
    return Automaton(templates)


def scan(data: bytes, machine: Automaton) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of words, and (template, first word, words) of every place, by place and template."""
    data = data.lower()
    flags = np.frombuffer(data.translate(IS_WORD), np.uint8)

    def words_before(start: int, end: int) -> int:
        """Words that begin in data[start:end]."""
        part = flags[max(0, start - 1):end]
        return int(np.count_nonzero(part[1:] > part[:-1])) + (int(part[0]) if start == 0 and len(part) else 0)

    found, at, index = [], 0, 0
    for m in machine.first.finditer(data):
        ends = machine.run(data, m.start())
        if ends:
            index, at = index + words_before(at, m.start()), m.start()
            found += [(t, index, n) for t, n in sorted(ends.items())]
    return index + words_before(at, len(data)), found


MATCH = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("base", T.BooleanType()),
    T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType())])
MATCHES = pa.list_(pa.struct([("label", pa.string()), ("weight", pa.float64()), ("base", pa.bool_()), ("first_word", pa.int64()), ("words", pa.int64())]))


def _scanner(base: tuple[Template, ...], templates: tuple[Template, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(base + templates)
        for batch in batches:
            counts, matches = [], []
            for value in batch.column("data"):
                n, found = scan(value.as_py(), machine)
                counts.append(n)
                matches.append([{"label": machine.templates[t].label, "weight": machine.templates[t].weight, "base": t < len(base), "first_word": at,
                                 "words": k} for t, at, k in found])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts, pa.int64()), pa.array(matches, MATCHES)], ["row", "n_words", "matches"])
    return run


def find_licenses(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, base: Sequence[Template] = BASE,
                  templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``docs`` (or its columns to ``keep``) with n_words and matches (array of label, weight, base, first_word, words).

    Every place of every phrase and template in the whole text, in order; places may overlap. A template gives its longest match from a
    place. Null and empty texts have no words and no matches. Rows are judged alone, so repeats get equal results and
    an empty table gives none; result columns replace input columns of their names.
    """
    names = list(docs.columns if keep is None else keep)
    rows = packed(docs, names, data=F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))])
    return unpacked(rows.mapInArrow(_scanner(tuple(base), tuple(templates)), schema), names, ["n_words", "matches"])


def labels(matches: Column) -> Column:
    """Distinct labels in order, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def score(matches: Column) -> Column:
    """0 without a match, else the weight of the strongest one."""
    return F.coalesce(F.array_max(F.transform(matches, lambda m: m["weight"])), F.lit(0.0))


def as_regex(markup: str) -> str:
    """The same template as a regular expression over words joined by (and between) single spaces, for SQL."""
    def say(items):
        out = ""
        for item in items:
            if isinstance(item, bytes):
                out += " " + item.decode()
            elif item[0] == "any":
                out += "(?: [^ ]+){0,%d}" % item[1]
            elif item[0] == "opt":
                out += f"(?:{say(item[1])})?"
            else:
                out += "(?:" + "|".join(say(a) for a in item[1]) + ")"
        return out
    return say(parse(markup)) + " "
