"""License scans by template markup.

A template is wording with marked regions: ``<<opt>> ... <</opt>>`` may be left out, ``<<any n>>`` stands for up to ``n``
words of any kind (a name, a year). Each template is compiled into an automaton over words; a text is accepted where all
mandatory words stand exactly, in order, with nothing between them but what the regions allow. Besides, base phrases
are counted wherever their words stand consecutively.

* Words: A-Z lower-cased, runs of letters, digits and bytes outside ASCII. Null, empty and wordless texts have no words
  and no labels. Repeated rows each get their result; matches may overlap. Other columns are not read.
* The score is 1 if a template is accepted, 0.5 if only a base phrase occurs, else 0.
* ``spans`` names the label, kind, first word and number of words of every accepted template. The kind tells what was found: a
  whole licence (``text``), the notice it prescribes for files (``header``), a shorter mention (``notice``) or an SPDX line (``identifier``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialloom.llm.words import ALNUM, FOLD, slices, text_bytes

#: Base phrases and their labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

_NO_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<any 8>> be liable for any
        claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
        software or the use or other dealings in the software"""
_DISCLAIMER = """this software is provided by <<any 12>> as is and any express or implied warranties including but not limited to the
        implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 12>> be liable for
        any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
        goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
        contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
        advised of the possibility of such damage"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution """
_GPL_HEADER = """this <<any 2>> is free software you can redistribute it and or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation either version {} of the License or at your option any later version this <<any 2>> is
        distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
        fitness for a particular purpose see the GNU General Public License for more details"""
#: what SPDX identifiers are looked for
IDENTIFIERS = [
    "Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only",
    "GPL-3.0-or-later", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
]

#: Wording of public licences and their usual notices. Every template begins and ends with mandatory words.
#: ``-text`` is a whole licence up to its last clause, ``-header`` the whole notice that the licence itself prescribes for files,
#: ``-notice`` a shorter mention, ``-identifier`` an SPDX line; the last two are kinds of a match and not part of its label.
TEMPLATES = [
    ("Apache-2.0-notice", "licensed under the Apache License<<opt>>,<</opt>> Version 2.0"),
    ("Apache-2.0-notice", "under the Apache License<<opt>> Version<</opt>> 2.0"),
    ("Apache-2.0-header", """licensed under the Apache License Version 2.0 the License you may not use this <<any 3>> except in
        compliance with the License <<opt>>you may obtain a copy of the License at <<any 12>><</opt>> unless required by
        applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND either express or implied see the License for the specific language governing permissions
        and limitations under the License"""),
    ("MIT-notice", "<<opt>>released<</opt>> under the <<opt>>terms of the<</opt>> MIT License"),
    ("MIT-text", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files <<opt>>the Software<</opt>> to deal in the Software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the Software and to permit persons to
        whom the Software is furnished to do so subject to the following conditions the above copyright notice and this permission
        notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the Software """
     + _NO_WARRANTY),
    ("GPL-2.0-notice", """GNU General Public License<<opt>> as published by the Free Software Foundation<</opt>> <<opt>>either<</opt>>
        version 2"""),
    ("GPL-3.0-notice", """GNU General Public License<<opt>> as published by the Free Software Foundation<</opt>> <<opt>>either<</opt>>
        version 3"""),
    ("GPL-2.0-notice", "GNU General Public License v2"),
    ("GPL-3.0-notice", "GNU General Public License v3"),
    ("GPL-2.0-notice", "GPLv2"),
    ("GPL-3.0-notice", "GPLv3"),
    ("LGPL-notice", "LGPLv2"),
    ("LGPL-notice", "LGPLv3"),
    ("AGPL-3.0-notice", "AGPLv3"),
    ("GPL-2.0-or-later-notice", """GNU General Public License<<opt>> as published by the Free Software Foundation<</opt>> either version 2 of
        the License or <<opt>>at your option<</opt>> any later version"""),
    ("GPL-3.0-or-later-notice", """GNU General Public License<<opt>> as published by the Free Software Foundation<</opt>> either version 3 of
        the License or <<opt>>at your option<</opt>> any later version"""),
    ("GPL-2.0-or-later-header", _GPL_HEADER.format(2)),
    ("GPL-3.0-or-later-header", _GPL_HEADER.format(3)),
    ("LGPL-notice", "GNU <<opt>>Library<</opt>> Lesser General Public License"),
    ("AGPL-3.0-notice", "GNU Affero General Public License"),
    ("BSD-2-Clause-text", _BSD + _DISCLAIMER),
    ("BSD-3-Clause-text", _BSD + """<<opt>>3<</opt>> neither the name of <<any 12>> nor the names of <<any 4>> contributors may be used to endorse or
        promote products derived from this software without specific prior written permission """ + _DISCLAIMER),
    ("ISC-text", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any 8>>
        disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event
        shall <<any 8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of
        use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the
        use or performance of this software"""),
    ("MPL-2.0-header", """this source code form is subject to the terms of the Mozilla Public License v 2 0 if a copy of the MPL was not
        distributed with this file you can obtain one at <<any 2>> mozilla org MPL 2 0"""),
    ("MPL-2.0-notice", "Mozilla Public License <<opt>>version<</opt>> <<opt>>v<</opt>> 2 0"),
    ("Unlicense-text", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and
        all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to
        the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present
        and future rights to this software under copyright law """ + _NO_WARRANTY),
    ("Unlicense-notice", "this is free and unencumbered software released into the public domain"),
    ("CC0-1.0-notice", "CC0 1.0<<opt>> Universal<</opt>> Public Domain Dedication"),
    ("CC-BY-notice", "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>Creative Commons<</opt>> <<opt>>Attribution<</opt>> CC BY"),
    ("CC-BY-SA-notice", "CC BY SA"),
    ("CC-BY-NC-notice", "CC BY NC"),
    ("CC-BY-ND-notice", "CC BY ND"),
    ("CC-BY-NC-SA-notice", "CC BY NC SA"),
    ("CC-BY-NC-ND-notice", "CC BY NC ND"),
    ("CC-BY-4.0-notice", "CC BY <<opt>>NC<</opt>> <<opt>>SA<</opt>> <<opt>>ND<</opt>> 4.0"),
    ("CC-BY-notice", "Creative Commons Attribution <<any 3>> License"),
    ("proprietary-notice", "all rights reserved"),
    *[(f"{name}-identifier", f"SPDX License Identifier {name}") for name in IDENTIFIERS],
]

KINDS = ("text", "header", "notice", "identifier")
_TABLE = bytes(int(FOLD[c]) if ALNUM[c] else 32 for c in range(256))
_MARK = re.compile(r"<<(/?opt|any \d+)>>")


def words_of(text: str | bytes) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text
    return data.translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbered; ``word[s]`` leads on for one word, ``any[s]`` for whatever word, ``skip[s]`` for none."""

    label: str
    kind: str = "notice"
    word: dict[int, tuple[bytes, int]] = field(default_factory=dict)
    any: dict[int, int] = field(default_factory=dict)
    skip: dict[int, list[int]] = field(default_factory=dict)
    end: int = 0
    opening: list[bytes] = field(default_factory=list)  # mandatory words at the start
    anchor: bytes = b""  # the longest run of mandatory words, which every accepted text holds

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def accept(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words from ``start`` on."""
        states, best = self.closure({0}), None
        for at in range(start, len(words) + 1):
            if self.end in states:
                best = at
            if at == len(words):
                break
            after = {self.word[s][1] for s in states if s in self.word and self.word[s][0] == words[at]}
            after |= {self.any[s] for s in states if s in self.any}
            if not after:
                break
            states = self.closure(after)
        return best


def compile_template(label: str, markup: str) -> Automaton:
    name, _, kind = label.rpartition("-")
    if kind not in KINDS:
        name, kind = label, "notice"
    out, state = Automaton(label if kind in ("text", "header") else name, kind), 0
    opened: list[int] = []
    run: list[bytes] = []
    runs: list[list[bytes]] = [run]
    for piece in re.split(r"(<<[^>]*>>)", markup):
        mark = _MARK.fullmatch(piece)
        if not mark:
            for word in words_of(piece):
                out.word[state] = (word, state + 1)
                state += 1
                if not opened:
                    run.append(word)
            continue
        run = []
        runs.append(run)
        if mark[1] == "opt":
            opened.append(state)
        elif mark[1] == "/opt":
            out.skip.setdefault(opened.pop(), []).append(state)
        else:
            first, many = state, int(mark[1].split()[1])
            for _ in range(many):
                out.any[state] = state + 1
                state += 1
            for s in range(first, state):
                out.skip.setdefault(s, []).append(state)
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    out.end = state
    mandatory = [r for r in runs if r]
    out.opening = runs[0]
    out.anchor = b" " + b" ".join(max(mandatory, key=lambda r: len(b" ".join(r)))) + b" "
    return out


def places(joined: bytes, phrase: bytes) -> list[int]:
    """The word numbers at which ``phrase`` (with a blank at both ends) begins in blank-joined words."""
    found, at, counted, number = [], joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", counted, at)
        counted = at
        found.append(number)
        at = joined.find(phrase, at + 1)
    return found


class Scanner:
    def __init__(self, base: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.base = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in base]
        self.automata = [compile_template(label, markup) for label, markup in templates]

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        hits = [(at, label) for phrase, label in self.base for at in places(joined, phrase)]
        spans = []
        for automaton in self.automata:
            if automaton.anchor not in joined:
                continue
            opening = b" " + b" ".join(automaton.opening) + b" " if automaton.opening else None
            starts = places(joined, opening) if opening else range(len(words))
            for start in starts:
                end = automaton.accept(words, start)
                if end is not None and end > start:
                    spans.append((automaton.label, automaton.kind, start, end - start))
        base_labels = {label for _, label in hits}
        return {
            "n_words": len(words), "n_base": len(hits),
            "first_word": min((at for at, _ in hits), default=None), "last_word": max((at for at, _ in hits), default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | {s[0] for s in spans})),
            "score": 1.0 if spans else 0.5 if hits else 0.0,
            "spans": [{"label": a, "kind": k, "first_word": b, "n_words": c} for a, k, b, c in spans],
        }


def scan(docs: DataFrame, base: list[tuple[str, str]] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Labels of every row of ``docs`` (doc_id, text)."""
    base = BASE_PHRASES if base is None else base
    templates = TEMPLATES if templates is None else templates
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
             "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span}
    schema = (f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double, spans array<struct<label:string,kind:string,first_word:long,n_words:long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for part in slices(batches, "text"):
            data, bounds = text_bytes(part.column("text"))
            whole = np.ascontiguousarray(data).tobytes()
            found = [scanner.scan(whole[lo:hi]) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array([f[c] for f in found], t) for c, t in kinds.items())], ["doc_id", *kinds])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
