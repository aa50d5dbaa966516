"""License scans by patience alignment.

Where a text holds many words of a license template close together, the two are aligned: words that
occur once in both are anchors, the longest increasing run of them is kept, and the gaps between
kept anchors, and before and after them, are aligned the same way.  The share of the template's
words that find a partner is its coverage.  The words that name the license (``NAMES``) must all
find one, side by side.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Public license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY NC 4.0.",
        "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer.",
        "Released under the BSD License.",
        "Released under the BSD 2-Clause License.",
        "Released under the BSD 3-Clause License.",
    ],
    "ISC": ["Released under the ISC License."],
    "Apache-1.1": ["Licensed under the Apache License, Version 1.1."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is licensed under the Creative Commons CC0 1.0 Universal License."],
}

#: Phrases that tell a license from its neighbours: wherever a template holds one, the text must hold it unbroken.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0"],
    "Apache-1.1": ["Apache License, Version 1.1"],
    "MIT": ["MIT License"],
    "GPL-3.0": ["GNU General Public License", "version 3"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC BY NC 4.0", "Attribution-NonCommercial 4.0", "Attribution NonCommercial 4.0"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License", "Version 2.0", "v. 2.0"],
    "CC0-1.0": ["CC0 1.0"],
}
for _license, _kind, _version in (("GPL-2.0", "", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
    NAMES[_license] = [f"GNU {_kind}General Public License", f"version {_version}"]
    TEMPLATES[_license] = [t.replace("GNU ", f"GNU {_kind}").replace("version 3", f"version {_version}") for t in TEMPLATES["GPL-3.0"]]
for _license, _short, _long in (("CC-BY-4.0", "BY", "Attribution"), ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"),
                                ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives"),
                                ("CC-BY-NC-SA-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                                ("CC-BY-NC-ND-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    NAMES[_license] = [f"CC {_short} 4.0", f"{_long} 4.0"]
    TEMPLATES[_license] = [f"Licensed under CC {_short} 4.0.",
                           f"This work is licensed under the Creative Commons {_long} 4.0 International License."]

TEMPLATES["BSL-1.0"] = ["Boost Software License - Version 1.0"]
NAMES["BSL-1.0"] = ["Boost Software License"]
TEMPLATES["MIT"] += [
    "The MIT License (MIT)",
    TEMPLATES["MIT"][1] + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
    "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
TEMPLATES["ISC"] += [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
    "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]
TEMPLATES["BSD"] += [
    TEMPLATES["BSD"][0] + " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
    "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]

#: Short forms by which a license is named after "Licensed under" or "Released under", with or without "the".
SHORT_FORMS = {
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache License v2.0"],
    "MIT": ["MIT License"],
    "GPL-2.0": ["GPLv2", "GPL v2", "GNU GPL v2", "GNU GPLv2"],
    "GPL-3.0": ["GPLv3", "GPL v3", "GNU GPL v3", "GNU GPLv3"],
    "LGPL-2.1": ["LGPLv2.1"],
    "LGPL-3.0": ["LGPLv3"],
    "AGPL-3.0": ["AGPLv3"],
    "MPL-2.0": ["MPL 2.0", "Mozilla Public License 2.0"],
    "BSL-1.0": ["Boost Software License 1.0"],
}
for _license, _forms in SHORT_FORMS.items():
    NAMES[_license] = [*NAMES[_license], *[f for f in _forms if f not in NAMES[_license]]]
    TEMPLATES[_license] = TEMPLATES[_license] + [t for f in _forms for verb in ("Licensed", "Released") for the in ("", "the ")
                                                 if (t := f"{verb} under {the}{f}.") not in TEMPLATES[_license]]

#: Identifiers of the tag line, where they aren't the license's key alone.
IDENTIFIERS = {"BSD": ["BSD-2-Clause", "BSD-3-Clause"]} | {
    k: [k, f"{k}-only", f"{k}-or-later"] for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
for _license in TEMPLATES:
    _tags = [f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS.get(_license, [_license])]
    NAMES[_license], TEMPLATES[_license] = NAMES[_license] + _tags, TEMPLATES[_license] + _tags

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


WHOLE = re.compile(r"([0-9]+)(?:\.0)+")


def fold(word: str) -> str:
    """Lower case; versions such as 3.0 and 3 are the same."""
    m = WHOLE.fullmatch(word)
    return m[1] if m else word.lower()


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
        back.append(ends[k - 1] if k else -1)
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1 and ca.get(w) == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        kept = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False) if p + 1 < q and r + 1 < s]
    return sorted(out)


@dataclass(frozen=True)
class Match:
    license: str
    template: int
    start: int      # character offsets of the aligned part
    past: int
    matched: int
    coverage: float


class Scanner:
    """Finds templates in texts; ``templates`` are notices by license name."""

    def __init__(self, templates: dict[str, list[str]], least: float = 0.8, names: dict[str, list[str]] | None = None):
        self.least = least
        names = NAMES if names is None else names
        self.templates = [(name, k, [fold(w) for w in WORD.findall(t)]) for name, ts in templates.items() for k, t in enumerate(ts)]
        self.templates = [t for t in self.templates if t[2]]
        self.named = [self._places(words, names.get(name, ())) for name, _, words in self.templates]
        self.needed = [{words[i] for a, b in at for i in range(a, b)} for (_, _, words), at in zip(self.templates, self.named, strict=True)]
        self.of_words: dict[tuple[int, ...], dict[str, list[int]]] = {}

    @staticmethod
    def _places(words: list[str], names: Iterable[str]) -> list[tuple[int, int]]:
        """Where the template holds the names: (first word, past)."""
        out = []
        for name in names:
            own = [fold(w) for w in WORD.findall(name)]
            out += [(i, i + len(own)) for i in range(len(words) - len(own) + 1) if words[i:i + len(own)] == own][:1]
        return out

    def _of_word(self, present: set[str]) -> dict[str, list[int]]:
        """Words of the templates whose names the text can hold."""
        live = tuple(i for i, needed in enumerate(self.needed) if needed <= present)
        if live not in self.of_words:
            self.of_words[live] = {}
            for i in live:
                for w in set(self.templates[i][2]):
                    self.of_words[live].setdefault(w, []).append(i)
        return self.of_words[live]

    def _holds_names(self, t: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether each name of the template is aligned whole, with nothing in between."""
        if not self.named[t]:
            return True
        place = {j: i for i, j in pairs}
        return all(all(j in place and place[j] - j == place.get(a, 0) - a for j in range(a, b)) for a, b in self.named[t])

    def scan(self, text: str | None) -> list[Match]:
        """Matches of at least the least coverage.  Of overlapping ones the one with most matched words
        stays, then the one with the higher coverage."""
        if not text:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        words = [fold(text[a:b]) for a, b in spans]
        of_word = self._of_word(set(words))
        hits: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for t in of_word.get(w, ()):
                hits.setdefault(t, []).append(i)
        found = []
        for t, at in hits.items():
            found += self._windows(t, at, words, spans)
        found.sort(key=lambda m: (-m.matched, -m.coverage, m.start, m.license))
        kept: list[Match] = []
        for m in found:
            if all(m.past <= k.start or m.start >= k.past for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m.start)

    def _windows(self, t: int, at: list[int], words: list[str], spans: list[tuple[int, int]]) -> Iterator[Match]:
        """Aligns where enough of the template's words lie within its length and a quarter."""
        name, k, template = self.templates[t]
        size, need = len(template), self.least * len(template)
        reach = size + max(2, size // 4)
        first, last = 0, 0
        while first < len(at):
            while last < len(at) and at[last] < at[first] + reach:
                last += 1
            # a window with too few of the template's words can't reach the coverage
            if last - first >= need:
                pairs = patience(words[at[first]:at[first] + reach], template)
                if len(pairs) >= need and self._holds_names(t, pairs):
                    a, b = at[first] + pairs[0][0], at[first] + pairs[-1][0]
                    yield Match(name, k, spans[a][0], spans[b][1], len(pairs), len(pairs) / size)
            first += 1


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, license, template, start, past, matched, coverage): a row for each notice found in a whole
    text; start and past are character offsets.

    NULL and empty texts hold none; repeated rows give equal rows; other columns are ignored; an empty
    table gives an empty result."""
    templates = TEMPLATES if templates is None else templates
    common.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    fields = [src.schema[0], *[T.StructField(n, t) for n, t in (
        ("license", T.StringType()), ("template", T.IntegerType()), ("start", T.LongType()), ("past", T.LongType()),
        ("matched", T.LongType()), ("coverage", T.DoubleType()))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for b in batches:
            rows = [(i, m) for i, t in enumerate(b.column(1).to_pylist()) for m in scanner.scan(t)]
            ms = [m for _, m in rows]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([m.license for m in ms], pa.string()),
                pa.array([m.template for m in ms], pa.int32()), pa.array([m.start for m in ms], pa.int64()),
                pa.array([m.past for m in ms], pa.int64()), pa.array([m.matched for m in ms], pa.int64()),
                pa.array([m.coverage for m in ms], pa.float64())], [f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))
