"""Licence scan: Dice coefficient over word bigrams between windows of texts and licence templates."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, texts

#: Notices by which licences are declared, and the wording of short licences.
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
)
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT[0], " ".join(_MIT)),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", " ".join((*_BSD[:3], _BSD[4]))),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", " ".join(_BSD)),
    "BSD": (_BSD[0],),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.",),
}
_WORD = re.compile(rb"[a-z0-9]+")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def bigrams(w: list[bytes]) -> frozenset:
    return frozenset(zip(w, w[1:], strict=False))


def declared(w: list[bytes], known: list[tuple[str, int, frozenset]], index: dict, least: float) -> list[tuple[int, int, str, float]]:
    """(start, end, licence, dice) of the windows of a text that reach `least` and overlap none of another licence that does better."""
    at: dict[int, list[int]] = {}
    for i, g in enumerate(zip(w, w[1:], strict=False)):
        if g in index:
            for t in index[g]:
                at.setdefault(t, []).append(i)
    found = []
    for t, places in at.items():
        name, size, grams = known[t]
        # A window's Dice coefficient can't reach `least` with fewer of the template's bigrams than this.
        low = least / (2 - least) * len(grams)
        if len({(w[i], w[i + 1]) for i in places}) < low:
            continue
        for start in range(max(0, places[0] - size + 2), min(places[-1], max(0, len(w) - size)) + 1):
            if bisect.bisect_right(places, start + size - 2) - bisect.bisect_left(places, start) >= low:
                mine = bigrams(w[start : start + size])
                if (d := 2 * len(mine & grams) / (len(mine) + len(grams))) >= least:
                    found.append((start, min(start + size, len(w)), name, d))
    found.sort()
    starts, longest = [x[0] for x in found], max((e - s for s, e, _, _ in found), default=0)
    near = lambda s, e: found[bisect.bisect_left(starts, s - longest) : bisect.bisect_left(starts, e)]
    return [x for x in found if not any(y[1] > x[0] and y[2] != x[2] and y[3] > x[3] for y in near(x[0], x[1]))]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """Licences declared in every text. A text's words are runs of a-z and 0-9 in lower case, wherever its lines end. Each
    window of as many words as a template has (the whole text if it is shorter) is compared with it by the Dice coefficient
    over distinct word bigrams; one that holds too few of the template's bigrams to reach `least` is passed over. A window
    declares the template's licence unless it overlaps a window that does better for another.

    One row per document and licence: doc_id, licence, n_windows, dice (the best, six decimals). Null or empty texts and
    those of one word: no row. Null doc_id: reported with null. Repeated rows: reported each. Ties: windows that do equally
    well for several licences declare all. A very long text: its words are held by one task. Other columns, whatever their
    names, are not read. An empty table: no rows.
    """
    known = [(name, len(w), bigrams(w)) for name, ts in templates.items() for t in ts if len(w := words(t.encode())) > 1]
    index: dict = {}
    for t, (_, _, grams) in enumerate(known):
        for g in grams:
            index.setdefault(g, []).append(t)

    def run(batches):
        for ids, data, _ in pieces(batches):
            out = []
            for doc, t in zip(ids, data, strict=True):
                best: dict[str, tuple[int, float]] = {}
                for _, _, name, d in declared(words(t), known, index, least) if t else ():
                    n, was = best.get(name, (0, 0.0))
                    best[name] = (n + 1, max(d, was))
                out += [(doc, name, n, round(d, 6)) for name, (n, d) in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.string(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "licence", "n_windows", "dice"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, licence string, n_windows long, dice double")


def oracle(least: float = 0.9, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> str:
    """The same in SQL over documents."""
    rows = ", ".join("('{}', '{}')".format(name, t.replace("'", "''")) for name, ts in templates.items() for t in ts)
    cut = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH t0(licence, txt) AS (VALUES {rows}),
t1 AS (SELECT licence, row_number() OVER () AS tid, {cut.format('txt')} AS w FROM t0),
t AS MATERIALIZED (SELECT licence, tid, len(w) AS k, {pairs.format('w')} AS g FROM t1),
d AS MATERIALIZED (SELECT doc_id, {cut.format('text')} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest({pairs.format('w')}) AS x FROM d WHERE len(w) > 1),
c AS MATERIALIZED (SELECT doc_id, tid FROM b JOIN (SELECT tid, unnest(g) AS x FROM t) USING (x) JOIN t USING (tid) GROUP BY doc_id, tid, len(g) HAVING count(*) >= {least / (2 - least)} * len(g)),
s AS (SELECT doc_id, tid, licence, g, w, k, unnest(range(1, greatest(1, len(w) - k + 1) + 1)) AS i FROM c JOIN d USING (doc_id) JOIN t USING (tid)),
p AS (SELECT doc_id, tid, licence, g, i, least(i + k - 1, len(w)) AS j, w[i:i + k - 1] AS v FROM s),
q AS (SELECT doc_id, tid, licence, g, i, j, {pairs.format('v')} AS h FROM p),
r AS MATERIALIZED (SELECT doc_id, tid, licence, i, j, 2.0 * len(list_intersect(h, g)) / (len(h) + len(g)) AS dice FROM q WHERE 2.0 * len(list_intersect(h, g)) / (len(h) + len(g)) >= {least})
SELECT doc_id, licence, count(*) AS n_windows, round(max(dice), 6) AS dice FROM r AS x
WHERE NOT EXISTS (SELECT 1 FROM r AS y WHERE y.doc_id = x.doc_id AND y.licence <> x.licence AND y.i <= x.j AND y.j >= x.i AND y.dice > x.dice) GROUP BY ALL"""
