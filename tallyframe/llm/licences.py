"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts are cut into lines and into blocks (runs of lines between blank ones, where a block has
several). Of 2 to ``RUN`` blocks in a row each run is a segment too, and so is the whole text
where it has more blocks: a licence of many paragraphs is met as a whole. A notice inside a longer
line or paragraph is met by spans: windows of as many words as the template has, anywhere in the text,
laid so that a bigram with a cover word falls where the template has it (from the text's first word on,
at the least). A span's number is its first word's. A segment's bigrams, as a set, are compared with a template's only if their numbers
allow the threshold at all: Dice >= t needs |A| between t / (2 - t) and (2 - t) / t times |B|.
Before that, a text must hold one of a few cover words. They are chosen so that the
bigrams of a template without any of them are too few for the threshold, so a text without
cover words can't match and nothing is lost.

Null and empty texts match nothing. A repeated row gives its matches again. Templates are
rows (licence, text) given by the caller, a list that fits a constant; without one, those below.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

THRESHOLD = 0.8
#: Blocks in a row that are compared together.
RUN = 6

# Notices and short licence texts as published.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_BSD_OPEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
# Whole texts, for files that leave no blank lines, and their paragraphs, for those that do.
TEMPLATES += [
    ("BSD-3-Clause", " ".join((_BSD_OPEN, _BSD_ONE, _BSD_TWO, _BSD_THREE, _BSD_END))),
    ("BSD-2-Clause", " ".join((_BSD_OPEN, _BSD_ONE, _BSD_TWO, _BSD_END))),
    ("BSD-3-Clause", " ".join((_BSD_ONE, _BSD_TWO, _BSD_THREE))),
    ("BSD-2-Clause", " ".join((_BSD_ONE, _BSD_TWO))),
    ("BSD", _BSD_OPEN),
    ("BSD", _BSD_ONE),
    ("BSD", _BSD_TWO),
    ("BSD-3-Clause", _BSD_THREE),
    ("BSD", _BSD_END),
    ("MIT", " ".join((next(t for n, t in TEMPLATES if n == "MIT" and t.startswith("Permission")), _MIT_KEEP, _MIT_END))),
    ("MIT", _MIT_KEEP),
    ("MIT", _MIT_END),
    ("ISC", " ".join((next(t for n, t in TEMPLATES if n == "ISC"), _ISC_END))),
    ("ISC", _ISC_END),
]
_UNLICENSE = [
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "For more information, please refer to <https://unlicense.org>",
]
_APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
_GPL = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
]
_ZLIB = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "3. This notice may not be removed or altered from any source distribution.",
]
TEMPLATES += [
    ("Unlicense", " ".join(_UNLICENSE)),
    ("Apache-2.0", " ".join(_APACHE)),
    ("GPL-3.0-or-later", " ".join(_GPL)),
    ("Zlib", " ".join(_ZLIB)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_END),
]

# Words too frequent in running text to spare any text as cover words.
COMMON = frozenset("a all and any as at be by can copy for from have if in into is it may no not of on or out provided subject such that the this to under use v version was with without work you".split())


def normal_words(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


def bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def cover_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words such that each template has fewer bigrams without them than a match needs in common."""
    own = [bigrams(t) for _, t in templates]
    need = [math.ceil(len(b) * threshold / (2 - threshold) - 1e-9) for b in own]
    chosen: list[str] = []
    while True:
        open_ = [[g for g in b if not set(g.split()) & set(chosen)] for b in own]
        lacking = [k for k, b in enumerate(open_) if len(b) >= need[k]]
        if not lacking:
            return chosen
        gains: dict[str, float] = {}
        for k in lacking:
            for g in open_[k]:
                for w in g.split():
                    # long words are rare in running text, and a rare cover word spares more texts
                    gains[w] = gains.get(w, 0) + (len(w) ** 2 if len(w) > 1 and w not in COMMON else 0.01)
        chosen.append(max(sorted(gains), key=gains.get))


def prepared(templates: list[tuple[str, str]]) -> list[dict]:
    return [
        {"template": k, "licence": name, "words": len(normal_words(text)), "grams": g} for k, (name, text) in enumerate(templates) if (g := bigrams(text))
    ]


def anchors(templates: list[tuple[str, str]], cover: list[str]) -> list[tuple[int, int, str]]:
    """(template, position, bigram) of the bigrams with a cover word."""
    out, known = [], set(cover)
    for k, (_, text) in enumerate(templates):
        w = normal_words(text)
        out += [(k, i, f"{a} {b}") for i, (a, b) in enumerate(zip(w, w[1:])) if a in known or b in known]
    return out


def _words(segment: Column) -> Column:
    return F.filter(F.split(F.lower(segment), "[^0-9a-z]+"), lambda x: x != "")


def _grams(words: Column) -> Column:
    return bind(words, lambda x: F.array_distinct(F.zip_with(
        F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)
    )))


def _spans(text: Column, templates: list[tuple[str, str]], cover: list[str], threshold: float) -> Column:
    """The text's windows that match; each is scored in its place, so that a text's windows never lie side by side."""
    rows = prepared(templates)
    at = {r["template"]: k for k, r in enumerate(rows)}
    places: dict[str, list[dict]] = {}
    for template, i, gram in anchors(templates, cover):
        places.setdefault(gram, []).append({"at": at[template], "pos": i})
    anchored = F.from_json(F.lit(json.dumps(places)), "map<string,array<struct<at:int,pos:int>>>")
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<template:int,licence:string,words:int,grams:array<string>>>")
    none = F.array().cast("array<struct<at:int,pos:int>>")

    def of_words(ws: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.get(ws, i).isin(cover) | F.get(ws, i + 1).isin(cover))

        def starts(i: Column) -> Column:
            own = F.try_element_at(anchored, F.concat(F.get(ws, i), F.lit(" "), F.get(ws, i + 1)))
            # template and first word in one number, so that equal ones are told by hash
            return F.transform(F.coalesce(own, none), lambda a: F.shiftleft(a["at"].cast("long"), 32) + F.greatest(i - a["pos"], F.lit(0)))

        def scored(p: Column) -> Column:
            t, start = F.get(known, F.shiftright(p, 32).cast("int")), p.bitwiseAND(F.lit(0xFFFFFFFF))
            return bind(_grams(F.slice(ws, start.cast("int") + 1, t["words"])), lambda g: F.struct(
                start.alias("segment"), t["template"].alias("template"), t["licence"].alias("licence"),
                F.size(F.array_intersect(g, t["grams"])).alias("shared"), (F.size(g) + F.size(t["grams"])).alias("total"),
            ))

        windows = F.transform(F.array_distinct(F.flatten(F.transform(spots, starts))), scored)
        return F.when(F.size(ws) > 1, F.filter(windows, lambda s: 2.0 * s["shared"] / s["total"] >= threshold))

    return bind(_words(text), of_words)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kind, segment, template, licence, shared, dice) of every segment that matches a template."""
    templates = TEMPLATES if templates is None else templates
    if not prepared(templates):
        docs = docs.where(F.lit(False))
    words = cover_words(templates, threshold)
    cover = [w for w in words if not any(u != w and u in w for u in words)]  # a text with the longer word holds the shorter one
    rows = prepared(templates)
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<template:int,licence:string,grams:array<string>>>")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    text = F.col("text")
    held = lambda c: bind(F.lower(c), lambda x: _any(x, cover))
    segment = lambda kind, k, body: F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("segment"), body.alias("body"))

    def of_blocks(blocks: Column) -> Column:
        n = F.size(blocks)
        # a run has its first block's number times RUN plus how many blocks follow
        runs = lambda k: F.transform(
            F.sequence(F.lit(1), F.least(n - k, F.lit(RUN)) - 1), lambda j: segment("run", k * RUN + j, F.array_join(F.slice(blocks, k + 1, j + 1), "\n"))
        )
        starts = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.concat(
            F.filter(F.transform(blocks, lambda x, k: segment("block", k, x)), lambda s: F.btrim(s["body"], F.lit("\n")).contains("\n")),
            F.flatten(F.transform(starts, runs)),
            F.when(n > RUN, F.array(segment("text", F.lit(0), F.array_join(blocks, "\n")))).otherwise(F.array().cast("array<struct<kind:string,segment:bigint,body:string>>")),
        )

    lines = F.transform(F.split(text, "\n"), lambda x, k: segment("line", k, x))
    segments = F.concat(lines, bind(F.split(text, "\n[\\x20\\x09-\\x0D]*\n"), of_blocks))
    suspects = docs.where(held(text)).select("doc_id", F.explode(segments).alias("s")).where(held(F.col("s.body")))
    grams = suspects.select("doc_id", "s.kind", "s.segment", _grams(_words(F.col("s.body"))).alias("grams"))
    size = F.size("grams")
    fitting = F.filter(known, lambda t: (size >= F.size(t["grams"]) * low - 1e-9) & (size <= F.size(t["grams"]) * high + 1e-9))
    pairs = grams.withColumn("t", F.explode(fitting))
    shared = F.size(F.array_intersect("grams", "t.grams"))
    scored = pairs.select(
        "doc_id", "kind", "segment", F.col("t.template").alias("template"), F.col("t.licence").alias("licence"), shared.cast("long").alias("shared"),
        (2.0 * shared / (size + F.size("t.grams"))).alias("dice"),
    )
    inside = docs.where(held(text)).select("doc_id", F.explode(_spans(text, templates, words, threshold)).alias("s")).select(
        "doc_id", F.lit("span").alias("kind"), "s.segment", "s.template", "s.licence", F.col("s.shared").cast("long").alias("shared"),
        (2.0 * F.col("s.shared") / F.col("s.total")).alias("dice"),
    )
    return scored.where(F.col("dice") >= threshold).unionByName(inside)


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, over all templates without pruning."""
    quoted = ", ".join(f"({r['template']}, '{r['licence']}', {r['words']}, [{', '.join(repr(g) for g in r['grams'])}])" for r in prepared(TEMPLATES))
    placed = ", ".join(f"({k}, {i}, '{g}')" for k, i, g in anchors(TEMPLATES, cover_words(TEMPLATES, threshold)))
    return f"""
WITH t(template, licence, words, tg) AS (VALUES {quoted}),
anchor(template, pos, gram) AS (VALUES {placed}),
texts AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(text), '[^0-9a-z]+'), lambda v: v <> '') AS ws FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT rid, i, ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(len(ws) - 1)) AS i FROM texts)),
spots AS (SELECT DISTINCT rid, template, greatest(i - pos, 0) AS start FROM pairs JOIN anchor USING (gram)),
windows AS (SELECT doc_id, template, licence, start, tg, list_slice(ws, start + 1, start + words) AS x FROM spots JOIN texts USING (rid) JOIN t USING (template)),
spans AS (SELECT doc_id, template, licence, start, tg, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS gs FROM windows),
blocks AS (SELECT doc_id, regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n') AS x FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, 'line' AS kind, unnest(range(len(x))) AS segment, unnest(x) AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)
  UNION ALL
  SELECT doc_id, kind, segment, body FROM (SELECT doc_id, 'block' AS kind, unnest(range(len(x))) AS segment, unnest(x) AS body FROM blocks)
  WHERE contains(trim(body, chr(10)), chr(10))
  UNION ALL
  SELECT doc_id, 'run', k * {RUN} + j, array_to_string(x[k + 1 : k + 1 + j], chr(10))
  FROM (SELECT doc_id, x, k, unnest(range(1, least(len(x) - k, {RUN}))) AS j FROM (SELECT doc_id, x, unnest(range(len(x) - 1)) AS k FROM blocks))
  UNION ALL
  SELECT doc_id, 'text', 0, array_to_string(x, chr(10)) FROM blocks WHERE len(x) > {RUN}
),
w AS (SELECT doc_id, kind, segment, list_filter(regexp_split_to_array(lower(body), '[^0-9a-z]+'), lambda v: v <> '') AS ws FROM parts),
g AS (SELECT doc_id, kind, segment, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gs FROM w WHERE len(ws) > 1),
s AS (SELECT doc_id, kind, segment, template, licence, len(list_intersect(gs, tg)) AS shared, len(gs) + len(tg) AS total FROM g, t
  UNION ALL SELECT doc_id, 'span', start, template, licence, len(list_intersect(gs, tg)), len(gs) + len(tg) FROM spans)
SELECT doc_id, kind, CAST(segment AS BIGINT) AS segment, CAST(template AS INTEGER) AS template, licence, CAST(shared AS BIGINT) AS shared,
       2.0 * shared / total AS dice
FROM s WHERE 2.0 * shared / total >= {threshold}
"""
