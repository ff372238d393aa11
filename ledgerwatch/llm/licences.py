"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

A text is scanned as a whole, paragraph by paragraph (separated by blank lines),
line by line and, where a sentence is no line or paragraph of its own, sentence by
sentence.
Templates are whole licences, the headers of source files, and the sentences of
both that say which licence it is. Each unit is normalised to lower-case ASCII words; its set of
word bigrams is compared with that of each template by Dice = 2 |A and B| /
(|A| + |B|). A Dice of t needs sizes with t / (2 - t) <= |A| / |B| <= (2 - t) / t,
which rules most templates out. Bigrams find their templates in a broadcast table
of all templates' bigrams, so common bigrams are counted and no other pair of
unit and template is ever looked at. Texts without any of the words, and units
without any of the bigrams, that a licence cannot do without are left out before. The template with
the highest Dice is the unit's licence; on ties the first listed.

Nulls and edge cases: a null or empty text, or one with fewer than two words,
has no licence and no row; units of any length are compared whole; a document
that repeats a notice gives a row for each place; rows that agree in doc_id and
text are one document; only `doc_id` and `text` are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

THRESHOLD = 0.8

#: Names and notices by which licences are declared. A constant list: it does not grow with the data.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "Apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, "
        "royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and "
        "distribute the Work and such Derivative Works in Source or Object form.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: The bodies of whole licences, without title and copyright line, and the headers that follow a notice.
MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
APACHE_REST = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License."
)
GNU_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. You should have received a copy of the GNU {0} Public License along "
    "with this program. If not, see <https://www.gnu.org/licenses/>."
)
UNLICENSE_REST = (
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
    "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
    "this software under copyright law."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
    "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be "
    "removed or altered from any source distribution."
)


def _whole() -> tuple[tuple[str, str], ...]:
    """Whole licences and headers, put together from their parts."""
    by_name = {name: text for name, text in NOTICES if len(text) > 150 and name != "MIT"}
    apache = next(text for name, text in NOTICES if name == "Apache-2.0" and "may obtain" in text)
    return (
        ("MIT", MIT_GRANT), ("MIT", f"{MIT_GRANT} {MIT_REST}"), ("ISC", ISC[0]), ("ISC", " ".join(ISC)),
        ("BSD", BSD_GRANT), ("BSD", BSD_SOURCE), ("BSD", BSD_BINARY), ("BSD-3-Clause", BSD_NAMES),
        ("BSD-2-Clause", " ".join((BSD_GRANT, "1.", BSD_SOURCE, "2.", BSD_BINARY))), ("BSD-2-Clause", " ".join((BSD_GRANT, "1.", BSD_SOURCE, "2.", BSD_BINARY, BSD_REST))),
        ("BSD-3-Clause", " ".join((BSD_GRANT, "1.", BSD_SOURCE, "2.", BSD_BINARY, "3.", BSD_NAMES))), ("BSD-3-Clause", " ".join((BSD_GRANT, "1.", BSD_SOURCE, "2.", BSD_BINARY, "3.", BSD_NAMES, BSD_REST))),
        ("Apache-2.0", f"{apache} {APACHE_REST}"), ("Unlicense", UNLICENSE_REST), ("Unlicense", f"This is free and unencumbered software released into the public domain. {UNLICENSE_REST}"), ("Zlib", ZLIB),
        *((name, f"{by_name[name]} {GNU_REST.format(kind)}") for name, kind in (("GPL-3.0-or-later", "General"), ("GPL-2.0-or-later", "General"), ("LGPL-2.1-or-later", "Lesser General"), ("AGPL-3.0-or-later", "Affero General"))),
    )


TEMPLATES = NOTICES + _whole()


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(" ".join(pair) for pair in zip(words, words[1:], strict=False)))


#: Words too frequent in any English text to look for first.
FREQUENT = frozenset("a an and any as be by can for from have if in is it not of on or that the this to was with you".split())


#: Short words that hardly stand anywhere but in licences.
NAMES = frozenset("apache bsd cc gnu isc lgpl mit mpl".split())


def one_of(words: dict[str, str]) -> str:
    """A pattern of the words, each followed by its own rest, that branches letter by letter: a position tries few branches, however many words there are."""
    branches: dict[str, dict[str, str]] = {}
    for word, rest in sorted(words.items()):
        branches.setdefault(word[:1], {})[word[1:]] = rest
    ends = branches.pop("", {}).get("")
    parts = [(first if len(after) > 1 else first + next(iter(after))) + (one_of(after) if len(after) > 1 else next(iter(after.values()))) for first, after in branches.items()]
    parts += [ends] if ends is not None else []
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def needed(templates: tuple[tuple[str, str], ...], threshold: float) -> str:
    """A pattern that every text with a licence matches.

    A unit that comes up to the threshold shares at least t / (2 - t) of a
    template's n bigrams; so of any n - ceil(n t / (2 - t)) + 1 of them it has one.
    Those with the fewest frequent words are looked for.
    """
    after: dict[str, set[str]] = {}
    for _, text in templates:
        grams = template_bigrams(text)
        count = len(grams) - math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9) + 1
        rank = sorted(grams, key=lambda g: sum(w in FREQUENT for w in g.split()))
        for gram in rank[:count]:
            first, second = gram.split()
            after.setdefault(first, set()).add(second)
    rest = {first: f"[^a-z0-9]++{one_of(dict.fromkeys(seconds, '(?![a-z0-9])'))}" for first, seconds in after.items()}
    return f"(?<![a-z0-9]){one_of(rest)}"


def telling(templates: tuple[tuple[str, str], ...], threshold: float) -> str:
    """A pattern of few words one of which every text with a licence has.

    A unit that comes up to the threshold shares at least t / (2 - t) of a
    template's bigrams. Once fewer than that are free of the words picked, it has
    one of them. Words already picked come first, then long ones of the most bigrams,
    which other texts seldom have.
    """
    picked: list[str] = []
    for _, text in templates:
        grams = [g.split() for g in template_bigrams(text)]
        need = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        while sum(not set(g) & set(picked) for g in grams) >= need:
            left = [w for g in grams if not set(g) & set(picked) for w in dict.fromkeys(g)]
            rare = [w for w in left if len(w) > 6 or w in NAMES]
            picked.append(max(dict.fromkeys(rare or [w for w in left if w not in FREQUENT] or left), key=left.count))
    return f"(?<![a-z0-9]){one_of(dict.fromkeys(picked, '(?![a-z0-9])'))}"


def bigrams(text: Column) -> Column:
    """The distinct word bigrams of a text."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))


def bigram_table(spark: SparkSession, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """(gram, template, licence, own, low, high): a row for each bigram of each template, with the sizes a like unit can have."""
    rows = []
    for k, (name, text) in enumerate(templates):
        grams = template_bigrams(text)
        low, high = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9), math.floor((2 - threshold) / threshold * len(grams) + 1e-9)
        rows += [(gram, k, name, len(grams), low, high) for gram in grams]
    return spark.createDataFrame(rows, "gram string, template int, licence string, own int, low int, high int")


def units(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, mark, unit, position, part) of the units that the pattern matches: lines, sentences that are neither lines nor paragraphs, paragraphs of several lines, and texts of several paragraphs."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).where("text is not null")
    paragraphs = F.split("text", r"\n[ \t]*\n", -1)

    def tagged(kind: str, parts: Column) -> Column:
        every = F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("position"), p.alias("part")))
        return F.filter(every, lambda s: F.lower(s["part"]).rlike(pattern))

    lines = F.split("text", "\n", -1)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(F.regexp_replace(p, r"([.!?])[ \t\n]+", "$1\x01"), "\x01", -1)))
    each = [
        tagged("line", lines),
        let(F.concat(lines, paragraphs), lambda whole: F.filter(tagged("sentence", sentences), lambda s: ~F.array_contains(whole, s["part"]))),
        F.filter(tagged("paragraph", paragraphs), lambda s: F.contains(s["part"], F.lit("\n"))),
        F.when(F.size(paragraphs) > 1, tagged("text", F.array("text"))),
    ]
    every = F.concat(*[F.coalesce(e, F.array().cast("array<struct<unit:string,position:bigint,part:string>>")) for e in each])
    return texts.select("doc_id", "mark", F.inline_outer(every)).where("part is not null")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, unit, position, licence, dice): every unit that states a licence."""
    known = bigram_table(docs.sparkSession, templates, threshold)
    # in two steps, as the second pattern is slow on the many texts that the first rules out
    lower = F.lower("text")
    docs = docs.where(F.when(lower.rlike(telling(templates, threshold)), lower.rlike(needed(templates, threshold))).otherwise(False))
    grams = units(docs, needed(templates, threshold)).select("doc_id", "mark", "unit", "position", bigrams(F.col("part")).alias("grams"))
    grams = grams.select("doc_id", "mark", "unit", "position", F.size("grams").alias("size"), F.explode_outer("grams").alias("gram"))
    # the table is a constant of the code, whatever the data
    met = grams.join(F.broadcast(known), "gram").where("size between low and high")
    shared = met.groupBy("doc_id", "mark", "unit", "position", "size", "template", "licence", "own").agg(F.size(F.collect_set("gram")).alias("shared"))
    scored = shared.withColumn("dice", 2 * F.col("shared") / (F.col("size") + F.col("own"))).where(F.col("dice") >= threshold - 1e-12)
    best = scored.groupBy("doc_id", "mark", "unit", "position").agg(F.max(F.struct("dice", -F.col("template"), "licence")).alias("best"))
    return best.select("doc_id", "unit", "position", "best.licence", F.round("best.dice", 9).alias("dice"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(name)}, {quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
    grams = """list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"""
    normal = """string_split(trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')), ' ')"""
    return f"""
WITH templates AS (SELECT k, licence, {grams} AS own FROM (SELECT k, licence, {normal} AS w FROM (VALUES {rows}) t(k, licence, part))),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS paragraphs, text FROM documents WHERE text IS NOT NULL),
said AS (SELECT doc_id, list_concat(parts, paragraphs) AS parts, flatten(list_transform(paragraphs, lambda p: string_split(regexp_replace(p, '([.!?])[ \\t\\n]+', '\\1' || chr(1), 'g'), chr(1)))) AS sentences FROM lines),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(parts))) AS position, unnest(parts) AS part FROM lines
  UNION ALL SELECT doc_id, unit, position, part FROM (SELECT doc_id, 'sentence' AS unit, unnest(range(len(sentences))) AS position, unnest(sentences) AS part, parts FROM said) WHERE NOT list_contains(parts, part)
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(paragraphs))), unnest(paragraphs) AS part FROM lines) WHERE contains(part, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM lines WHERE len(paragraphs) > 1),
grams AS (SELECT doc_id, unit, position, {grams} AS b FROM (SELECT *, {normal} AS w FROM units)),
scored AS (
  SELECT doc_id, unit, position, licence, k, 2.0 * len(list_intersect(b, own)) / (len(b) + len(own)) AS dice
  FROM grams JOIN templates ON len(b) > 0 AND len(b) <= {(2 - THRESHOLD) / THRESHOLD} * len(own) + 1e-9 AND len(b) >= {THRESHOLD / (2 - THRESHOLD)} * len(own) - 1e-9)
SELECT doc_id, unit, position, licence, round(dice, 9) AS dice FROM scored WHERE dice >= {THRESHOLD} - 1e-12
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY dice DESC, k) = 1
"""


ORACLE = _oracle()
