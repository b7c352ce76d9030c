"""Licence scans by Dice coefficient over word bigrams. DataFrame operations only.

The units of a text are its lines, its paragraphs of more than one line
(between blank lines; a line of comment marks is blank), and windows of a
template's own number of words, so that a notice is found on one line, wrapped,
in comments or within prose. A unit is folded to lower case with everything but
a-z and 0-9 as a space; its set of word bigrams A is held against each
template's set B. The coefficient 2|A∩B| / (|A|+|B|) reaches LEAST_DICE only if
|A| is between |B| LEAST_DICE / (2 - LEAST_DICE) and |B| (2 - LEAST_DICE) /
LEAST_DICE, so sizes prune templates before any intersection; so does an empty
overlap with all templates together.

A unit that reaches LEAST_DICE has |B| LEAST_DICE / (2 - LEAST_DICE) bigrams of
the template. Each template has anchors: its most telling bigrams, one more than
such a unit can lack. A text without any anchor has no hit, which one look at the
text settles. A window may begin at any word; those are compared that hold as
many words of bigrams of the template as a hit needs, which the places of these
bigrams in the text show. Of each text and template the best window is shown (of
equal ones the first), with the number of words before it as unit_no.

Everything is a projection of the document's own row: there is no shuffle, texts
with an anchor are written once, and a text of any length or a source of any size
costs its own words. A null, empty or one-word unit has no bigrams and matches nothing.
Repeated and null doc_ids are rows of their own, and a unit that matches several
templates has a row for each. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sweeps import any_of
from .shared import written

LEAST_DICE = 0.8

# The wording of licence notices and of short references to licences.
TEMPLATES = (
    ("MIT", "reference", "Released under the MIT License."),
    ("MIT", "terms", "This project is licensed under the terms of the MIT License."),
    ("Apache-2.0", "reference", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "reference", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "reference", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "reference", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "reference", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "reference", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "reference", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "reference", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "reference", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "reference", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "reference", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "reference", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "reference", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("ISC", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD", "source condition", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "binary condition", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "warranty", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("BSL-1.0", "reference", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("LGPL-3.0", "notice", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "copy", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
)

#: Whole licences and whole file headers, put together from the parts above.
WHOLE = (
    ("MIT", "whole", (("MIT", "grant"), ("MIT", "condition"), ("MIT", "warranty"))),
    ("ISC", "whole", (("ISC", "grant"), ("ISC", "warranty"))),
    ("BSD-2-Clause", "whole", (("BSD", "grant"), ("BSD", "source condition"), ("BSD", "binary condition"), ("BSD", "warranty"), ("BSD", "liability"))),
    ("BSD-3-Clause", "whole", (("BSD", "grant"), ("BSD", "source condition"), ("BSD", "binary condition"), ("BSD-3-Clause", "endorsement"), ("BSD", "warranty"), ("BSD", "liability"))),
    ("Apache-2.0", "header", (("Apache-2.0", "notice"), ("Apache-2.0", "warranty"))),
    ("GPL-3.0", "header", (("GPL-3.0", "notice"), ("GPL", "warranty"), ("GPL", "copy"))),
    ("GPL-2.0", "header", (("GPL-2.0", "notice"), ("GPL", "warranty"), ("GPL", "copy"))),
)
_PARTS = {(n, p): t for n, p, t in TEMPLATES}
TEMPLATES += tuple((n, p, " ".join(_PARTS[k] for k in parts)) for n, p, parts in WHOLE)

# Words too common to tell.
COMMON = "a an above all and any are as at available be been but by can code copy data either event file following for form free from if in including is it its may must name no not notice of on or org other permission person permit program see shall source terms that the their this to under use used version whether which with without work you".split()
#: Between paragraphs: a line with nothing, or with nothing but the marks of a comment.
BLANK = r"\n[ \t\r]*(?:#+|//+|\*+/?|/\*+|;+|--+|%+)?[ \t\r]*\n"


def template_words(text: str) -> list[str]:
    """A template's words, folded as ``folded`` folds a column."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigram_set(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


@functools.cache
def anchors() -> dict[tuple[str, str], tuple[str, ...]]:
    """Bigrams of each template, one more than a unit that reaches LEAST_DICE can lack: those with the fewest
    common words, of those the longest."""
    out = {}
    for name, part, text in TEMPLATES:
        grams = bigram_set(text)
        most = len(grams) - bounds(len(grams))[0]
        telling = sorted(grams, key=lambda g: (sum(w in COMMON or not w.isalpha() for w in g.split()), -len(g), g))
        out[name, part] = tuple(telling[: most + 1])
    return out


def folded(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bounds(size: int) -> tuple[int, int]:
    """The least and greatest bigram set that can reach LEAST_DICE with a template of ``size``."""
    ratio = LEAST_DICE / (2 - LEAST_DICE)
    return math.ceil(size * ratio - 1e-9), math.floor(size / ratio + 1e-9)


def _literal(words: list[str]) -> Column:
    return F.split(F.lit("|".join(words)), r"\|")  # folded to one literal


def _grams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text of the rows of ``docs`` that have an anchor of any template."""
    every = sorted({g for grams in anchors().values() for g in grams})
    pattern = "(?<![a-z0-9])" + any_of(every).replace(r"\ ", "[^a-z0-9]+")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where(F.lower("text").rlike(pattern))


def _unit_hits(docs: DataFrame) -> DataFrame:
    """Hits of lines and paragraphs."""
    sets = [(name, part, bigram_set(t)) for name, part, t in TEMPLATES]
    every = sorted({b for _, _, s in sets for b in s})
    units = lambda kind, pattern: F.transform(F.split("text", pattern), lambda x, i: F.struct(F.lit(kind).alias("unit"), i.cast("long").alias("unit_no"), x.alias("t")))
    units = docs.select("doc_id", F.explode(F.concat(units("line", "\n"), F.filter(units("paragraph", BLANK), lambda p: p["t"].contains("\n")))).alias("u"))
    least = min(bounds(len(s))[0] for _, _, s in sets)
    most = max(bounds(len(s))[1] for _, _, s in sets)
    words = units.select("doc_id", "u.unit", "u.unit_no", F.split(folded(F.col("u.t")), " ").alias("w")).where(F.size("w") > least)
    sized = words.select("doc_id", "unit", "unit_no", F.array_distinct(_grams(F.col("w"))).alias("bigrams")).where(F.size("bigrams").between(least, most))
    met = sized.select("doc_id", "unit", "unit_no", F.size("bigrams").alias("n"), F.array_intersect("bigrams", _literal(every)).alias("met")).where(F.size("met") * 2 >= F.col("n") * LEAST_DICE)
    tried = []
    for name, part, own in sets:
        lo, hi = bounds(len(own))
        dice = f"2.0D * size(array_intersect(met, split('{'|'.join(own)}', '[|]'))) / (n + {len(own)})"
        tried.append(f"CASE WHEN n BETWEEN {lo} AND {hi} THEN named_struct('licence', '{name}', 'part', '{part}', 'dice', {dice}) END")
    hits = F.filter(F.expr(f"array({', '.join(tried)})"), lambda x: x["dice"] >= LEAST_DICE)
    return met.select("doc_id", "unit", "unit_no", F.col("n").cast("long").alias("n_bigrams"), F.explode(hits).alias("h")).select("doc_id", "unit", "unit_no", "h.licence", "h.part", "n_bigrams", "h.dice")


def _best_window(name: str, part: str, text: str) -> str:
    """SQL for the greatest (dice, -start, bigrams) of a text's windows, over ``grams`` and ``places``; null without any.

    With the template's bigrams at the places at[0] < at[1] < ..., at[k] is the first
    one in a window that begins after at[k - 1]; the window holds ``lo`` of them if
    it reaches to at[k + lo - 1]. Each start is tried once.
    """
    size, grams = len(template_words(text)), bigram_set(text)
    lo, hi = bounds(len(grams))
    own = f"'{"', '".join(grams)}'"
    at = f"transform(filter(places, p -> p.x IN ({own})), p -> p.i)"
    begins = f"sequence(greatest(at[k + {lo - 1}] - {size - 2}, IF(k = 0, 0, at[k - 1] + 1)), at[k])"
    reached = f"filter(sequence(0, size(at) - {lo}), k -> at[k + {lo - 1}] - at[k] <= {size - 2})"
    starts = f"IF(size(at) < {lo}, CAST(array() AS array<int>), flatten(transform({reached}, k -> {begins})))"
    dice = f"2.0D * size(array_intersect(g, split('{'|'.join(grams)}', '[|]'))) / (size(g) + {len(grams)})"
    judged = f"IF(size(g) BETWEEN {lo} AND {hi}, named_struct('dice', {dice}, 'back', -s, 'n', size(g)), NULL)"
    tried = f"transform({starts}, s -> transform(array(array_distinct(slice(grams, s + 1, {size - 1}))), g -> {judged})[0])"
    return f"transform(array({at}), at -> array_max({tried}))[0]"


def _window_hits(docs: DataFrame) -> DataFrame:
    """The best window of each text and template, if it is a hit."""
    every = sorted({g for _, _, text in TEMPLATES for g in bigram_set(text)})
    words = docs.select("doc_id", _grams(F.split(folded(F.col("text")), " ")).alias("grams"))
    places = F.filter(F.transform("grams", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].isin(every))
    placed = words.select("doc_id", "grams", places.alias("places")).where(F.size("places") > 0)
    best = F.expr(f"array({', '.join(f"named_struct('licence', '{n}', 'part', '{p}', 'b', {_best_window(n, p, t)})" for n, p, t in TEMPLATES)})")
    hit = placed.select("doc_id", F.explode(F.filter(best, lambda h: h["b"]["dice"] >= LEAST_DICE)).alias("h"))
    return hit.select("doc_id", F.lit("window").alias("unit"), (-F.col("h.b.back")).cast("long").alias("unit_no"), "h.licence", "h.part", F.col("h.b.n").cast("long").alias("n_bigrams"), F.col("h.b.dice").alias("dice"))


def licence_hits(docs: DataFrame) -> DataFrame:
    """doc_id, unit, unit_no, licence, part, n_bigrams, dice: one row for each unit and template that match."""
    few = written(candidates(docs), "candidates")
    return _unit_hits(few).unionByName(_window_hits(few))


def oracle_sql() -> str:
    """The same rows in DuckDB: lines and paragraphs without pruning, windows at every
    word of the texts that have enough of a template's bigrams anywhere."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(p)}, {len(template_words(t))}, [{', '.join(map(quote, bigram_set(t)))}])" for n, p, t in TEMPLATES)
    return f"""
WITH templates(licence, part, m, b) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(x))) AS unit_no, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM docs)
  UNION ALL
  SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(range(len(x))) AS unit_no, unnest(x) AS t FROM (SELECT doc_id, regexp_split_to_array(text, {quote(BLANK)}) AS x FROM docs)) WHERE contains(t, chr(10))
), folded AS (
  SELECT doc_id, unit, unit_no, string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units
), grams AS (
  SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM folded WHERE len(w) > 1
), whole AS (
  SELECT rid, doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM docs
), spots AS (
  SELECT rid, unnest(range(len(w) - 1)) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM whole WHERE len(w) > 1
), owned AS (
  SELECT licence, part, ceil(len(b) * {LEAST_DICE} / (2 - {LEAST_DICE}) - 1e-9) AS least, unnest(b) AS g FROM templates
), able AS (
  SELECT s.rid, o.licence, o.part FROM (SELECT DISTINCT rid, x FROM spots) s JOIN owned o ON s.x = o.g GROUP BY s.rid, o.licence, o.part HAVING count(*) >= any_value(o.least)
), starts AS (
  SELECT a.rid, a.licence, a.part, s.i AS place FROM able a JOIN spots s ON a.rid = s.rid
), cut AS (
  SELECT t.rid, t.doc_id, s.licence, s.part, s.place, m.b, list_distinct(list_transform(range(s.place + 1, least(s.place + m.m, len(t.w))), lambda i: t.w[i] || ' ' || t.w[i + 1])) AS a
  FROM starts s JOIN whole t ON s.rid = t.rid JOIN templates m ON s.licence = m.licence AND s.part = m.part
), scored AS (
  SELECT NULL AS rid, doc_id, unit, unit_no, licence, part, len(a) AS n_bigrams, CAST(2 AS DOUBLE) * CAST(len(list_intersect(a, b)) AS DOUBLE) / CAST(len(a) + len(b) AS DOUBLE) AS dice
  FROM grams CROSS JOIN templates
  UNION ALL
  SELECT rid, doc_id, 'window', place, licence, part, len(a), CAST(2 AS DOUBLE) * CAST(len(list_intersect(a, b)) AS DOUBLE) / CAST(len(a) + len(b) AS DOUBLE) FROM cut
), ranked AS (
  SELECT *, CASE WHEN rid IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY rid, licence, part ORDER BY dice DESC, unit_no) END AS rank FROM scored WHERE dice >= CAST({LEAST_DICE} AS DOUBLE)
)
SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, licence, part, CAST(n_bigrams AS BIGINT) AS n_bigrams, dice FROM ranked WHERE rank = 1
"""
