"""License scans: text units against licence templates by Dice over word bigrams.

A text is normalised once (lower case, every run of other signs one space, line
ends kept). Its units are its lines, its paragraphs of several lines and, if it
has several paragraphs, all of it. A unit and a template are compared by the Dice
coefficient of their sets of word bigrams. For a coefficient of t or more
neither set can be larger than (2 - t) / t times the other, so sizes alone drop
nearly all templates for nearly all units. For the same reason a unit holds so
many of a template's bigrams that it holds one of its anchors, a few words that
stand in the others: texts and units without any anchor are dropped unsplit.
Spark expressions only; the templates are constants of the plan, and no rows are
shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import read

DICE = 0.8
# Words of any prose: anchors only where a template has no others to offer.
COMMON = set("a all an and any are as at be by for from if in is it may not of on or such that the this to under which with without you".split())

# Public licence notices and paragraphs, by licence and part.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0 warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT line": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(sets: Iterable[list[str]], dice: float) -> list[str]:
    """Words of which every unit that reaches ``dice`` with one of the bigram sets holds one; of several choices few, long and uncommon words.

    A coefficient of t or more takes t / (2 - t) of a template's bigrams at least.
    So many cannot be found among those without an anchor.
    """
    open_ = []  # per template: bigrams without an anchor as yet, and how many of them may stay so
    for bigrams in sets:
        if bigrams:
            open_.append((set(bigrams), math.ceil(dice / (2 - dice) * len(bigrams) * (1 - 1e-9)) - 1))
    chosen: list[str] = []
    while open_ := [(left, may) for left, may in open_ if len(left) > may]:
        gains: dict[str, int] = {}
        for left, may in open_:
            held: dict[str, int] = {}
            for bigram in left:
                for word in set(bigram.split(" ")):
                    held[word] = held.get(word, 0) + 1
            for word, n in held.items():
                gains[word] = gains.get(word, 0) + min(n, len(left) - may)
        word = max(sorted(gains), key=lambda w: (w not in COMMON, gains[w] * len(w) ** 2))
        chosen.append(word)
        open_ = [({b for b in left if word not in b.split(" ")}, may) for left, may in open_]
    return chosen


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\n]+", " ")


def spaced(plain: Column) -> Column:
    """A normalised text with a space on both sides of every word."""
    return F.concat(F.lit(" "), F.translate(plain, "\n", " "), F.lit(" "))


def units(plain: Column) -> Column:
    """Lines, paragraphs of several lines, and a text of several paragraphs, of a normalised text."""
    lines, blocks = F.split(plain, "\n", -1), F.split(plain, "\n[ \n]*\n", -1)

    def unit(kind: str, number: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("unit"), number.cast("long").alias("number"), value.alias("value"))

    paragraphs = F.filter(F.transform(blocks, lambda x, i: unit("paragraph", i, x)), lambda u: F.contains(u["value"], F.lit("\n")))
    whole = F.when(F.size(blocks) > 1, F.array(unit("text", F.lit(0), plain))).otherwise(F.array().cast("array<struct<unit:string,number:bigint,value:string>>"))
    return F.concat(F.transform(lines, lambda x, i: unit("line", i, x)), paragraphs, whole)


def once(value: Column) -> Column:
    """The value as a row of its own: filters above then cannot repeat its expression for every element."""
    return F.explode(F.array(value))


def scan(docs: DataFrame, text: str = "text", keep=("doc_id",), templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """``keep`` columns, unit, number, license, part, dice, n_bigrams: the best template of every unit that reaches ``dice``.

    Ties go to the template named first. Null and empty texts and units of fewer
    than two words match nothing; repeated rows match repeatedly; further columns
    are ignored. Texts of any length are scanned whole.
    """
    names = sorted(templates or TEMPLATES)
    sets = [template_bigrams((templates or TEMPLATES)[n]) for n in names]
    known = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(len(s)).alias("n"), F.array(*[F.lit(b) for b in s]).alias("bigrams")) for i, s in enumerate(sets)
    ])
    reach = (2 - dice) / dice * (1 + 1e-9)  # a bound, so rounding must not cut it short
    # Without a coefficient to reach there is nothing to tell from anchors.
    words = anchors(sets, dice) if dice > 0 else []
    named = F.lower(F.col(text)).rlike(f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])") if words else F.lit(dice <= 0)
    holds = reduce(Column.__or__, [F.contains(F.col("spaced"), F.lit(f" {w} ")) for w in words]) if words else F.lit(dice <= 0)
    rows = docs.filter(named).select(*[F.col(c) for c in keep], once(normalised(F.col(text))).alias("plain"))
    rows = rows.select(*keep, F.explode(units(F.col("plain"))).alias("u"))
    rows = rows.select(*keep, "u.unit", "u.number", once(spaced(F.col("u.value"))).alias("spaced")).filter(holds)
    rows = rows.select(*keep, "unit", "number", once(F.array_remove(F.split("spaced", " "), "")).alias("words"))
    low, high = min(map(len, sets)) / reach, max(map(len, sets)) * reach
    # Every distinct word but the first ends a bigram of its own, so many words make many bigrams.
    few = (F.size("words") - 1 <= high) | (F.size(F.array_distinct("words")) - 1 <= high)
    rows = rows.filter((F.size("words") - 1 >= low) & few)
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))
    sized = rows.select(*keep, "unit", "number", once(F.array_distinct(pairs)).alias("own")).filter((F.size("own") >= low) & (F.size("own") <= high))
    near = F.filter(known, lambda t: (F.size("own") <= t["n"] * reach) & (t["n"] <= F.size("own") * reach))
    scored = F.transform(
        near,
        lambda t: F.struct((2.0 * F.size(F.array_intersect("own", t["bigrams"])) / (F.size("own") + t["n"])).alias("dice"), (-t["place"]).alias("back")),
    )
    best = sized.select(*keep, "unit", "number", F.size("own").cast("long").alias("n_bigrams"), F.array_max(scored).alias("best")).filter(F.col("best.dice") >= dice)
    told = F.get(F.array(*[F.lit(n) for n in names]), -F.col("best.back"))
    return best.select(*keep, "unit", "number", F.split_part(told, F.lit(" "), F.lit(1)).alias("license"), F.split_part(told, F.lit(" "), F.lit(2)).alias("part"), F.col("best.dice").alias("dice"), "n_bigrams")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP2_SQL = f"""
WITH plain AS (
  SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9' || chr(10) || ']+', ' ', 'g') AS p FROM documents
), units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(p, chr(10))))) AS number, unnest(string_split(p, chr(10))) AS value FROM plain
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, 'paragraph' AS unit, unnest(range(len(b))) AS number, unnest(b) AS value
    FROM (SELECT doc_id, regexp_split_to_array(p, '\\n[ \\n]*\\n') AS b FROM plain)
  ) WHERE contains(value, chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, p FROM plain WHERE len(regexp_split_to_array(p, '\\n[ \\n]*\\n')) > 1
), words AS (
  SELECT doc_id, unit, number, row_number() OVER () AS row_key, regexp_split_to_array(trim(replace(value, chr(10), ' ')), ' +') AS w FROM units
), bigrams AS (
  SELECT doc_id, unit, number, row_key, unnest(list_distinct(list_transform(list_zip(w, w[2:]), lambda x: x[1] || ' ' || x[2]))) AS bigram FROM words
), sizes AS (SELECT row_key, count(*) AS n FROM bigrams GROUP BY row_key),
templates(name, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}),
template_words AS (
  SELECT name, regexp_split_to_array(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' +') AS w FROM templates
), template_bigrams AS (
  SELECT name, unnest(list_distinct(list_transform(list_zip(w, w[2:]), lambda x: x[1] || ' ' || x[2]))) AS bigram FROM template_words
), template_sizes AS (SELECT name, count(*) AS n FROM template_bigrams GROUP BY name),
common AS (
  SELECT doc_id, unit, number, row_key, name, count(*) AS shared
  FROM bigrams JOIN template_bigrams USING (bigram) GROUP BY ALL
), scored AS (
  SELECT c.*, s.n AS n_bigrams, 2.0::DOUBLE * shared / (s.n + t.n) AS dice
  FROM common c JOIN sizes s USING (row_key) JOIN template_sizes t USING (name)
), best AS (
  SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY dice DESC, name) AS r FROM scored WHERE dice >= {DICE}
)
SELECT doc_id, unit, number::BIGINT AS number, split_part(name, ' ', 1) AS license, split_part(name, ' ', 2) AS part, dice, n_bigrams
FROM best WHERE r = 1
"""
