"""Licence scans: windows of a text compared with licence templates by the Dice coefficient over word bigrams.

Texts and templates are lower-cased and everything but letters and digits becomes one space, so line ends, blank
lines and comment marks do not matter. A template of m words is compared with windows of m words (of all words of a
text that has fewer), wherever they stand. Bigrams are counted with repeats: Dice = 2 * shared / (n + m) for n and m
bigrams. A window begins where a bigram of the template stands, at latest m words before the end; moving any window up
to the next such place, or to the end, loses nothing that is shared. Three bounds prune:

- size: a text needs m * least / (2 - least) bigrams at least;
- words: a match holds one of a few words of the template, chosen so that its bigrams without them are too few;
- places: from its first bigram of the template on, a window must hold as many of them as Dice needs.

All of it is DataFrame functions; templates are literals of the plan.

Defined results: null and empty texts match nothing, nor does a text of one word; rows that share a doc_id count as one
document; a text matches as many templates as reach the bound, also one that is part of another; an empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

#: Fixed: public licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def normal_words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def numbered_bigrams(text: str) -> list[str]:
    """Bigrams with the number of the occurrence, so that a repeat is an element of its own."""
    words, seen, out = normal_words(text), {}, []
    for pair in zip(words, words[1:], strict=False):
        seen[pair] = seen.get(pair, 0) + 1
        out.append(f"{pair[0]} {pair[1]} {seen[pair]}")
    return out


#: Words that any English text has; they are the last to be chosen.
COMMON = set("a and any as at be by can for from if in is it may no not of on or other such that the this to under use was which with without you".split())


def needed_words(text: str, least: float) -> list[str]:
    """Words of which every window that matches holds one: the bigrams without them are too few."""
    words = normal_words(text)
    pairs = list(zip(words, words[1:], strict=False))
    worth = lambda w: sum(w in p for p in pairs) * (min(len(w), 8) if w not in COMMON else 0.1)
    shared = math.ceil(len(pairs) * least / (2 - least) - 1e-9)
    chosen: list[str] = []
    while len(pairs) >= shared:
        left = sorted({w for p in pairs for w in p}, key=lambda w: (-worth(w), w))
        chosen.append(left[0])
        pairs = [p for p in pairs if left[0] not in p]
    return chosen


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _templates(templates: dict[str, str], least: float) -> Column:
    """The templates as an array: name, number of bigrams, different bigrams and how often each, fewest bigrams of a text, words."""
    rows = []
    for name, text in sorted(templates.items()):
        words = normal_words(text)
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        different = sorted(set(pairs))
        rows.append(
            F.struct(
                F.lit(name).alias("license"),
                F.lit(len(pairs)).alias("m"),
                F.array(*map(F.lit, different)).alias("pairs"),
                F.array(*[F.lit(pairs.count(p)) for p in different]).alias("times"),
                F.lit(max(map(pairs.count, different), default=0)).alias("most"),
                F.lit(len(pairs) * least / (2 - least) - 1e-9).alias("low"),
                F.array(*map(F.lit, needed_words(text, least))).alias("needed"),
            )
        )
    return F.array(*rows)


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once. A filter on a plain column is pushed below it, where it works the value
    out again: inside a function of arrays even once per element. Past a generator it is not pushed."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, dice (of the best window), first_word (of the earliest best one, from 0), windows (that reach ``least``)."""
    needed = {w for text in templates.values() for w in needed_words(text, least)}
    words = sorted(w for w in needed if not any(v in w for v in needed - {w}))  # who holds a word holds its parts
    lower = F.lower(F.col("text").cast("string"))
    holds = functools.reduce(operator.or_, [F.contains(lower, F.lit(w)) for w in words])
    some = documents.filter(holds).select("doc_id", F.split(_normal(F.col("text").cast("string")), " ").alias("words"))
    some = some.withColumn("n", F.size("words") - 1).filter("n > 0")
    fits = F.filter(_templates(templates, least), lambda t: (F.col("n") >= t["low"]) & F.arrays_overlap("words", t["needed"]))
    some = _with(some, "fits", fits).filter(F.size("fits") > 0)
    pairs = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat_ws(" ", F.element_at("words", k), F.element_at("words", k + 1)))
    each = _with(some, "pairs", pairs).select("doc_id", "n", "pairs", F.explode("fits").alias("t"))
    each = each.withColumn("size", F.least("n", "t.m"))  # bigrams of a window
    each = each.withColumn("need", F.ceil(least * (F.col("size") + F.col("t.m")) / 2 - 1e-9).cast("int"))
    # No window shares more bigrams than the different ones of the whole text, each as often as the template has any.
    each = _with(each, "common", F.array_intersect("t.pairs", "pairs")).filter(F.size("common") * F.col("t.most") >= F.col("need"))
    at = F.filter(F.transform("pairs", lambda p, i: F.when(F.array_contains(F.col("common"), p), i)), lambda i: i.isNotNull())
    each = _with(each, "at", at).filter(F.size("at") >= F.col("need"))
    full = lambda i, j: F.get("at", j + F.col("need") - 1) - i < F.col("size")
    starts = F.transform("at", lambda i, j: F.when(full(i, j), F.least(i, F.col("n") - F.col("size"))))
    each = _with(each, "starts", F.array_distinct(F.filter(starts, lambda s: s.isNotNull()))).filter(F.size("starts") > 0)
    each = each.select("doc_id", "t", "size", "pairs", F.explode("starts").alias("first_word"))
    own = _with(each, "window", F.slice("pairs", F.col("first_word") + 1, F.col("size"))).drop("pairs")
    there = F.zip_with("t.pairs", "t.times", lambda p, c: F.least(F.size(F.filter("window", lambda x: x == p)), c))
    shared = F.aggregate(there, F.lit(0), lambda total, c: total + c)
    scored = _with(own, "dice", 2.0 * shared / (F.col("size") + F.col("t.m"))).select("doc_id", "t.license", "first_word", "dice")
    best = F.max(F.struct("dice", (-F.col("first_word")).alias("before"))).alias("best")
    found = scored.filter(F.col("dice") >= least).groupBy("doc_id", "license").agg(best, F.count(F.lit(1)).alias("windows"))
    return found.select("doc_id", "license", F.col("best.dice").alias("dice"), (-F.col("best.before")).cast("long").alias("first_word"), "windows")


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same in SQL, without any bound but the place where a window begins: bigrams of every window as rows."""
    values = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in sorted(templates.items()))
    normal = "string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"""
WITH templates(license, body) AS (VALUES {values}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {normal.format('text')} AS w FROM documents WHERE text IS NOT NULL),
b AS MATERIALIZED (SELECT r, i - 1 AS i, w[i] || ' ' || w[i + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
t AS (SELECT license, {normal.format('body')} AS w FROM templates),
tb AS MATERIALIZED (SELECT license, b, count(*) AS c FROM (SELECT license, w[i] || ' ' || w[i + 1] AS b FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM t)) GROUP BY ALL),
hits AS MATERIALIZED (SELECT r, license, i, b, c FROM b JOIN tb USING (b)),
sized AS MATERIALIZED (SELECT r, license, doc_id, len(d.w) - 1 AS n, len(t.w) - 1 AS m, least(len(d.w), len(t.w)) - 1 AS size FROM (SELECT DISTINCT r, license FROM hits) JOIN d USING (r) JOIN t USING (license)),
starts AS (SELECT DISTINCT r, license, least(i, n - size) AS s FROM hits JOIN sized USING (r, license)),
inside AS (SELECT r, license, s, b, least(count(*), any_value(c)) AS met FROM starts JOIN sized USING (r, license) JOIN hits USING (r, license) WHERE i >= s AND i < s + size GROUP BY r, license, s, b),
dice AS (SELECT doc_id, license, s, 2.0::DOUBLE * sum(met) / (any_value(size) + any_value(m)) AS dice FROM inside JOIN sized USING (r, license) GROUP BY r, doc_id, license, s)
SELECT doc_id, license, max(dice) AS dice, CAST(arg_min(s, (-dice, s)) AS BIGINT) AS first_word, count(*) AS windows FROM dice WHERE dice >= {least} GROUP BY doc_id, license"""
