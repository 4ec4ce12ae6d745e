"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams. DataFrame operations only.

Text is lower-cased and read as words of ASCII letters and digits. A unit is a run of consecutive lines that have words
(lines without are passed over): for each template and each such line, the run that starts there and whose number of
words is nearest to the template's, the shorter one of two. So notices of one line, notices broken over several lines,
and full licence texts, alone or inside a longer document, are all units. A unit's set of word bigrams is compared with
the template's: 2 * shared / (sum of sizes).

For a coefficient of t, sizes differ by a factor of (2 - t) / t at most, and a unit shares t / (2 - t) of the template's
bigrams at least. Its document has all of the unit's bigrams, so only documents that are large enough and hold enough of
a template's bigrams are compared with it: bigrams meet templates by an equality join, of each template those that are
in the fewest others, as many as make the bound exact. What is left, few, is compared unit by unit.

A unit's end is found by halving, and its bigrams are compared only if enough places of it hold bigrams of the template,
which is counted by halving too; so the work grows with the lines and the places, not with their product.

Templates are the usual notices, given here, and the full texts of a folder of public licence texts, those of this package.
Nulls: a null text has no units; repeated rows are each scanned; ties go to the template listed first and then to the
first line. Very long texts are scanned whole. Every input row has a result row; other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, staged, table, wide_key

LEAST = 0.8
#: Full licence texts, a file each; links are left out. A parameter; without it there are the texts below only.
TEXT_FOLDER = os.path.join(os.path.dirname(__file__), "texts")
#: Candidates (a document and its templates, about 100 bytes) up to which they are broadcast.
BROADCAST_CANDIDATES = 200_000
#: The usual notices of public licences, by SPDX name, and the texts of short licences.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)
_WORD = "[a-z0-9]+"


def all_templates(folder: str | None = TEXT_FOLDER) -> list[tuple[str, str]]:
    """The notices, then the full texts of the folder's files by name."""
    out = list(NOTICES)
    for name in sorted(os.listdir(folder)) if folder and os.path.isdir(folder) else []:
        path = os.path.join(folder, name)
        if os.path.isfile(path) and not os.path.islink(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out.append((name, f.read()))
    return out


def _words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _bigrams_of(text: str) -> list[str]:
    words = _words_of(text)
    return sorted({" ".join(p) for p in zip(words, words[1:], strict=False)})


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """The sizes that can reach the coefficient least with a set of n: 2 * min(n, m) >= least * (n + m)."""
    fits = lambda m: 2 * min(n, m) >= least * (n + m)
    near = [m for m in range(1, math.ceil(n * (2 - least) / least) + 2) if fits(m)]
    return near[0], near[-1]


def _grams(words: str) -> Column:
    """The hashes of an array's bigrams, in order."""
    w = F.col(words)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1)))
    return F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<bigint>"))


def template_tables(spark: SparkSession, templates: Sequence[tuple[str, str]], least: float) -> tuple[DataFrame, DataFrame]:
    """Of the templates: template, license, t_words, t_low, t_high, t_grams; and tests: gram, template, t_low and t_hits.

    A document of less than t_low bigrams, or with less than t_hits of the tested ones, has no unit that reaches least. Both grow with the templates alone.
    """
    grams = [_bigrams_of(text) for _, text in templates]
    times = Counter(g for gs in grams for g in gs)
    rows, tests = [], []
    for i, ((name, text), gs) in enumerate(zip(templates, grams, strict=True)):
        if not gs:
            continue
        low, high = size_bounds(len(gs), least)
        spare = len(gs) - low  # a unit lacks no more: of its low bigrams or more it shares low at least
        tested = sorted(gs, key=lambda g: (times[g], -len(g), g))[: 2 * spare + 1]
        rows.append((i, name, len(_words_of(text)), low, high, gs))
        tests += [(*g.split(" "), i, low, len(tested) - spare) for g in tested]
    hashed = F.transform("gs", lambda g: F.xxhash64(F.substring_index(g, " ", 1), F.substring_index(g, " ", -1)))
    whole = spark.createDataFrame(rows, "template int, license string, t_words int, t_low int, t_high int, gs array<string>").withColumn("t_grams", hashed).drop("gs")
    anchors = spark.createDataFrame(tests, "x string, y string, template int, t_low int, t_hits int")
    return whole, anchors.select(F.xxhash64("x", "y").alias("gram"), "template", "t_low", "t_hits")


def candidates(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """key and template of the documents (key, _text) that may have a unit like the template."""
    words = docs.select("key", F.regexp_extract_all(F.lower("_text"), F.lit(_WORD), F.lit(0)).alias("_words"))
    grams = held(words, "_words").select("key", F.array_distinct(_grams("_words")).alias("_grams"))
    each = held(grams, "_grams").select("key", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
    met = each.join(F.broadcast(tests), "gram").where(F.col("_n") >= F.col("t_low"))
    # rows that are equal in id and text share a key, and count for one another; what is too much is compared in vain
    return met.groupBy("key", "template", "t_hits").agg(F.count(F.lit(1)).alias("_hits")).where("_hits >= t_hits").select("key", "template")


def license_hits(docs: DataFrame, text: str = "text", key: Column | None = None, templates: Sequence[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """key, template, license, dice, first_line and last_line (from 1) of the best unit of each template that a document matches."""
    spark = docs.sparkSession
    whole, tests = template_tables(spark, all_templates() if templates is None else templates, least)
    rows = docs.select((wide_key("doc_id", text) if key is None else key).alias("key"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    asked = staged(candidates(rows, tests).groupBy("key").agg(F.collect_set("template").alias("_asked")), "asked")
    few = asked.count() <= BROADCAST_CANDIDATES
    found = rows.join(F.broadcast(asked) if few else asked, "key").dropDuplicates(["key"])
    lines = F.transform(F.split("_text", "\n"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract_all(F.lower(x), F.lit(_WORD), F.lit(0)).alias("ws")))
    found = held(found.select("key", "_asked", F.filter(lines, lambda x: F.size(x["ws"]) > 0).alias("_lines")), "_lines").where(F.size("_lines") > 0)
    flat = lambda of: F.flatten(F.transform("_lines", of))
    found = found.withColumns({"_words": flat(lambda x: x["ws"]), "_of": flat(lambda x: F.array_repeat(x["line"], F.size(x["ws"])))})
    found = held(found, "_words", "_of")
    # a line ends at the word behind which another line begins
    n = F.size("_of")
    ends = F.filter(F.sequence(F.lit(1), n), lambda p: (p == n) | (F.element_at("_of", p) != F.element_at("_of", F.least(p + 1, n))))
    found = staged(found.select("key", "_asked", F.transform("_lines", lambda x: x["line"]).alias("_at"), _grams("_words").alias("_grams"), ends.alias("_upto")), "units")
    # where a template's bigrams are in a document: a unit with too few of them is passed over uncompared
    own = F.broadcast(whole.select("template", F.explode("t_grams").alias("gram")))
    met = found.select("key", "_asked", F.posexplode("_grams").alias("at", "gram")).join(own, "gram").where(F.array_contains("_asked", F.col("template")))
    met = met.groupBy("key", "template").agg(F.array_sort(F.collect_list("at")).alias("_met"))
    found = held(found.drop("_asked").join(met, "key").join(F.broadcast(whole), "template"), "_grams", "_upto", "_met")
    L, U, M = F.size("_upto"), F.col("_upto"), F.col("_met")

    def first_at_least(values: Column, least_: Column, low: Column, high: Column) -> Column:
        """The first place (from 0) in [low, high) of a sorted array with a value of at least least_, else high; by halving."""
        halved = lambda a: F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        step = lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get(values, halved(a)) < least_, F.struct((halved(a) + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), halved(a).alias("hi")))
        return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(high - low + 1.0)).cast("int") + 1), F.struct(low.alias("lo"), high.alias("hi")), step)["lo"]

    def unit(i: Column) -> Column:
        """Of the line i: where the unit that starts there begins and ends in words, its last line, and how many places of the template's bigrams it has."""
        start = F.when(i > 0, F.get(U, i - 1)).otherwise(F.lit(0))
        return F.struct(i.alias("i"), start.alias("start"), first_at_least(U, start + F.col("t_words"), i, L).alias("j"))

    def ended(x: Column) -> Column:
        after, before = F.get(U, x["j"]), F.when(x["j"] > x["i"], F.get(U, x["j"] - 1))
        nearer = after.isNotNull() & (before.isNull() | (after - x["start"] - F.col("t_words") < x["start"] + F.col("t_words") - before))
        return F.struct(x["i"].alias("i"), x["start"].alias("start"), F.when(nearer, x["j"]).otherwise(x["j"] - 1).alias("last"), F.when(nearer, after).otherwise(before).alias("end"))

    def counted_(x: Column) -> Column:
        size, zero, m = x["end"] - x["start"] - 1, F.lit(0), F.size(M)
        places = first_at_least(M, x["start"] + F.greatest(size, zero), zero, m) - first_at_least(M, x["start"], zero, m)
        return F.struct(x["i"].alias("i"), x["start"].alias("start"), x["last"].alias("last"), size.alias("size"), places.alias("places"))

    def compared(x: Column) -> Column:
        grams = F.array_distinct(F.slice("_grams", x["start"] + 1, F.greatest(x["size"], F.lit(0))))
        dice = 2.0 * F.size(F.array_intersect("t_grams", grams)) / (F.size(grams) + F.size("t_grams"))
        return F.struct(dice.alias("dice"), (-x["i"]).alias("i"), x["last"].alias("last"))

    units = F.transform(F.transform(F.transform(F.sequence(F.lit(0), L - 1), unit), ended), counted_)
    near = held(found.withColumn("_near", F.filter(units, lambda x: (x["size"] >= F.col("t_low")) & (x["places"] >= F.col("t_low")))), "_near").where(F.size("_near") > 0)
    found = held(near.withColumn("b", F.array_max(F.transform("_near", compared))), "b").where(F.col("b.dice") >= least)
    return found.select("key", "template", "license", F.col("b.dice").alias("dice"), F.get("_at", -F.col("b.i")).alias("first_line"), F.get("_at", F.col("b.last")).alias("last_line"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents: how many templates are matched, the best match and its lines, and all licences matched."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("key", wide_key("doc_id", "text"))
    hits = license_hits(docs.drop("doc_id"), key=F.col("key"))
    each = hits.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("dice", (-F.col("template")).alias("template"), "license", "first_line", "last_line")).alias("b"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
    )
    out = docs.select("doc_id", "key").join(each, "key", "left")
    return out.select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_templates"),
        F.col("b.license").alias("best_license"),
        F.col("b.dice").alias("best_dice"),
        F.col("b.first_line").cast("long").alias("first_line"),
        F.col("b.last_line").cast("long").alias("last_line"),
        F.coalesce("licenses", F.lit("")).alias("licenses"),
    )


def oracle(templates: Sequence[tuple[str, str]]) -> str:
    """DuckDB SQL for op7_licenses, comparing every unit with every template whose size it can match."""
    rows = []
    for i, (name, text) in enumerate(templates):
        gs = _bigrams_of(text)
        rows.append(f"({i}, '{name}', {len(_words_of(text))}, {size_bounds(len(gs), LEAST)[0]}, [{', '.join(repr(g) for g in gs)}])")
    return rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(rows)}) v(template, license, tw, low, tg)),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
s AS (SELECT rid, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM d WHERE text IS NOT NULL),
l AS (SELECT rid, line, regexp_extract_all(lower(x), '[a-z0-9]+') AS ws FROM s),
c AS (SELECT rid, line, ws, CAST(sum(len(ws)) OVER (PARTITION BY rid ORDER BY line) AS BIGINT) AS upto FROM l WHERE len(ws) > 0),
f AS (SELECT rid, flatten(list(ws ORDER BY line)) AS words, list(upto ORDER BY line) AS ends, list(line ORDER BY line) AS nums FROM c GROUP BY rid),
r AS (SELECT c.rid, c.line, c.upto - len(ws) AS start, template, low,
        list_min(list_transform(list_filter(ends, lambda e: e >= c.upto), lambda e: struct_pack(off := abs(e - (c.upto - len(ws)) - tw), e := e))).e AS stop
      FROM c JOIN f USING (rid), t WHERE ends[-1] - (c.upto - len(ws)) - 1 >= low),
g AS (SELECT r.rid, r.line, template, nums[list_position(ends, stop)] AS last_line,
        list_distinct(list_transform(range(start + 1, stop), lambda i: words[i] || ' ' || words[i + 1])) AS gs FROM r JOIN f USING (rid) WHERE stop - start - 1 >= low),
m AS (SELECT rid, template, license, line, last_line, 2.0 * len(list_intersect(gs, tg)) / CAST(len(gs) + len(tg) AS DOUBLE) AS dice FROM g JOIN t USING (template)),
b AS (SELECT * FROM m WHERE dice >= {LEAST} QUALIFY row_number() OVER (PARTITION BY rid, template ORDER BY dice DESC, line) = 1),
e AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ls FROM b GROUP BY rid),
h AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dice DESC, template) = 1)
SELECT doc_id, coalesce(n, 0) AS n_templates, h.license AS best_license, h.dice AS best_dice, h.line AS first_line, h.last_line AS last_line, coalesce(ls, '') AS licenses
FROM d LEFT JOIN e USING (rid) LEFT JOIN h USING (rid)
"""


ORACLE_OP7 = oracle(all_templates())
