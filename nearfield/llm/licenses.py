"""License scans (operator 7, native): normalised text against licence templates by Dice over word bigrams.

Units of a document are its whole text, each of its lines, and runs of consecutive lines (paragraphs are such runs).  A unit is lower-cased (A-Z), everything but letters a-z and digits
becomes a break, and its distinct word bigrams are compared with each template's by Dice = 2 |A and B| / (|A| + |B|).
A Dice of d needs |A| between d / (2 - d) |B| and (2 - d) / d |B|: templates outside these bounds are never intersected.

Runs.  A run that matches template B holds d / (2 - d) |B| of its bigrams at least, so only documents whose whole text does are tried.
A run begins with a line that has words and ends with one that shares a bigram with B (else a shorter run has no smaller Dice), and the shared bigrams of its
lines must reach that bound, and those that its lines have first in the text not exceed the bound from above.  A template that the whole text or a line matches isn't looked for in runs; else its best run
(Dice, first line, last line) counts as one matching unit.

One scan; lines are exploded and thinned by size within the same stage, and only matches are shuffled.  Templates are literals of
fixed size: the notices of TEMPLATES and, of whole licences, the texts in ``license_texts``.

Result: a row for each row of documents with the number of units (whole text and lines) and of matching units, the best template (by Dice, then name), its Dice
and the unit (0: whole text, else line from 1; of a run its first line).  Null or empty text: one unit, no match.  Rows with one doc_id: matches of
all of them count for each.  Null doc_id: matches of rows with null doc_id.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.8
# Short notices, and the standard notice or grant of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
# Whole licences, and a notice; the SQL form has TEMPLATES, whole texts and lines only.
WHOLE = {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))} | {"MIT-licensed": "Licensed under the MIT License."}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(map(" ".join, zip(words, words[1:]))))


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def _bigrams(w: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))


def _runs(inside: DataFrame, known: dict, low: float, high: float, threshold: float) -> DataFrame:
    """doc_id, unit (first and last line), hit (dice, license): the best run of two lines at least of each document and template of ``inside``."""
    b = inside.sparkSession.createDataFrame([(k, v) for k, v in sorted(known.items())], "name string, b array<string>")
    d = inside.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(b), F.col("license") == F.col("name")).drop("name")
    lines = F.transform(F.split("text", "\n"), lambda x: F.filter(F.split(_normalised(x), " "), lambda w: w != ""))
    d = d.withColumn("lines", lines).select("row", "doc_id", "license", "b", "lines", F.posexplode("lines").alias("i", "line"))
    # a line's shared bigrams, with those that lead to its first word
    before = F.filter(F.slice("lines", 1, F.col("i")), lambda x: F.size(x) > 0)
    led = F.concat(F.when(F.size(before) > 0, F.slice(F.element_at(before, F.when(F.size(before) > 0, F.lit(-1)).otherwise(F.lit(1))), -1, 1)).otherwise(F.array().cast("array<string>")), F.col("line"))
    d = d.withColumn("grams", F.when(F.size(led) > 1, _bigrams(F.when(F.size(led) > 1, led))).otherwise(F.array().cast("array<string>")))
    d = C.cut(d.select("row", "doc_id", "license", "i", "line", "lines", "b", "grams", F.size(F.array_intersect("grams", "b")).alias("shared")))
    text = d.where("i = 0").select("row", "doc_id", "license", "lines", "b")
    # bigrams that a line has first: a run's distinct ones are as many at least as its lines after the first have
    new = d.select("row", "i", F.explode("grams").alias("gram")).groupBy("row", "gram").agg(F.min("i").alias("i")).groupBy("row", "i").agg(F.count(F.lit(1)).alias("new"))
    line = W.partitionBy("row").orderBy("i")
    sums = d.join(new, ["row", "i"], "left").select("row", "i", "shared", F.size("line").alias("n"), F.sum("shared").over(line).alias("upto"), F.sum(F.coalesce("new", F.lit(0))).over(line).alias("news"))
    first = sums.where("n > 0").select("row", F.col("i").alias("a"), (F.col("upto") - F.col("shared")).alias("before"), F.col("news").alias("old"))
    last = sums.where("shared > 0").select("row", F.col("i").alias("z"), "upto", "news")
    m = F.size("b")
    pairs = first.join(last, "row").where("z > a").join(text, "row").where((F.col("upto") - F.col("before") >= low * m) & (F.col("news") - F.col("old") <= high * m))
    w = F.flatten(F.slice("lines", F.col("a") + 1, F.col("z") - F.col("a") + 1))
    own = pairs.select("row", "doc_id", "license", "a", "z", "b", F.explode(F.array(w)).alias("w")).where(F.size("w") > 1).select("row", "doc_id", "license", "a", "z", "b", F.explode(F.array(_bigrams(F.col("w")))).alias("own"))
    n = F.size("own")
    own = own.where((n >= low * m) & (n <= high * m)).select("row", "doc_id", "license", "a", "z", (2.0 * F.size(F.array_intersect("own", "b")) / (n + m)).alias("dice")).where(F.col("dice") >= threshold)
    best = own.groupBy("row", "doc_id", "license").agg(F.min(F.struct((-F.col("dice")).alias("loss"), "a", "z")).alias("x"))
    return best.select("doc_id", F.struct((F.col("x.a") + 1).cast("long").alias("unit"), (F.col("x.z") + 1).cast("long").alias("last")), F.struct((-F.col("x.loss")).alias("dice"), "license"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units, n_matched, license, dice, unit."""
    known = {k: b for k, t in (templates or TEMPLATES | WHOLE).items() if (b := bigrams(t))}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(map(len, known.values())) * low, max(map(len, known.values())) * high
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def once(x: Column) -> Column:
        """``x`` computed once a row: filters on it are not pushed below an explode, where they would compute it again."""
        return F.explode(F.array(x))

    lines = F.split("text", "\n")
    units = docs.select("doc_id", F.posexplode(F.concat(F.array("text"), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))).alias("unit", "part"))
    # k distinct bigrams need k + 1 words, two characters each but for the last
    units = units.where(F.length("part") >= 2 * least + 1).select("doc_id", "unit", "part", once(F.split(_normalised(F.col("part")), " ")).alias("words")).where(F.size("words") > least)
    units = units.select("doc_id", "unit", "part", once(_bigrams(F.col("words"))).alias("own"))
    n, whole = F.size("own"), F.col("unit") == 0
    units = units.where((n >= least) & (whole | (n <= most)))
    # bigrams of any template, found once a unit; what is left of most units is too little for every template
    every = sorted({g for b in known.values() for g in b})
    units = units.select("doc_id", "unit", "part", n.alias("n"), once(F.filter("own", lambda x: x.isin(every))).alias("own")).where(F.size("own") >= least)
    n = F.col("n")
    tried = []
    for name, b in sorted(known.items()):
        both = F.when(F.size("own") >= low * len(b), F.size(F.array_intersect("own", F.split(F.lit("|".join(b)), "[|]")))).otherwise(0)
        tried.append(F.when((n >= low * len(b)) & (whole | (n <= high * len(b))), F.struct(both.alias("both"), F.lit(len(b)).alias("size"), F.lit(name).alias("license"))))

    def dice(x: Column) -> Column:
        return F.when(n <= high * x["size"], 2.0 * x["both"] / (n + x["size"])).otherwise(0.0)

    def within(x: Column) -> Column:
        return whole & (x["both"] >= low * x["size"])

    told = units.select("doc_id", "unit", "part", "n", F.explode(F.filter(F.array(*tried), lambda x: (dice(x) >= threshold) | within(x))).alias("x"))
    told = C.cut(told.select("doc_id", "unit", F.when(within(F.col("x")), F.col("part")).alias("text"), F.struct(dice(F.col("x")).alias("dice"), F.col("x.license").alias("license"), within(F.col("x")).alias("within")).alias("hit")))
    hits = told.where(F.col("hit.dice") >= threshold).select("doc_id", F.col("unit").cast("long").alias("unit"), "hit.dice", "hit.license")
    matched = hits.select(F.col("doc_id").alias("id"), F.col("license").alias("name")).distinct()
    inside = told.where("hit.within").select("doc_id", "text", "hit.license")
    inside = inside.join(matched, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("license") == F.col("name")), "left_anti")
    hits = hits.select("doc_id", F.struct("unit", F.lit(0).cast("long").alias("last")).alias("unit"), F.struct("dice", "license").alias("hit")).union(_runs(inside, known, low, high, threshold))
    best = F.min(F.struct((-F.col("hit.dice")).alias("loss"), F.col("hit.license").alias("license"), F.col("unit.unit").alias("unit")))
    found = hits.groupBy(F.col("doc_id").alias("found_id")).agg(F.count_distinct("unit").alias("n_matched"), best.alias("best"))
    n_units = F.when(F.size(lines) > 1, F.size(lines) + 1).otherwise(1).cast("long")
    return (
        docs.select("doc_id", n_units.alias("n_units"))
        .join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
        .select("doc_id", "n_units", F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"), F.col("best.license").alias("license"), F.round(-F.col("best.loss"), 9).alias("dice"), F.col("best.unit").cast("long").alias("unit"))
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    quoted = ", ".join("('{}', [{}])".format(k, ", ".join(f"'{b}'" for b in bigrams(t))) for k, t in sorted(TEMPLATES.items()))
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    return f"""
    WITH t(license, b) AS (VALUES {quoted}),
    d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    u AS (SELECT doc_id, 0 AS unit, text AS part FROM d
          UNION ALL SELECT doc_id, i AS unit, lines[i] AS part FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d WHERE len(lines) > 1)),
    w AS (SELECT doc_id, unit, string_split(trim(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
    g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS own FROM w WHERE len(w) > 1),
    h AS (SELECT doc_id, unit, license, 2.0::DOUBLE * len(list_intersect(own, b)) / (len(own) + len(b)) AS dice FROM g, t
          WHERE len(own) >= {low!r} * len(b) AND len(own) <= {high!r} * len(b)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, unit) AS n FROM h WHERE dice >= {THRESHOLD}),
    f AS (SELECT doc_id, count(DISTINCT unit) AS n_matched, max(license) FILTER (n = 1) AS license, max(dice) FILTER (n = 1) AS dice, max(unit) FILTER (n = 1) AS unit FROM r GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN len(lines) > 1 THEN len(lines) + 1 ELSE 1 END::BIGINT AS n_units, coalesce(n_matched, 0)::BIGINT AS n_matched, license, round(dice, 9) AS dice, unit::BIGINT AS unit
    FROM d LEFT JOIN f ON d.doc_id = f.doc_id"""
