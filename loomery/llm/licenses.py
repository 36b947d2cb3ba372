"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

DataFrame functions only. Words are runs of a-z and 0-9 after lower-casing; shingles are K words. A template of t
shingles is looked for in windows of t + step shingles, one every step = t / 4 (1 at least), so some window holds any
occurrence whole. A window that has the share `contained` of a template's shingles has a least similarity with it, which
follows from both sizes (0.5 for 0.75); as many bands of one minimum are made as miss such a window in MISSED cases at
most, so another `contained` gets other bands. Windows with fewer
known shingles than CONTAINED asks of the template are left out, which loses nothing; everything else is whole.
Templates of fewer than K words are one shingle, their whole sequence, and are looked for at each word.

Null and empty texts match nothing. Repeated rows get equal results; each template is reported once a text, at its best
and then first window. Empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce
from operator import and_
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize

K, MISSED, CONTAINED = 5, 4e-6, 0.75
#: Size up to which the template index is broadcast; a larger library is joined by a shuffle.
BROADCAST_BYTES = 16 * 2**20
MATCHES = "array<struct<template: string, containment: double, first_word: long, end_word: long>>"

#: Buckets of the known shingles, so that a shingle is compared with few of them.
BUCKETS = 8192

#: Fixed texts: notices as they stand in files; further down, the full texts in license_texts.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-clause-notice": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
TEMPLATES |= {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def shingled(df: DataFrame, text_col: str) -> DataFrame:
    """df with _w, its words, n_words and h, the hashes of its K-word shingles in order."""
    words = df.withColumn("_w", F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    starts = F.when(F.size("_w") >= K, F.sequence(F.lit(1), F.size("_w") - (K - 1))).otherwise(F.array().cast("array<int>"))
    return words.withColumns({"n_words": F.size("_w").cast("long"), "h": F.transform(starts, lambda i: F.xxhash64(F.slice("_w", i, K)))})


def phrases(templates: dict[str, str]):
    """Matches with the templates of fewer than K words in _w: array of (template, containment, first_word, end_word)."""
    found = []
    for name, text in templates.items():
        words = re.findall("[a-z0-9]+", text.lower())
        if 0 < (m := len(words)) < K:
            same = lambda i: reduce(and_, (F.element_at("_w", i + k) == w for k, w in enumerate(words)))
            at = F.when((F.size("_w") >= m) & F.array_contains("_w", words[0]), F.filter(F.sequence(F.lit(1), F.size("_w") - (m - 1)), same))
            first = F.get(at, F.lit(0)).cast("long") - 1
            found.append(F.struct(F.lit(name).alias("template"), F.lit(1.0).alias("containment"), first.alias("first_word"), (first + m).alias("end_word")))
    return F.filter(F.array(*found), lambda m: m["first_word"].isNotNull()) if found else F.array().cast(MATCHES)


def bands(shingles, n: int):
    """n band keys of an array of shingles: the band's hash of its minimum."""
    least = lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b))))
    return F.array(*(F.xxhash64(F.lit(b), least(b)) for b in range(n)))


def enough(contained: float, sizes: list[tuple[int, int]]) -> int:
    """Bands for templates of (distinct shingles, window's shingles): a window holding the share is missed in MISSED cases."""
    least = lambda need, width: max(1, math.ceil(contained * need - 1e-9))
    worst = min((least(n, w) / (n + w - least(n, w)) for n, w in sizes), default=1.0)
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - worst))) if worst < 1 else 1


def index(spark, templates: dict[str, str], contained: float) -> tuple[list[dict], int]:
    """(template, need: distinct shingles, width, step, keys) of the templates that have a shingle, and the bands made."""
    rows = shingled(spark.createDataFrame(list(templates.items()), "template string, text string"), "text").where("size(h) > 0")
    rows = rows.select("template", F.array_distinct("h").alias("need"), F.greatest(F.lit(1), F.floor(F.size("h") / 4)).cast("int").alias("step"), F.size("h").alias("size"))
    rows = rows.select("template", "need", "step", (F.col("size") + F.col("step")).alias("width"))
    lib = [r.asDict() for r in rows.collect()]  # as large as the library given
    n = enough(contained, [(len(r["need"]), r["width"]) for r in lib])
    keys = spark.createDataFrame([(r["template"], r["need"]) for r in lib], "template string, need array<long>").select("template", bands(F.col("need"), n).alias("keys"))
    found = {r["template"]: r["keys"] for r in keys.collect()}
    return [r | {"keys": found[r["template"]]} for r in lib], n


def starts(width: int, step: int, least: int):
    """Starts (from 1, one every step) of the windows that hold `least` of the positions in `at`, which are in order."""
    none = F.array().cast("array<int>")

    def steps(i):
        low, high = F.greatest(F.lit(0), F.ceil((F.element_at("at", i + (least - 1)) - F.lit(width)) / step).cast("int")), F.floor((F.element_at("at", i) - 1) / step).cast("int")
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda j: j * step + 1)).otherwise(none)

    return F.when(F.size("at") >= least, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("at") - (least - 1)), steps)))).otherwise(none)


def among(known: list[int]):
    """A test of whether a shingle is a known one."""
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    for x in known:
        buckets[x % BUCKETS].append(x)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")
    return lambda x: F.array_contains(F.element_at(table, F.pmod(x, F.lit(BUCKETS)).cast("int") + 1), x)


def shape(width: int, step: int):
    return lambda start: F.struct(start.cast("int").alias("start"), F.lit(width).alias("width"), F.lit(step).alias("step"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, matches: array of (template, containment, first_word, end_word), one row per row of docs."""
    spark = docs.sparkSession
    lib, n_bands = index(spark, templates, contained)
    table = spark.createDataFrame([(r["template"], r["width"], r["step"], b, key) for r in lib for b, key in enumerate(r["keys"])], "template string, width int, step int, band int, key long")
    needs = spark.createDataFrame([(r["template"], r["need"]) for r in lib], "template string, need array<long>")
    if sum(len(r["need"]) + 4 * n_bands for r in lib) * 8 <= BROADCAST_BYTES:
        table, needs = F.broadcast(table), F.broadcast(needs)
    is_known = among(sorted({x for r in lib for x in r["need"]}))
    shapes: dict[tuple[int, int], int] = {}
    for r in lib:
        at = r["width"], r["step"]
        shapes[at] = min(shapes.get(at, len(r["need"])), max(1, math.ceil(contained * len(r["need"]) - 1e-9)))
    rows = shingled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "t").drop("t").withColumn("short", phrases(templates))
    rows = rows.withColumn("at", F.filter(F.when(F.size("h") > 0, F.sequence(F.lit(1), F.size("h"))).otherwise(F.array().cast("array<int>")), lambda i: is_known(F.element_at("h", i))))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "short", F.when(F.size("at") > 0, F.col("h")).alias("h"), "at")
    rows = materialize(rows, "shingles")

    shaped = [F.transform(starts(w, s, n), shape(w, s)) for (w, s), n in sorted(shapes.items())]
    windows = rows.where("h is not null").select("row", "h", F.explode(F.concat(*shaped)).alias("w")).select("row", "w.*", F.slice("h", F.col("w.start"), F.col("w.width")).alias("part")).where("size(part) > 0")
    keyed = windows.withColumn("keys", bands(F.col("part"), n_bands)).select("row", "start", "width", "step", "part", F.posexplode("keys").alias("band", "key"))
    hits = keyed.join(table, ["width", "step", "band", "key"]).join(needs, "template")
    # verified where retrieved, once for each band that met: only narrow rows of matches are shuffled
    hits = hits.withColumn("share", F.size(F.array_intersect("part", "need")) / F.size("need")).where(F.col("share") >= contained)
    inside = F.filter(F.sequence(F.lit(1), F.size("part")), lambda i: F.array_contains("need", F.element_at("part", i)))
    hits = hits.select("row", "template", "share", (-F.col("start")).alias("before"), (F.col("start") + F.array_min(inside) - 2).cast("long").alias("first_word"), (F.col("start") + F.array_max(inside) + (K - 2)).cast("long").alias("end_word"))
    best = hits.groupBy("row", "template").agg(F.max(F.struct("share", "before", "first_word", "end_word")).alias("b"))
    best = best.select("row", F.struct("template", F.col("b.share").alias("containment"), "b.first_word", "b.end_word").alias("m"))
    best = best.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    long = F.coalesce("matches", F.array().cast(MATCHES))
    return rows.select("row", "doc_id", "n_words", "short").join(best, "row", "left").select("doc_id", "n_words", F.array_sort(F.concat(long, "short")).alias("matches"))
