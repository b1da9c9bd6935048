"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Main path: DataFrame functions only.

Shingles are five words (ASCII lower case, punctuation dropped). A text is read in windows of eight
words, four apart, so every shingle lies in exactly one window of at most four shingles. A window has
32 minima of its shingle hashes under 32 permutations, each a band of one row. A template's windows
start at every word. A window that holds a single shingle of a template shares a band with it with
probability 1 - (3/4)^32 > 0.9998, and one that equals a template's window always does. Each candidate
pair of document and template is then verified: at least 0.8 of the template's distinct shingles, as
strings, are in the document.

Texts of fewer than five words and null texts have no shingles. Repeated rows each get their answer;
empty tables give empty results. Ties do not occur: every template that is contained is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skewloom.session import Scratch

from .common import ALNUM, alnum_words, hash_of, small_side

SHINGLE, WINDOW, STEP, BANDS = 5, 8, 4, 32
MIN_CONTAINED = 0.8

# Notices by which licenses are named, and the passages that open or mark their texts.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-3-clause": "may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "boost-1.0-line": "Distributed under the Boost Software License, Version 1.0.",
}


def _words(text: Column) -> Column:
    return alnum_words(text)


def _shingles(words: Column) -> Column:
    """The distinct shingles as strings."""
    n = F.size(words) - SHINGLE
    return F.when(
        n >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " ")))
    ).otherwise(F.array().cast("array<string>"))


def permutations(bands: int = BANDS) -> list[int]:
    """Signed 64-bit constants: a hash's order under exclusive or with each is a permutation."""
    mask, x, out = (1 << 64) - 1, 0, []
    for _ in range(bands):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def _bands(rows: DataFrame, step: int, *keys: str) -> DataFrame:
    """``keys.. band``: the band keys of every window of ``words``."""
    n = F.size("words") - SHINGLE
    at = rows.where(n >= 0).withColumn("at", F.explode(F.sequence(F.lit(0), n, F.lit(step))))
    inside = [F.when(F.col("at") + c <= n, hash_of(F.col("words"), F.col("at") + c, SHINGLE)).alias(f"x{c}") for c in range(WINDOW - SHINGLE + 1)]
    each = at.select(*keys, *inside).withColumn("by", F.explode(F.array(*[F.lit(c) for c in permutations()])))
    least = F.least(*[F.col(f"x{c}").bitwiseXOR(F.col("by")) for c in range(len(inside))])
    return each.select(*keys, F.xxhash64("by", least).alias("band"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(templates.items()), "license string, t_text string")


def find(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_contained: float = MIN_CONTAINED) -> DataFrame:
    """One row per document and contained template: ``doc_id license n_shingles n_found contained``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    texts = template_table(spark, templates or TEMPLATES).withColumn("words", _words(F.col("t_text")))
    known = scratch.table(_bands(texts, 1, "license").select(F.col("band").alias("t_band"), "license").distinct(), "bands")
    shingles = scratch.table(texts.select(F.col("license").alias("s_license"), _shingles(F.col("words")).alias("wanted")), "templates")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    banded = _bands(keyed.select("doc_id", "text_hash", _words(F.col("text")).alias("words")), STEP, "doc_id", "text_hash")
    met = banded.join(small_side(known, known.count()), banded["band"] == known["t_band"])
    found = scratch.table(met.select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), "license").distinct(), "candidates")
    again = keyed.join(found, keyed["doc_id"].eqNullSafe(found["c_doc"]) & (keyed["text_hash"] == found["c_hash"]))
    have = again.withColumn("words", _words(F.col("text"))).select("doc_id", "license", _shingles(F.col("words")).alias("have"))
    both = have.join(small_side(shingles, len(templates or TEMPLATES)), have["license"] == shingles["s_license"])
    n, k = F.size("wanted").cast("long"), F.size(F.array_intersect("wanted", "have")).cast("long")
    counted = both.select("doc_id", "license", n.alias("n_shingles"), k.alias("n_found"))
    return counted.withColumn("contained", F.col("n_found") / F.col("n_shingles")).where(F.col("contained") >= min_contained)


def oracle(templates: dict[str, str] | None = None, min_contained: float = MIN_CONTAINED) -> str:
    """SQL that compares every template with every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted((templates or TEMPLATES).items()))
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}')"
    return f"""
WITH t0(license, text) AS (VALUES {values}),
t1 AS (SELECT license, {words('text')} AS ws FROM t0),
t2 AS (SELECT license, ws, unnest(range(1, len(ws) - 3)) AS i FROM t1 WHERE len(ws) >= 5),
t AS (SELECT DISTINCT license, array_to_string(ws[i:i + 4], ' ') AS s FROM t2),
n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d1 AS (SELECT row_number() OVER () AS rid, doc_id, {words('text')} AS ws FROM documents WHERE text IS NOT NULL),
d2 AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d1 WHERE len(ws) >= 5),
d AS (SELECT rid, doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM d2),
f AS (SELECT rid, doc_id, license, count(DISTINCT s) AS k FROM d JOIN t USING (s) GROUP BY rid, doc_id, license)
SELECT doc_id, license, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_found, k::DOUBLE / n AS contained
FROM f JOIN n USING (license) WHERE k::DOUBLE / n >= {min_contained}::DOUBLE
"""
