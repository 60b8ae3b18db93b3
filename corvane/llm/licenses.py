"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

DataFrame functions only. A template of m shingles is looked for in windows of m + s shingles that start every s,
s = max(1, m / 4), so some window holds all of it. Where four fifths of it are there, window and template then have a
Jaccard similarity of 0.5 or more, and one of 16 bands of one value agrees with a probability above 0.99998.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS = 5, 16

#: Notices and characteristic passages of public licenses: fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column) -> Column:
    """A hash for each run of five words in order, in lower case and without marks; fewer words have none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
        return F.when(F.size(w) >= SHINGLE, each).otherwise(F.array().cast("array<long>"))

    return _let(words, runs)


def versions(text: Column) -> Column:
    """The shingles of ``text`` that hold a word with a digit."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    marked = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.exists(F.slice(w, i + 1, SHINGLE), lambda x: x.rlike(r"\p{N}")))
    pairs = lambda w: F.arrays_zip(shingles(text).alias("h"), marked(w).alias("m"))
    return _let(words, lambda w: F.when(F.size(w) >= SHINGLE, F.transform(F.filter(pairs(w), lambda p: p["m"]), lambda p: p["h"])).otherwise(F.array().cast("array<long>")))


def least(window: Column, band: Column) -> Column:
    """The MinHash of a window for one band."""
    return F.array_min(F.transform(window, lambda h: F.xxhash64(h, band)))


def scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, license, template, containment, windows: one row for each text and template found in it.

    ``template`` is a position in ``templates``, containment the share of the template's shingles in the window
    that has most of them, windows the number of windows that have ``percent`` or more. Where a template names a version, the
    window has to hold some shingle with it, so that a notice is not taken for that of another version. Texts that are null, empty
    or shorter than five words have no rows; rows that share an id are counted together. Templates of fewer than
    five words are never found.

    A window's MinHash in some band can be a template's only if the window holds the very shingle that is the
    template's minimum there. So windows are cut only around such shingles; everywhere else none can collide.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    known = rows.select("template", "license", F.array_distinct(shingles(F.col("text"))).alias("of"), versions(F.col("text")).alias("version")).where("size(of) > 0")
    known = known.withColumn("stride", F.greatest(F.lit(1), F.floor(F.size("of") / 4).cast("int"))).withColumn("width", F.size("of") + F.col("stride"))
    known = known.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("key", least(F.col("of"), F.col("band")))
    # templates are a parameter, so what is gathered of them here, 16 numbers for each, does not grow with the corpus
    minima, shapes = set(), set()
    for r in known.select("of", "band", "key", "width", "stride", F.transform("of", lambda h: F.xxhash64(h, F.col("band"))).alias("ranks")).collect():
        minima.add(r["of"][r["ranks"].index(r["key"])])
        shapes.add((r["width"], r["stride"]))
    wanted = F.array(*map(F.lit, sorted(minima))).cast("array<long>")
    forms = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(s).alias("stride")) for w, s in sorted(shapes)))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), shingles(F.col(text_col)).alias("h")).where(F.arrays_overlap("h", wanted))
    at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(sorted(minima)), i)), lambda i: i.isNotNull())

    def around(i: Column, form: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((i - form["width"] + 1) / form["stride"]).cast("int"))
        return F.transform(F.sequence(first, F.floor(i / form["stride"]).cast("int")), lambda n: F.struct(form["width"].alias("width"), (n * form["stride"]).alias("start")))

    windows = F.array_distinct(F.flatten(F.flatten(F.transform("at", lambda i: F.transform(forms, lambda form: around(i, form))))))
    texts = texts.withColumn("at", at).withColumn("w", F.explode(windows))
    texts = texts.select("doc_id", "w.width", "w.start", F.slice("h", F.col("w.start") + 1, F.col("w.width")).alias("window"))
    texts = texts.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("key", least(F.col("window"), F.col("band")))
    hits = texts.join(F.broadcast(known.drop("stride")), ["width", "band", "key"])
    hits = hits.withColumn("shared", F.size(F.array_intersect("of", "window"))).where(100 * F.col("shared") >= percent * F.size("of"))
    hits = hits.where((F.size("version") == 0) | F.arrays_overlap("version", "window"))
    return hits.groupBy("doc_id", "license", "template").agg(
        F.max(F.col("shared") / F.size("of")).alias("containment"), F.count_distinct("start").cast("long").alias("windows")
    )
