"""License scan: sparse TF-IDF cosine to templates, then inheritance down directories.

Units are the runs of neighbouring lines of every file (a notice may be wrapped) and, for
files named as licence files, the whole text.  A run starts at any line and ends at any
line, up to the one with which it is as long as the longest template; only letters and
digits count, so lines of comment marks alone and blank lines are none.  A unit's vector has TF-IDF weights (document counts of the template terms
over all files; a term of no template has the weight of one never seen); its
licence is the template of the largest cosine of at least ``LEAST``.

Only units that can reach the threshold are scored: a unit sharing with each template
just terms whose weights have a norm below ``LEAST`` cannot, by the Cauchy-Schwarz
inequality, so a unit needs one of the other terms.  A run whose first or last line has
no template term has a smaller cosine than the run without it.  Nothing is lost by either.

A file has its own licence, or that of the licence file in the nearest directory
above it: directories are joined to their ancestors' licence files on the path.

DataFrame functions only.  Null and empty texts have no units; equal rows are equal in
the result; ties go to the first template name.  A path without a slash is in the
root directory "".
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import base

LEAST = 0.6
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
_SPLIT = r"[^a-z0-9]+"

# Notices and passages by which licences are declared.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _terms(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def _tokens(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), _SPLIT, " ")), " ")


def weights(counts: dict[str, int], total: int) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of template terms, and that of a term never seen."""
    idf = lambda n: math.log((total + 1) / (n + 1)) + 1
    vocab = {t for texts in TEMPLATES.values() for x in texts for t in _terms(x)}
    return {t: idf(counts.get(t, 0)) for t in vocab}, idf(0)


def vectors(idf: dict[str, float]) -> list[tuple[str, int, dict[str, float]]]:
    """(licence, number, unit vector) of every template text."""
    out = []
    for name, texts in TEMPLATES.items():
        for k, x in enumerate(texts):
            v: dict[str, float] = {}
            for t in _terms(x):
                v[t] = v.get(t, 0) + idf[t]
            norm = math.sqrt(sum(w * w for w in v.values()))
            out.append((name, k, {t: w / norm for t, w in v.items()}))
    return out


def anchors(vecs: list[tuple[str, int, dict[str, float]]], least: float = LEAST) -> list[str]:
    """Terms of which a unit needs one to reach the threshold with any template."""
    out = set()
    for _, _, v in vecs:
        rest = 0.0
        for t, w in sorted(v.items(), key=lambda x: (x[1], x[0])):
            rest += w * w
            if rest >= (least - 1e-9) ** 2:
                out.add(t)
    return sorted(out)


def document_counts(texts: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """Files that have each template term, over all files."""
    vocab = sorted({t for xs in TEMPLATES.values() for x in xs for t in _terms(x)})
    own = F.array_intersect(_tokens(F.col(text)), F.array(*map(F.lit, vocab)))
    rows = texts.select(F.explode(F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array(F.lit("")))).alias("t")).groupBy("t").count().collect()
    counts = {r[0]: r[1] for r in rows}  # at most the templates' vocabulary
    return counts, counts.pop("", 0)


def _directory(path: Column) -> Column:
    return F.regexp_replace(F.when(path.contains("/"), path).otherwise(F.lit("/")), "/[^/]*$", "")


def runs(src: DataFrame, strong: Column) -> DataFrame:
    """(path, n, t): the words of the runs of lines from line n on that have a strong term."""
    texts = [_terms(x) for xs in TEMPLATES.values() for x in xs]
    longest, vocab = max(map(len, texts)), F.array(*map(F.lit, sorted({t for x in texts for t in x})))
    some = src.filter(F.arrays_overlap(_tokens(F.col("text")), strong)).withColumn("h", F.xxhash64("text"))
    lines = some.select("path", "h", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("t", _tokens(F.col("line"))).filter(F.element_at("t", 1) != "")
    # A line has a word at least, so no run has more than `longest` lines.
    lines = lines.select("path", "h", "n", "t", F.arrays_overlap("t", strong).alias("strong"), F.arrays_overlap("t", vocab).alias("known")).repartition("path", "h").dropDuplicates(["path", "h", "n"])
    order = Window.partitionBy("path", "h").orderBy("n")
    lines = lines.withColumn("before", F.sum(F.size("t").cast("long")).over(order) - F.size("t"))
    ahead = F.collect_list(F.struct("t", "strong", "known", "before")).over(order.rowsBetween(0, longest - 1))
    seen = lines.withColumn("ahead", F.when(F.col("known"), ahead)).filter(F.col("known")).withColumn("ahead", F.filter("ahead", lambda x: x["before"] - F.col("before") < longest))
    seen = seen.filter(F.exists("ahead", lambda x: x["strong"])).select("path", "n", "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("k"))
    run = F.slice("ahead", F.lit(1), F.col("k"))
    return seen.filter(F.element_at("ahead", F.col("k"))["known"] & F.exists(run, lambda x: x["strong"])).select("path", "n", F.flatten(F.transform(run, lambda x: x["t"])).alias("t"))


def detect(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """(path, license, score): the best licence declared in each file that declares one."""
    spark = files.sparkSession
    idf, unseen = weights(*document_counts(files, text))
    vecs = vectors(idf)
    strong = F.array(*map(F.lit, anchors(vecs, least)))
    src = files.select(base.column(path).alias("path"), base.column(text).alias("text")).filter("text is not null and path is not null")
    units = runs(src, strong).unionAll(src.filter(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILE)).select("path", F.lit(-1).alias("n"), _tokens(F.col("text")).alias("t")))
    units = units.filter(F.arrays_overlap("t", strong))
    tf = units.select(F.xxhash64("path", "n", F.array_join("t", " ")).alias("u"), "path", F.explode("t").alias("term")).groupBy("u", "path", "term").agg(F.count("*").alias("tf"))
    # The templates are constants of this module: a table of bounded size.
    known = spark.createDataFrame([(t, float(w)) for t, w in idf.items()], "term string, idf double")
    template = spark.createDataFrame([(name, k, t, float(w)) for name, k, v in vecs for t, w in v.items()], "license string, k int, term string, w double")
    weighed = tf.join(F.broadcast(known), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norm = weighed.groupBy("u", "path").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dot = weighed.join(F.broadcast(template), "term").groupBy("u", "path", "license", "k").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 6)
    best = dot.join(norm, ["u", "path"]).withColumn("score", score).filter(F.col("score") >= least)
    return best.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def inherit(files: DataFrame, found: DataFrame) -> DataFrame:
    """``files`` (with a column path) and own licence and score, and the licence in force with the directory it comes from.

    ``files`` has no columns named like the added ones.
    """
    own = F.regexp_extract("path", "([^/]*)$", 1)
    holders = found.filter(own.rlike(LICENSE_FILE)).select(_directory(F.col("path")).alias("holder"), "license", "path")
    holders = holders.groupBy("holder").agg(F.min(F.struct("path", "license")).alias("x")).select("holder", F.col("x.license").alias("inherited"))
    dirs = files.select(_directory(F.col("path")).alias("dir")).filter("dir is not null").distinct()
    # A directory and all above it: joined on the path, the longest wins.
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("holder")).distinct()
    nearest = above.join(holders, "holder").groupBy("dir").agg(F.max(F.struct(F.length("holder").alias("n"), "holder", "inherited")).alias("x"))
    # A table of its own: the join with it has plain exchanges, which the engine splits where a directory has very many files.
    nearest = base.cut(nearest.select("dir", F.col("x.holder").alias("holder"), F.col("x.inherited").alias("inherited")), "licenses-above")
    got = files.join(found.select("path", F.col("license").alias("own_license"), F.col("score").alias("own_score")), "path", "left")
    got = got.withColumn("dir", _directory(F.col("path"))).join(nearest, "dir", "left")
    return got.withColumn("license", F.coalesce("own_license", "inherited")).withColumn("inherited_from", F.when(F.col("own_license").isNull(), F.col("holder"))).drop("dir", "holder", "inherited")


RESULTS = ("path", "own_license", "own_score", "license", "inherited_from")


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``keep``, ``path``, ``own_license``, ``own_score``, ``license`` and ``inherited_from`` of every file.

    Kept columns may have any names; one named like a result gives way to it (``prefix`` renames the results).
    """
    found = base.cut(detect(files, path, text), "licenses")
    h = base.Held(files, [c for c in keep if c != path], RESULTS, prefix, path=path)
    return h.named(inherit(h.rows, found))
