"""License scans: TF-IDF cosine to templates, then inheritance from directories.

Every line of a file, every paragraph between blank lines (if there are several) and the
file as a whole is a sparse vector of its distinct words, weighted by their inverse
frequency among the templates; words that no template has weigh most. A file's own license
is the template with the highest cosine to any of its lines or paragraphs, from `least`
on. A file that reaches it as a whole, or is named like a license file, licenses its
directory. A file without an own license takes that of the nearest directory above it
that has one: directories are joined with their ancestors on the path, once each, and
files with their directory.

All of it is one projection per file and joins of directories: weights are whole
numbers, so a cosine does not depend on the order of words.

Defined cases: a null or empty text has no own license; a null path has no directory and
inherits nothing; ties go to the template that stands first; repeated rows are scanned
each; several license files in one directory: the highest cosine, then the first
template; an empty table gives an empty result; long texts are scanned whole. Extra columns
stay out, `key` is carried along.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import stage

# fixed values: short notices of common licenses
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file in the project root for license information."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]

LEAST = 0.6
_WORD_BREAK = r"[^\p{L}\p{N}]+"
_LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.\-_].*)?$"
_UNIT = 10_000


def template_words() -> list[list[str]]:
    return [sorted({w for w in re.split(r"[^a-z0-9]+", text.lower()) if w}) for _, text in TEMPLATES]


def word_weights() -> tuple[dict[str, int], int]:
    """Squared inverse frequencies of template words in whole units, and that of other words."""
    words = template_words()
    count = len(words)

    def weight(found: int) -> int:
        return round(_UNIT * (math.log((1 + count) / (1 + found)) + 1) ** 2)

    return {w: weight(sum(w in x for x in words)) for w in sorted({w for x in words for w in x})}, weight(0)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _best(text: Column, least: float) -> Column:
    """(own, whole): the best (cosine, -template) of the units, and of the whole text."""
    weights, other = word_weights()
    vocabulary = _strings(list(weights))
    table = F.map_from_arrays(vocabulary, F.array(*(F.lit(v).cast("long") for v in weights.values())))
    zero = F.lit(0).cast("long")

    def total(words: Column) -> Column:
        return F.aggregate(words, zero, lambda s, w: s + F.element_at(table, w))

    sizes = [sum(weights[w] for w in words) for words in template_words()]
    templates = F.array(
        *(
            F.struct(F.lit(-i).alias("t"), _strings(words).alias("words"), F.lit(size).cast("long").alias("size"))
            for i, (words, size) in enumerate(zip(template_words(), sizes, strict=True))
        )
    )

    def cosines(unit: Column) -> Column:
        def cosine(t: Column) -> Column:
            common = total(F.array_intersect(unit["hits"], t["words"])).cast("double")
            norm = F.sqrt((unit["inside"] + unit["others"] * other).cast("double") * t["size"].cast("double"))
            return F.struct(F.round(common / norm, 6).alias("cosine"), t["t"].alias("t"), unit["whole"].alias("whole"))

        return F.transform(templates, cosine)

    body = F.coalesce(text, F.lit(""))
    paragraphs = F.transform(F.array(F.split(body, r"\n\s*\n")), lambda p: F.when(F.size(p) > 1, p).otherwise(F.array().cast("array<string>")))
    units = F.concat(F.split(body, "\n"), paragraphs[0])
    words = F.transform(units, lambda u: F.array_distinct(F.filter(F.split(F.lower(u), _WORD_BREAK), lambda w: w != "")))
    with_whole = F.transform(F.array(words), lambda u: F.concat(u, F.array(F.array_distinct(F.flatten(u)))))[0]
    marked = F.transform(F.array(with_whole), lambda a: F.transform(a, lambda u, i: F.struct(u.alias("words"), (i == F.size(a) - 1).alias("whole"))))[0]
    counted = F.transform(
        marked,
        lambda u: F.struct(
            F.array_intersect(u["words"], vocabulary).alias("hits"), F.size(u["words"]).cast("long").alias("n"), u["whole"].alias("whole")
        ),
    )
    weighed = F.transform(
        F.filter(counted, lambda u: F.size(u["hits"]) > 0),
        lambda u: F.struct(u["hits"], total(u["hits"]).alias("inside"), (u["n"] - F.size(u["hits"])).alias("others"), u["whole"]),
    )
    # a cosine is at most the share of the vector that lies in the vocabulary
    share = least * least * 0.999
    near = F.filter(weighed, lambda u: u["inside"] >= (u["inside"] + u["others"] * other) * share)
    scored = F.filter(F.flatten(F.transform(near, cosines)), lambda c: c["cosine"] >= least)
    pair = F.transform(
        F.array(scored),
        lambda s: F.struct(
            F.array_max(F.transform(F.filter(s, lambda c: ~c["whole"]), lambda c: F.struct(c["cosine"], c["t"]))).alias("own"),
            F.array_max(F.transform(F.filter(s, lambda c: c["whole"]), lambda c: F.struct(c["cosine"], c["t"]))).alias("whole"),
        ),
    )
    return pair[0]


def scan(files: DataFrame, key: str = "key", path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per file: key, path, license, cosine, origin (own, directory) and license_dir.

    Paths are separated by slashes; the root directory is the empty path.
    """
    directory = F.when(F.col(path).contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(F.col(path).isNotNull(), ""))
    name = F.regexp_extract(path, r"[^/]*$", 0)
    found = stage(
        files.select(
            F.col(key).alias("key"),
            F.col(path).alias("path"),
            directory.alias("dir"),
            F.coalesce(name.rlike(_LICENSE_FILE), F.lit(False)).alias("named"),
            _best(F.col(text), least).alias("best"),
        ),
        "licenses",
    )
    best = F.when(F.col("named"), F.greatest("best.whole", "best.own")).otherwise(F.col("best.whole"))
    licensed = found.select("dir", best.alias("whole")).where("whole is not null and dir is not null")
    licensed = licensed.groupBy(F.col("dir").alias("above")).agg(F.max("whole").alias("given"))

    # every directory once, joined with each directory above it and itself
    directories = found.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    steps = directories.select("dir", F.explode(F.array_distinct(above)).alias("up")).select("dir", "up.depth", F.col("up.above").alias("above_"))
    nearest = (
        steps.join(licensed, F.col("above_") == F.col("above"))
        .groupBy(F.col("dir").alias("dir_"))
        .agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    )
    joined = found.join(nearest, F.col("dir") == F.col("dir_"), "left")
    own = F.col("best.own").isNotNull()
    chosen = F.coalesce("best.own", "near.given")
    names = F.array(*(F.lit(name) for name, _ in TEMPLATES))
    return joined.select(
        "key",
        "path",
        F.get(names, -chosen["t"]).alias("license"),
        chosen["cosine"].alias("cosine"),
        F.when(own, "own").when(F.col("near").isNotNull(), "directory").alias("origin"),
        F.when(~own, F.col("near.above")).alias("license_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/thousand/doc_id, unknown where a part is null."""

    def part(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("unknown"))

    thousand = F.floor(F.col("doc_id") / 1000)
    return docs.select(
        F.col("doc_id").alias("key"),
        F.concat_ws("/", part(F.col("source")), part(F.col("lang")), part(thousand), part(F.col("doc_id"))).alias("path"),
        "text",
    )
