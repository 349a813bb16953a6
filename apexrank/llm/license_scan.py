"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, let, settle
from .windows import references, sizes_present, windows

#: Share of a template's shingles that a window has to hold.
THRESHOLD = 0.8
#: A window is as long as its template, so containment 0.8 is a Jaccard similarity of 2/3 at least; 24 bands of 2 rows then
#: collide with probability 1 - (1 - 4/9)**24, all but one in a million.
BANDS, ROWS = 24, 2

# Public license notices and the characteristic passages of license texts.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def band_keys(shingles: Column) -> Column:
    """The keys of BANDS bands of ROWS least hashes each, every hash under a seed of its own."""

    def of(items: Column) -> Column:
        least = lambda seed: F.array_min(F.transform(items, lambda x: F.xxhash64(x, seed)))
        return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + r) for r in range(ROWS)]))

    return let(shingles, of)


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, start_word, n_words, containment for each place of docs (doc_id, text) that holds a template of known (license,
    text; default: TEMPLATES): the place where the most of the template's distinct shingles of five words is found, if that is
    `threshold` of them or more; of ties the first, those first that have a shingle where the template first has it. Words are runs
    of letters and digits, case aside, and start_word counts them from 0.

    A window's band keys can equal a template's only where the window holds the shingle that gave the key, so bands are computed for
    the windows that share a shingle with some template (see windows()), and the join of their keys names the template.

    Of several templates of one license the best is given. A template with fewer than five words is one shingle. Null and wordless
    texts hold nothing; very long ones are scanned whole; rows are scanned each, and equal rows give one result for a doc_id. Other columns are ignored; empty tables give none.
    """
    known = known if known is not None else templates(docs.sparkSession)
    named = settle(known.where("text is not null").select("license", "text").distinct().withColumn("ref_id", F.xxhash64("license", "text")), "templates")
    refs = references(named)
    found = []
    for k in sizes_present(refs):
        own = settle(refs.where(F.col("k") == k).select("ref_id", F.array_distinct("shingles").alias("template"), "n"), "sets")
        rows = own.count()
        seen = windows(docs, refs, k, lambda words, n, distinct: F.ceil(distinct * threshold - 1e-6).cast("int")).where("size(shingles) > 0")
        once = [F.first(c).alias(c) for c in ("doc_id", "shingles")]
        seen = seen.groupBy("key", "start", "n").agg(*once, F.collect_set(F.when(F.col("lined"), F.col("ref_id"))).alias("lined"))
        seen = settle(seen.withColumn("keys", band_keys(F.col("shingles"))), "windows")
        bands = own.select("ref_id", "n", F.explode(band_keys(F.col("template"))).alias("band"))
        near = seen.select("key", "start", "n", F.explode("keys").alias("band")).join(checked(bands, rows * BANDS), ["band", "n"]).select("key", "start", "n", "ref_id").distinct()
        near = seen.drop("keys").join(near, ["key", "start", "n"]).join(checked(own.select("ref_id", "template"), rows, 20_000), "ref_id")
        share = F.size(F.array_intersect("template", "shingles")) / F.size("template")
        found.append(near.select("doc_id", "ref_id", "start", "n", F.array_contains("lined", F.col("ref_id")).alias("lined"), share.alias("containment")).where(F.col("containment") >= threshold))
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, license string, start_word int, n_words int, containment double")
    every = reduce(DataFrame.unionByName, found).join(checked(named.select("ref_id", "license"), named.count()), "ref_id")
    best = every.groupBy("doc_id", "license").agg(F.max(F.struct("containment", "lined", (-F.col("start")).alias("before"), "n")).alias("best"))
    return best.select("doc_id", "license", (-F.col("best.before")).alias("start_word"), F.col("best.n").alias("n_words"), "best.containment")
