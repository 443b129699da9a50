"""License scans with DataFrame functions only.

Texts are read as lower-case runs of letters and digits; shingles are five of them. Each template's size
picks a window size (half powers of two), and documents are cut into windows of each such size, a
quarter apart. MinHash bands of the windows retrieve templates, and the exact share of the template's
shingles found around the window decides.

Bands: ``BANDS`` bands of two minima. A window within an eighth of its size of a passage that holds 0.8
of a template has a Jaccard similarity of 0.43 or more with it, so at least one band agrees with
probability 1 - (1 - 0.43**2)**32 > 0.998.

Only windows that hold a template's shingle are hashed, and only documents that contain one of the words
that together hit every template shingle are cut at all; neither can lose a match.

Defined cases: null and empty texts match nothing; a template or text below five words is one shingle;
texts of any length are read whole; repeated rows match each; an empty table gives no rows; other
columns are not read; equal shares go to the first window. Templates are a list that the driver holds;
each pass looks for a bounded number of them (``MOST_TEMPLATE_SHINGLES``), so their bands are broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
BANDS = 32
CONTAINMENT = 0.8
#: Template shingles that one pass over the documents looks for; more take further passes.
MOST_TEMPLATE_SHINGLES = 20_000

COMMON = frozenset("a an and any are as at be by for in is it not of on or that the this to under use with work you".split())

# fixed values: public license notices
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def notices(spark: SparkSession) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(NOTICES)]
    return spark.createDataFrame(rows, "template_id int, license string, text string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(of: str) -> Column:
    """Hashes of the shingles of a column of words, in text order."""
    last = f"greatest(size({of}) - {WORDS - 1}, 1)"
    every = f"transform(sequence(1, {last}), i -> xxhash64(concat_ws(' ', slice({of}, i, {WORDS}))))"
    return F.expr(f"CASE WHEN size({of}) > 0 THEN {every} ELSE cast(array() AS array<bigint>) END")


def bands(of: str) -> Column:
    """(band, key) of a column of shingles: each key is made of the minima of two hash functions."""
    least = f"array_min(transform({of}, x -> xxhash64(x, {{}})))"
    pair = f"xxhash64(b, {least.format('2 * b')}, {least.format('2 * b + 1')})"
    return F.expr(f"transform(sequence(0, {BANDS - 1}), b -> {pair})")


def window_size(shingle_count: Column) -> Column:
    return F.round(F.pow(F.lit(2.0), F.round(2 * F.log2(shingle_count)) / 2)).cast("int")


def hitting_words(texts: list[str]) -> list[str]:
    """A few words such that every shingle of every text holds one; long words are rarer, so preferred, and common ones last."""
    every = []
    for text in texts:
        own = re.findall(r"[a-z0-9]+", text.lower())
        every += [set(own[i : i + WORDS]) for i in range(max(1, len(own) - WORDS + 1))]
    chosen: list[str] = []
    while every := [s for s in every if s and not s & set(chosen)]:
        counts = {w: sum(w in s for s in every) for s in every for w in s}
        chosen.append(max(sorted(counts), key=lambda w: (w not in COMMON, counts[w] * len(w) ** 2)))
    return chosen


def template_groups(sizes: dict[int, int]) -> list[list[int]]:
    """Template ids in groups of ``MOST_TEMPLATE_SHINGLES`` at most, or one template that alone has more."""
    groups, held = [[]], 0
    for key, n in sorted(sizes.items()):
        if groups[-1] and held + n > MOST_TEMPLATE_SHINGLES:
            groups.append([])
            held = 0
        groups[-1].append(key)
        held += n
    return groups


def scan(
    docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document and template found: ids, license, first word of the best window, and the share found."""
    if templates is None:
        templates = notices(docs.sparkSession)
    known = templates.select("template_id", "license", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    known = known.withColumn("t", F.array_distinct(shingles("w"))).withColumn("size", window_size(F.size("t")))
    bounded = known.select("template_id", "t", "size", F.array_join("w", " ").alias("words")).collect()  # templates, not documents
    groups = template_groups({r["template_id"]: len(r["t"]) for r in bounded})
    if len(groups) > 1:
        some = [scan(docs, templates.filter(F.col("template_id").isin(group)), containment, id_col, text_col) for group in groups]
        return reduce(DataFrame.unionByName, some)
    held = sorted({x for r in bounded for x in r["t"]})
    if not held:
        return docs.select(F.col(id_col), F.lit(0).alias("template_id"), F.lit("").alias("license"), F.lit(0).alias("start_word"), F.lit(0.0).alias("containment")).limit(0)
    sizes = sorted({r["size"] for r in bounded})

    low = F.lower(F.col(text_col))
    some = F.lit(False)
    for word in hitting_words([r["words"] for r in bounded]):
        some = some | low.contains(word)
    cut = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(some)
    cut = cut.select("_id", words(F.col("_text")).alias("_w")).select("_id", shingles("_w").alias("s"))
    places = F.filter(F.transform("s", lambda x, i: F.when(x.isin(held), i)), lambda i: i.isNotNull())
    # no filter on what follows: the optimiser would move it below and compute the words once per shingle
    cut = cut.withColumn("hits", places)

    def starts(size: int) -> str:
        step = max(1, size // 4)
        first = f"cast(ceil(greatest(p - {size - 1}, 0) / {step}) AS int) * {step}"
        return f"transform(array_distinct(flatten(transform(hits, p -> sequence({first}, p div {step} * {step}, {step})))), a -> named_struct('size', {size}, 'start', cast(a AS int)))"

    windows = cut.withColumn("at", F.explode(F.expr("concat(" + ", ".join(map(starts, sizes)) + ")"))).select("_id", "s", "at.size", "at.start")
    window = F.expr("array_distinct(slice(s, start + 1, size))")
    # what a match around the window may reach: half a window to either side
    around = F.expr("array_distinct(slice(s, greatest(start - size div 2, 0) + 1, 2 * size + 1))")
    windows = windows.select("_id", "size", "start", window.alias("x"), around.alias("around"))
    asked = windows.select("_id", "size", "start", "around", F.posexplode(bands("x")).alias("band", "key"))
    wanted = known.select("template_id", "license", "t", "size", F.posexplode(bands("t")).alias("band", "key"))
    met = asked.join(F.broadcast(wanted), ["size", "band", "key"])  # bounded above
    share = (F.size(F.array_intersect("around", "t")) / F.size("t")).alias("containment")
    found = met.select("_id", "template_id", "license", "start", share).filter(F.col("containment") >= containment)
    best = F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("best")
    found = found.groupBy(F.col("_id").alias(id_col), "template_id", "license").agg(best)
    return found.select(id_col, "template_id", "license", (-F.col("best.back")).alias("start_word"), "best.containment")
