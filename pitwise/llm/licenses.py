"""License notices in texts: MinHash bands over overlapping windows, exact containment.

Texts and templates are words (runs of letters and digits, lower case) and their
``K``-word shingles. Templates of similar size share a size class ``s`` (``SMALLEST`` times a
power of four, no smaller than the template) and are looked for in windows of ``2 s``
shingles, one every ``s``, so every whole occurrence lies in some window.

Every window is signed by one-permutation MinHash: the top bits of a shingle's hash
name its bin, and the signature is the least hash of each bin that has any. A bin is a
band of one row. A window and a template that share ``need`` shingles of ``u`` in all fail to
collide in a band only if none of them is the least of its bin, which has about
probability ``(u / 2 bins) ** need``; the number of bins of a class is the power of two that
brings this below ``MISS`` for each of its templates. Retrieved windows are verified by
containment of the shingles themselves, as strings.

All of it is DataFrame functions. Templates lie in the plan (at most ``MAX_BANDS``
bands over all of them); windows without a colliding band are dropped where they are
read, and only the found (document, template) rows are shuffled.

Defined results: null texts and texts of fewer than ``K`` words hold no template;
the first of equally good windows is reported; repeated rows give one result; texts of
any length are read whole, a window at a time; no rows give none; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import let

K = 5
THRESHOLD = 0.8
MAX_BANDS = 100_000
SMALLEST = 8  # shingles of the first size class
MISS = 1e-6

#: Notices as licenses ask for them, or as they begin.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-grant": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x00-/:-`{-\\x7f]+"), lambda w: w != "")


def _shingles(tokens: Column, make) -> Column:
    """``make`` of the first place (from 0) of every shingle."""
    n = F.size(tokens) - K
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), make)).otherwise(F.array())


def hashes(tokens: Column) -> Column:
    return _shingles(tokens, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(K)]))


def strings(tokens: Column) -> Column:
    return _shingles(tokens, lambda i: F.concat_ws(" ", F.slice(tokens, i + 1, F.lit(K))))


def size_class(q: int) -> int:
    s = SMALLEST
    while s < q:
        s *= 4
    return s


def bin_bits(q: int, need: int, span: int) -> int:
    """Bits of the number of bins at which a window of ``span`` shingles that holds ``need`` of
    a template's ``q`` fails to collide with it less often than ``MISS``."""
    bits = 6
    while ((q + span) / (2 << bits)) ** need > MISS:
        bits += 1
    return bits


def signature(h: Column, bits: int) -> Column:
    """The least hash of each bin; bins follow each other when hashes are sorted."""

    def firsts(a: Column) -> Column:
        bin_of = lambda x: F.shiftright(x, 64 - bits)
        return F.filter(a, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(a, i - 1))))

    return let(F.sort_array(h), firsts)


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, dict[int, int]]:
    """``template, shingles, q, need, size, bands`` of the templates of ``K`` words or more,
    and the bits of each size class."""
    values = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(t).alias("text")) for n, t in templates.items()])
    t = spark.range(1).select(F.inline(values)).withColumn("tokens", words(F.col("text")))
    t = t.filter(F.size("tokens") >= K).select("template", F.array_distinct(let(F.col("tokens"), strings)).alias("shingles"), F.array_distinct(let(F.col("tokens"), hashes)).alias("h"))
    need = F.expr(f"int((q * {round(threshold * 10_000)} + 9999) div 10000)")
    t = t.withColumn("q", F.size("shingles")).withColumn("need", need)
    sizes = [tuple(r) for r in t.select("q", "need").distinct().collect()]  # templates lie in the plan, so they are few
    bits: dict[int, int] = {}
    for q, n in sizes:
        s = size_class(q)
        bits[s] = max(bits.get(s, 0), bin_bits(q, n, 2 * s))
    classes = sorted(bits)
    size = F.coalesce(*[F.when(F.col("q") <= s, s) for s in classes], F.lit(None).cast("int"))
    bands = F.coalesce(*[F.when(F.col("size") == s, signature(F.col("h"), bits[s])) for s in classes], F.array().cast("array<bigint>"))
    return t.withColumn("size", size).select("template", "shingles", "q", "need", "size", bands.alias("bands")), bits


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, template, n_template, n_shared, containment, first_word``: the best
    window of each document for each template it holds."""
    table, bits = template_table(docs.sparkSession, templates, threshold)
    bands = table.select("size", F.explode("bands")).distinct().limit(MAX_BANDS + 1).collect()
    if len(bands) > MAX_BANDS:
        raise ValueError(f"more than {MAX_BANDS} bands")

    def windows_of(size: int, h: Column) -> Column:
        """The windows of a size class with the bands that a template of it has, if any."""
        own = [band for s, band in bands if s == size]
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(size))
        signed = F.transform(starts, lambda at: F.struct(F.lit(size).alias("size"), at.alias("start"), F.filter(signature(F.slice(h, at + 1, F.lit(2 * size)), bits[size]), lambda x: x.isin(own)).alias("hits")))
        return F.filter(signed, lambda w: F.size(w["hits"]) > 0)

    def met_by(tokens: Column) -> Column:
        def of(h: Column) -> Column:
            return F.concat(*[windows_of(size, h) for size in sorted(bits)])

        return F.struct(tokens.alias("tokens"), let(hashes(tokens), of).alias("windows"))

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), let(words(F.col(text_col)), met_by).alias("met"))
    windows = rows.select("doc_id", "text_hash", F.col("met.tokens").alias("tokens"), F.explode("met.windows").alias("w"))
    hits = windows.select("doc_id", "text_hash", "tokens", F.col("w.size").alias("size"), F.col("w.start").alias("start"), F.explode("w.hits").alias("band"))
    by_band = table.withColumn("band", F.explode("bands")).select("size", "band", "template", "shingles", "q", "need")
    met = hits.join(F.broadcast(by_band), ["size", "band"])  # MAX_BANDS rows at most
    inside = F.slice("tokens", F.col("start") + 1, F.col("size") * 2 + K - 1)
    shared = F.size(F.array_intersect(let(inside, strings), F.col("shingles")))
    found = met.select("doc_id", "text_hash", "template", "q", "need", F.col("start").alias("first_word"), shared.alias("n_shared")).filter("n_shared >= need")
    best = found.groupBy("doc_id", "text_hash", "template", "q").agg(F.max("n_shared").alias("n_shared"), F.max_by("first_word", F.struct("n_shared", -F.col("first_word"))).alias("first_word"))
    return best.select("doc_id", "template", F.col("q").alias("n_template"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"), "first_word")
