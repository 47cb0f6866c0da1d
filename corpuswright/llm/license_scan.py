"""Licence scans by MinHash bands over overlapping windows, in SQL functions only.

Words become shingles of WIDTH words. Windows of a power of two of shingles overlap at every
offset; the minimum of each of BANDS permuted hashes over a window is found by doubling, from those
of the two halves. A template belongs to the longest window that it fills, and is retrieved by the
minima of its own windows of that length and of all shorter ones, since a cut notice in a short document
fills no long window. A window of one shingle is that shingle, so no document that shares one with a
template is missed. Exact containment of the template's shingles in the document's then decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables

WIDTH = 5
PERCENT = 80
BANDS = 4
#: Shingles in a window, for each class of template lengths.
WINDOWS = (1, 4, 16)
#: Words that tell nothing about a text, however long.
COMMON = frozenset("this that with from under about which where there their these those them they then than have your will without within other into also".split())
#: Template minima are broadcast up to so many rows; beyond, the join shuffles.
MOST_BROADCAST = 2_000_000
_MASKS = (0x0, 0x5DEECE66D1A2B3C4, 0x2545F4914F6CDD1D, 0x7F4A7C159E3779B9)

#: Notices as their licences word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "No part of this publication may be reproduced without the prior written permission of the publisher",
}


def _cleaned(text: Column) -> Column:
    """In lower case, without marks in and around words."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]++", "")


def _words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def anchors(words: list[list[str]]) -> str | None:
    """A pattern that every text holds which shares a shingle with a template: the longest word of each
    template shingle, common ones last. Texts without it can't collide in any band, and are passed by.
    words: of each template, cut by the same expressions as the texts."""
    found = {max(w[i : i + WIDTH], key=lambda x: (x not in COMMON, len(x), x)) for w in words for i in range(len(w) - WIDTH + 1)}
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(found)) + r")(?![\p{L}\p{N}])" if found else None


def _shingles(words: Column) -> Column:
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WIDTH)]))
    return F.slice(hashes, 1, F.greatest(F.lit(0), F.size(words) - (WIDTH - 1)))


def _doubled(minima: Column, half: int) -> Column:
    """Minima over windows twice as long; none where the row is shorter."""
    n = F.greatest(F.lit(0), F.size(minima) - half)
    return F.zip_with(F.slice(minima, 1, n), F.slice(minima, half + 1, n), lambda a, b: F.least(a, b))


def _minima(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows: keep columns and shingles. Returns keep, window, band, h: distinct minima of a row's windows."""
    out = rows.select(*keep, *[_xor(m).alias(f"b{k}_1") for k, m in enumerate(_MASKS)])
    have = 1
    while have < max(WINDOWS):
        out = out.select("*", *[_doubled(F.col(f"b{k}_{have}"), have).alias(f"b{k}_{2 * have}") for k in range(BANDS)])
        have *= 2
    # A window of one shingle is that shingle in every band: one will do.
    sets = [(w, k) for w in WINDOWS for k in range(BANDS if w > 1 else 1)]
    each = F.flatten(F.array(*[F.transform(F.array_distinct(F.col(f"b{k}_{w}")), _tagged(w, k)) for w, k in sets]))
    return out.select(*keep, F.explode(each).alias("e")).select(*keep, "e.*")


def _xor(mask: int) -> Column:
    return F.transform("shingles", lambda x: x.bitwiseXOR(F.lit(mask)))


def _tagged(w: int, k: int):
    return lambda h: F.struct(F.lit(w).alias("window"), F.lit(k).alias("band"), h.alias("h"))


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """license, shingles (distinct), n, window (of its class). Templates of fewer than WIDTH words have none and match nothing."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    rows = rows.select("license", _words(_cleaned(F.col("text"))).alias("words")).select("license", F.array_distinct(_shingles(F.col("words"))).alias("shingles")).withColumn("n", F.size("shingles")).where("n > 0")
    return rows.withColumn("window", reduce(lambda a, w: F.when(F.col("n") >= w, w).otherwise(a), WINDOWS[1:], F.lit(WINDOWS[0])))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, matched, template_shingles: templates of whose distinct shingles a document holds PERCENT.

    A null text holds nothing. Rows that repeat a doc_id, or have none, count as one document: what they hold
    together. Texts of any length count whole. Other columns are ignored. An empty table gives no rows."""
    spark = docs.sparkSession
    known = tables.written(template_table(spark, templates), "templates")
    keys = _minima(known.withColumnRenamed("window", "class"), ["license", "class"]).where("window <= class").select("license", "window", "band", "h").distinct()
    keys = tables.written(keys, "keys")
    listed = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    pattern = anchors([r["words"] for r in listed.select(_words(_cleaned(F.col("text"))).alias("words")).collect()])  # the templates
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _cleaned(F.col(text_col).cast("string")).alias("cleaned"))
    rows = rows.where(F.col("cleaned").rlike(pattern) if pattern else F.lit(False))
    # Written once: what follows is planned on plain columns, not on these expressions repeated.
    rows = tables.written(rows.select("doc_id", _words(F.col("cleaned")).alias("words")), "anchored")
    rows = tables.written(rows.select("doc_id", _shingles(F.col("words")).alias("shingles")), "shingles")
    small = keys.count() <= MOST_BROADCAST
    found = _minima(rows, ["doc_id"]).join(F.broadcast(keys) if small else keys, ["window", "band", "h"]).select("doc_id", "license").distinct()
    found = tables.written(found, "retrieved")

    # Exact containment, for the documents retrieved.
    named = found.select(F.col("doc_id").alias("__doc"), F.col("license").alias("__license"))
    held = rows.join(named.select("__doc").distinct(), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi").select("doc_id", F.explode("shingles").alias("h"))
    wanted = known.select("license", F.col("n").alias("template_shingles"), F.explode("shingles").alias("h"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("license") == F.col("__license"))
    held = held.join(F.broadcast(wanted) if small else wanted, "h").join(named, same, "left_semi")
    counts = held.groupBy("doc_id", "license", "template_shingles").agg(F.count_distinct("h").alias("matched"))
    return counts.where(F.col("matched") * 100 >= F.col("template_shingles") * PERCENT).select("doc_id", "license", "matched", F.col("template_shingles").cast("long").alias("template_shingles"))


def oracle() -> str:
    """The same by exact containment alone, for DuckDB."""
    listed = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    words = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    cut = f"list_distinct(list_transform(range(1, greatest(1, len(w) - {WIDTH - 2})), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')))"
    return f"""
WITH t AS (SELECT license, {cut} AS s FROM (SELECT license, {words} AS w FROM (VALUES {listed}) v(license, text))),
ts AS (SELECT license, len(s) AS template_shingles, unnest(s) AS h FROM t),
d AS (SELECT DISTINCT doc_id, unnest({cut}) AS h FROM (SELECT doc_id, {words} AS w FROM documents))
SELECT doc_id, license, count(*) AS matched, template_shingles FROM d JOIN ts USING (h)
GROUP BY doc_id, license, template_shingles HAVING count(*) * 100 >= template_shingles * {PERCENT}
"""
