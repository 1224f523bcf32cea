"""Licences of files: notices by TF-IDF cosine to templates, else those of the nearest directory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprof.scratch import write_once

# A passage shows a licence from this cosine on.
COSINE = 0.6
# Words that a line and its template must share: a single one shows no licence.
SHARED = 2
# Decimals of a reported cosine.
DIGITS = 6
# Notices by which works state their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited"),
)
# Names of files that state the licence of their directory.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"
_BETWEEN = r"[^\p{L}\p{N}]+"


def scan(files: DataFrame, id: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """The licence of every file: ``id, path, license, cosine, origin, license_dir``.

    Every line of a file is a passage: its distinct lower-case words, weighted by their
    rarity among the lines of all files.  A line shows the licence of the template with the
    largest cosine, from COSINE on and with SHARED words or more in common (equal ones: the
    first by name); a file has the licence of
    its best line (``origin`` "own").  A file without one has that of the nearest directory
    at or above its own in which a licence file shows one ("inherited"; of several files in
    a directory the largest cosine counts), and nulls if there is none.

    Lines whose words are mostly unknown to all templates cannot reach COSINE and are left
    out by a bound.  Null texts are empty, a null path is a directory of its own without
    ancestors; rows that share an id and a path are one file.  Other columns are not
    read.  An empty table gives an empty table.
    """
    templates = _templates(files.sparkSession)
    words = F.array(*[F.lit(w) for w in sorted(_vocabulary())])
    lines = files.select(
        F.col(id).alias("id"), F.col(path).alias("path"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line"),
    )
    lines = lines.select("id", "path", F.array_distinct(_words(F.col("line"))).alias("words")).filter(F.size("words") > 0)
    lines = lines.select("id", "path", F.size("words").alias("n"), F.array_intersect("words", words).alias("known"))

    seen = lines.select(F.explode(F.concat("known", F.array(F.lit("")))).alias("word"))
    seen = seen.groupBy("word").agg(F.count(F.lit(1)).alias("lines"))
    # At most a row for each word of the templates.
    rarity = write_once(seen, "rarity")
    total = sum(r["lines"] for r in rarity.filter("word = ''").collect())
    idf = F.log((total + 1) / (F.coalesce(F.col("lines"), F.lit(0)) + 1)) + 1
    top = math.log(total + 1) + 1
    weighed = templates.join(rarity, "word", "left").select("template", "license", "word", idf.alias("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm"))
    weighed = weighed.join(norms, "template")
    by_word = weighed.groupBy("word").agg(
        F.first("idf").alias("idf"), F.collect_list(F.struct("license", "template", "norm")).alias("uses"),
    )
    # A bound: unknown words weigh no less than known ones.
    able = F.size("known") >= COSINE**2 / (1 - COSINE**2) * (F.col("n") - F.size("known"))
    able = lines.filter(able & (F.size("known") > 0)).withColumn("line", F.monotonically_increasing_id())
    # Lines get their number before anything is shuffled; it only tells lines of a file apart.
    able = write_once(able, "lines")
    parts = able.select("id", "path", "line", "n", F.explode("known").alias("word")).join(F.broadcast(by_word), "word")
    lengths = parts.groupBy("line").agg(
        F.sqrt(F.sum(F.col("idf") ** 2) + (F.first("n") - F.count(F.lit(1))) * top**2).alias("length")
    )
    products = parts.select("id", "path", "line", F.explode("uses").alias("use"), "idf").groupBy(
        "id", "path", "line", "use.license", "use.template", "use.norm"
    ).agg(F.sum(F.col("idf") ** 2).alias("product"), F.count(F.lit(1)).alias("shared"))
    products = products.filter(F.col("shared") >= SHARED)
    cosine = F.round(F.col("product") / F.col("norm") / F.col("length"), DIGITS)
    shown = products.join(lengths, "line").withColumn("cosine", cosine).filter(F.col("cosine") >= COSINE)
    best = shown.groupBy("id", "path").agg(
        F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best")
    ).select("id", "path", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("cosine"))
    best = write_once(best, "licenses")

    stated = best.filter(F.col("path").rlike(LICENSE_FILE)).select(_directory(F.col("path")).alias("dir"), "license", "cosine")
    stated = stated.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("s"))
    named = files.select(F.col(id).alias("id"), F.col(path).alias("path")).withColumn("dir", _directory(F.col("path")))
    near = _nearest(named.select("dir").filter("dir is not null").distinct(), stated)
    out = named.join(
        best.select(F.col("id").alias("i"), F.col("path").alias("p"), "license", "cosine"),
        F.col("id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")), "left",
    ).join(near, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        F.col("id").alias(id), F.col("path").alias(path),
        F.coalesce("license", "s.license").alias("license"),
        F.coalesce("cosine", -F.col("s.minus")).alias("cosine"),
        F.when(own, "own").when(F.col("s").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("license_dir")).alias("license_dir"),
    )


def _nearest(directories: DataFrame, stated: DataFrame) -> DataFrame:
    """For each directory the nearest one, itself or above, that states a licence."""
    steps = F.split("dir", "/")
    above = directories.select("dir", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")
    )).alias("above"))
    found = above.distinct().join(stated.withColumnRenamed("dir", "above"), "above")
    return found.groupBy("dir").agg(
        F.max(F.struct(F.length("above").alias("depth"), F.col("above").alias("license_dir"), "s")).alias("m")
    ).select("dir", "m.license_dir", "m.s")


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")


def _vocabulary() -> set[str]:
    return {w for _, text in TEMPLATES for w in template_words(text)}


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _templates(spark: SparkSession) -> DataFrame:
    rows = [
        (number, license, word)
        for number, (license, text) in enumerate(TEMPLATES) for word in sorted(set(template_words(text)))
    ]
    return spark.createDataFrame(rows, "template int, license string, word string")
