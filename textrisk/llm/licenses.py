"""License scan: TF-IDF cosine to templates, then inheritance from directories.

1. Two kinds of vectors are compared with templates. Headers: around every cue word of
   every whole text, windows of all header lengths (``window_sizes``) that hold the cue;
   a text is its sequence of terms, so windows run across line ends and comment marks
   and are cut out of long lines. License files: the whole text with whole licenses
   (``license_texts``). Terms are weighted by tf * idf with document frequencies over
   all files that hold a cue, and compared with all templates through a join on the term
   (templates are a parameter with a checked bound, so their side is small). A window is
   compared with templates of about its length, and one that names its license or
   version (``NAMES``) only fits a window that does. A file's own license is that of its
   best vector, if the cosine reaches ``THRESHOLD`` (``WHOLE`` for whole texts); one in
   ``BARE`` counts only where no other license is found.
2. A license file (by name: LICENSE, COPYING, ...) gives its license to its directory. A
   file without a license of its own takes the one of its nearest ancestor directory: its ancestor paths are joined with the
   directories' licenses, and the deepest wins. The join key is a directory, and each
   directory has one row, so a directory that holds a third of all files only makes one
   side long, which Spark splits.

Defined results: null text is empty; ties of the cosine go to the template that sorts
first (whole texts before headers, longer headers before shorter ones), ties between license files of a directory to the path that sorts first; files
without any license have nulls; repeated rows (same path) get the same result each. A
null path has no directory.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import table, written

THRESHOLD = 0.6
MAX_TEMPLATES = 10_000
WHOLE = 0.85  # long English texts share their most common words
LEAST_LENGTH, MOST_LENGTH = 0.7, 2.8  # of a window, in lengths of the template
CUE = (r"(?i)licen[cs]e|copyright|rights[^a-z0-9]+reserved|spdx|permission[^a-z0-9]+is[^a-z0-9]+hereby"
       r"|redistribution[^a-z0-9]+and[^a-z0-9]+use|public[^a-z0-9]+domain")
CUE_TERM = r"license|copyright|spdx|^(reserved|permission|redistribution|domain)$"  # terms that windows surround
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"

# Header lines of public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
)


# Terms that name a license or its version, by license; of each group one must occur.
NAMES = {
    "Apache-2.0": (("apache", "apache-2.0"), ("2.0", "2", "v2", "v2.0", "apache-2.0")),
    "MIT": (("mit",),),
    "GPL-3.0": (("3", "3.0", "v3", "gplv3", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"),),
    "GPL-2.0": (("2", "2.0", "v2", "gplv2", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"),),
    "LGPL-3.0": (("lesser",), ("3", "3.0", "v3")),
    "LGPL-2.1": (("lesser",), ("2.1", "v2.1")),
    "AGPL-3.0": (("affero",), ("3", "3.0", "v3")),
    "BSD-3-Clause": (("bsd-3-clause",),),
    "MPL-2.0": (("mozilla",), ("2.0", "2", "v2.0")),
    "CC-BY-4.0": (("by",), ("4.0",)),
    "CC-BY-SA-4.0": (("by-sa",), ("4.0",)),
    "CC-BY-NC-4.0": (("by-nc",), ("4.0",)),
}
BARE = ("proprietary",)  # a reservation of rights that also stands above other licenses


def whole_licenses() -> list[tuple[str, str]]:
    """(license, text) of the whole licenses beside this file."""
    return [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8"))
            for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def terms(text: Column) -> Column:
    """Words and numbers of a lower-cased text; by-nc and 2.0 are one term each, licence is license."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "licenc", "licens"),
                                F.lit(r"[a-z0-9]+(?:[.-][a-z0-9]+)*"), F.lit(0))


def window_sizes(longest: int) -> list[int]:
    """Every length up to 8, then steps of a fifth, up to the first from ``longest`` on."""
    sizes = [2]
    while sizes[-1] < longest:
        sizes.append(max(sizes[-1] + 1, sizes[-1] * 6 // 5) if sizes[-1] >= 8 else sizes[-1] + 1)
    return sizes


def _weights(rows: DataFrame, keys: Sequence[str], idf: DataFrame, unseen: Column) -> DataFrame:
    """(keys, term, w): tf * idf scaled to unit length per keys."""
    tf = rows.select(*keys, F.explode(terms(F.col("line"))).alias("term")).groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("tf"))
    w = tf.join(idf, "term", "left").select(*keys, "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, list(keys)).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def _contexts(all_terms: Column, reach: int) -> Column:
    """Per cue of a text its place in, and the terms within, ``reach`` terms before and after."""
    places = F.filter(F.sequence(F.lit(0), F.size(all_terms) - 1), lambda i: F.get(all_terms, i).rlike(CUE_TERM))
    return F.transform(places, lambda i: F.struct(
        F.least(i, F.lit(reach)).alias("cue"),
        F.slice(all_terms, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1).alias("around")))


def _windows(around: Column, cue: Column, sizes: Sequence[int]) -> Column:
    """The windows that hold the cue and begin with a term of a template."""
    starts = F.filter(F.sequence(F.lit(0), cue), lambda i: F.get(around, i)["known"])
    return F.flatten(F.transform(starts, lambda i: F.transform(
        F.filter(F.array(*[F.lit(z) for z in sizes]), lambda z: (i + z > cue) & (i + z <= F.size(around))),
        lambda z: F.struct(i.alias("at"), F.slice(around, i + 1, z).alias("window")))))


def own_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text",
                 templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                 wholes: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(path, license, score) of every file with a license header or text of its own."""
    wholes = whole_licenses() if wholes is None else wholes
    if len(templates) + len(wholes) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    spark = files.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = spark.createDataFrame([(i, name, line, [list(g) for g in NAMES.get(name, ())]) for i, (name, line) in enumerate(templates)],
                                  "template int, license string, line string, names array<array<string>>")
    known = known.withColumn("length", F.size(terms(F.col("line")))).withColumn(
        "names", F.when(F.forall("names", lambda g: F.arrays_overlap(g, terms(F.col("line")))), F.col("names"))
        .otherwise(F.array().cast("array<array<string>>")))
    longest = known.agg(F.max("length")).first()[0] or 2
    found = files.where(text.rlike(CUE) & F.col(path_col).isNotNull()).select(
        F.col(path_col).alias("path"), terms(text).alias("all_terms"))
    lines = written(found.select("path", F.posexplode(_contexts(F.col("all_terms"), longest)).alias("no", "c"))
                    .select("path", "no", F.xxhash64("c").alias("key"), "c.cue", "c.around"), "license-lines")
    whole = written(files.where(F.element_at(F.split(path_col, "/"), -1).rlike(LICENSE_FILE) & text.rlike(CUE))
                    .select(F.col(path_col).alias("path"), F.xxhash64(text).alias("key"), text.alias("line")), "license-texts")
    seen = lines.select("path", F.explode("around").alias("term")).distinct()
    idf = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(
        F.broadcast(lines.agg(F.count_distinct("path").alias("n")))).select(
        "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    total = lines.select("path").distinct().count()
    unseen = F.log(1.0 + F.lit(float(total))) + 1.0

    # Headers. Distinct surroundings are few (headers repeat): compare each of them once.
    of_template = _weights(known, ["template"], idf, unseen).select("template", "term", F.col("w").alias("tw"))
    vocabulary = of_template.select("term").distinct().withColumn("known", F.lit(True))
    around = (lines.select("key", "cue", "around").dropDuplicates(["key"])
              .select("key", "cue", F.posexplode("around").alias("pos", "term"))
              .join(idf, "term").join(F.broadcast(vocabulary), "term", "left")
              .groupBy("key").agg(F.first("cue").alias("cue"), F.array_sort(F.collect_list(F.struct(
                  "pos", "term", "idf", F.coalesce("known", F.lit(False)).alias("known")))).alias("around")))
    window = (around.select("key", F.explode(_windows(F.col("around"), F.col("cue"), window_sizes(longest))).alias("w"))
              .select("key", "w.at", F.size("w.window").alias("size"), F.explode("w.window").alias("t"))
              .groupBy("key", "at", "size", "t.term", "t.known").agg(F.sum("t.idf").alias("w"))
              .groupBy("key", "at", "size").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
                                                F.collect_list(F.when(F.col("known"), F.struct("term", "w"))).alias("terms")))
    fits = (window.select("key", "at", "size", "norm", F.col("terms.term").alias("words"), F.explode("terms").alias("t"))
            .select("key", "at", "size", "norm", "words", "t.term", "t.w")
            .join(F.broadcast(of_template), "term")
            .groupBy("key", "at", "size", "template").agg(
                F.round(F.sum(F.col("w") * F.col("tw")) / F.first("norm"), 9).alias("score"), F.first("words").alias("words"))
            .where(F.col("score") >= threshold)
            .join(F.broadcast(known.select("template", "license", "length", "names")), "template")
            .where((F.col("size") >= LEAST_LENGTH * F.col("length")) & (F.col("size") <= MOST_LENGTH * F.col("length"))
                   & F.forall("names", lambda g: F.arrays_overlap(g, F.col("words")))))
    rank = F.struct(~F.col("license").isin(*BARE), F.col("score"), F.col("length"), -F.col("template"))
    header = fits.groupBy("key").agg(F.max_by(F.struct("license", "score", "length", "template"), rank).alias("b")).select("key", "b.*")

    # Whole texts of license files.
    text_of = spark.createDataFrame([(i, name, t) for i, (name, t) in enumerate(wholes)], "template int, license string, line string")
    of_whole = _weights(text_of, ["template", "license"], idf, unseen).withColumnRenamed("w", "tw")
    complete = (_weights(whole.select("key", "line").dropDuplicates(["key"]), ["key"], idf, unseen)
                .join(F.broadcast(of_whole), "term").groupBy("key", "template", "license")
                .agg(F.round(F.sum(F.col("w") * F.col("tw")), 9).alias("score")).where(F.col("score") >= WHOLE)
                .withColumn("length", F.lit(1 << 30)))
    kinds = (lines.select("path", "no", "key").join(header, "key")
             .unionByName(whole.select("path", F.lit(-1).alias("no"), "key").join(complete, "key")))
    return (kinds.groupBy("path").agg(F.max_by(F.struct("license", "score"), F.struct(
        ~F.col("license").isin(*BARE), F.col("score"), F.col("length"), -F.col("template"), -F.col("no"))).alias("b"))
            .select("path", "b.license", "b.score"))


def ancestors(path: Column) -> Column:
    """The directories above a path, from the root '' down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text",
                  templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` with own_license, score, license and inherited_from (a directory)."""
    own = written(own_licenses(files, path_col, text_col, templates, threshold), "own-licenses")
    name = F.element_at(F.split("path", "/"), -1)
    per_dir = (own.where(name.rlike(LICENSE_FILE))
               .withColumn("dir", F.element_at(ancestors(F.col("path")), -1))
               .groupBy("dir").agg(F.min_by("license", "path").alias("dir_license")))
    paths = files.select(F.col(path_col).alias("path")).where(F.col("path").isNotNull()).distinct()
    bare = paths.join(own, "path", "left_anti")
    inherited = (bare.select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
                 .join(per_dir, "dir").groupBy("path")
                 .agg(F.max_by(F.struct("dir", "dir_license"), F.size(F.split("dir", "/")) + (F.col("dir") != "").cast("int"))
                      .alias("d")).select("path", "d.dir", "d.dir_license"))
    known = (own.select("path", F.col("license").alias("own_license"), "score",
                        F.col("license"), F.lit(None).cast("string").alias("inherited_from"))
             .unionByName(inherited.select("path", F.lit(None).cast("string").alias("own_license"),
                                           F.lit(None).cast("double").alias("score"),
                                           F.col("dir_license").alias("license"), F.col("dir").alias("inherited_from"))))
    known = known.withColumnRenamed("path", "_ls_path")
    plain = files.select(*[c for c in files.columns if c not in ("own_license", "score", "license", "inherited_from")])
    return plain.join(known, plain[path_col] == known["_ls_path"], "left").drop("_ls_path")


def document_path(source: Column, doc_id: Column) -> Column:
    """Documents as files of a tree: source / thousand / hundred / file; the first
    document of each hundred stands for its directory's LICENSE file, the first of each
    thousand for that directory's."""
    i = F.coalesce(doc_id, F.lit(0)).cast("long")
    top = F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.floor(i / 1000).cast("string"))
    sub = F.concat_ws("/", top, F.floor(F.pmod(i, F.lit(1000)) / 100).cast("string"))
    return (F.when(F.pmod(i, F.lit(1000)) < 10, F.concat(top, F.lit("/LICENSE."), i.cast("string")))
            .when(F.pmod(i, F.lit(100)) < 10, F.concat(sub, F.lit("/LICENSE."), i.cast("string")))
            .otherwise(F.concat(sub, F.lit("/"), i.cast("string"), F.lit(".txt"))))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", document_path(F.col("source"), F.col("doc_id")).alias("path"))
    return scan_licenses(docs).select(
        "doc_id", "path", "own_license", F.round("score", 6).alias("score"), "license", "inherited_from")
