"""Licences of files: what their lines say, by TF-IDF cosine to templates, and what their folder's licence file says.

A line's words and a template's words are weighed by how rare they are in the lines of the whole corpus.  A file
without a licence line of its own has the licence of the nearest folder above it that holds a licence file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

# Statements by which licences are recognised, as public licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Licensed under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License version 3 as published by the Free Software Foundation"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC0-1.0", "dedicated to the public domain under CC0 1.0"),
    ("proprietary", "All rights reserved"),
)

# Words of all templates together, at most: what is known of them fits any task.
MAX_VOCABULARY = 20_000

# Names of licence files, lower case.
LICENSE_FILE = r"^(licen[cs]e|copying|notice)([._-].*)?$"


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(rows), "license string, statement string")


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}.]+|\.(?![0-9])"), "")


def _lines(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """``(path, words)`` per line; the barrier keeps the words from being worked out twice."""
    cut = files.select(F.col(path_col).alias("path"), F.posexplode_outer(F.split(text_col, "\n")).alias("line", "t"))
    return cut.select("path", "line", F.explode_outer(F.array(words_of(F.col("t")))).alias("words")).where(F.size("words") > 0)


def statements(files: DataFrame, known: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """``(path, line, license, cosine)``: every line that is close to a template, with the closest.

    A word, of a line or a template, weighs its count times ``log((1 + lines) / (1 + lines with it)) + 1``.  Ties go to
    the smaller name.
    """
    lines = _lines(files, path_col, text_col)
    parts = known.select("license", "statement", F.explode(words_of(F.col("statement"))).alias("word"))
    tf = stored(parts.groupBy("license", "statement", "word").agg(F.count(F.lit(1)).alias("tf")), "templates")
    if tf.select("word").distinct().limit(MAX_VOCABULARY + 1).count() > MAX_VOCABULARY:
        raise ValueError(f"templates of more than {MAX_VOCABULARY} words")

    # One pass over all text counts the lines, and those with each word.  The mark "" is every line's.
    seen = lines.select(F.explode(F.concat(F.array_distinct("words"), F.array(F.lit("")))).alias("word"))
    df = stored(seen.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "line-counts")
    total = df.where("word = ''").agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]
    idf = lambda n: F.log((1.0 + total) / (1.0 + n)) + 1
    weighed = tf.join(df, "word", "left").withColumn("w", F.col("tf") * idf(F.coalesce("df", F.lit(0))))
    # A line with none of a template's heaviest words cannot be that close to it: the rest is too short a vector.
    by_weight = Window.partitionBy("license", "statement").orderBy(F.desc("w"), "word")
    whole = Window.partitionBy("license", "statement")
    heavy = weighed.withColumn("norm2", F.sum(F.col("w") * F.col("w")).over(whole)).withColumn(
        "above2", F.sum(F.col("w") * F.col("w")).over(by_weight.rowsBetween(Window.unboundedPreceding, -1))
    )
    heavy = stored(heavy, "template-weights")
    rest2 = F.col("norm2") - F.coalesce("above2", F.lit(0.0))
    anchors = [r.word for r in heavy.where(rest2 >= least * least * F.col("norm2") * (1 - 1e-9)).select("word").distinct().collect()]
    gate = F.arrays_overlap("words", F.array(*map(F.lit, sorted(anchors)))) if anchors else F.lit(False)
    open_lines = lines.where(gate).select("path", "line", F.explode("words").alias("word"))
    counted = open_lines.groupBy("path", "line", "word").agg(F.count(F.lit(1)).alias("n"))
    weights = df.where("word <> ''").select("word", idf(F.col("df")).alias("idf"))
    counted = stored(counted.join(weights, "word").withColumn("lw", F.col("n") * F.col("idf")), "license-lines")
    norms = counted.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("lw") * F.col("lw"))).alias("line_norm"))
    dots = (
        counted.select("path", "line", "word", "lw")
        .join(heavy.select("license", "statement", "word", "w", "norm2"), "word")
        .groupBy("path", "line", "license", "statement", "norm2")
        .agg(F.sum(F.col("lw") * F.col("w")).alias("dot"))
    )
    close = dots.join(norms, ["path", "line"]).withColumn(
        "cosine", F.least(F.col("dot") / F.col("line_norm") / F.sqrt("norm2"), F.lit(1.0))
    )
    best = close.where(F.col("cosine") >= least).groupBy("path", "line").agg(
        F.max(F.struct(F.col("cosine"), F.col("license"))).alias("hi"), F.min(F.struct(-F.col("cosine"), F.col("license"))).alias("lo")
    )
    return best.select("path", "line", F.col("lo.license").alias("license"), F.col("hi.cosine").alias("cosine"))


def folder_of(path: Column) -> Column:
    """The folder of a path; the top folder is the empty one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def scan(files: DataFrame, known: DataFrame, path_col: str = "path", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """``(path, license, cosine, origin)`` per distinct path.

    ``origin`` is ``own`` for a file with a licence line (of several, the closest, then the first), ``folder`` for
    one that inherits from the nearest folder that has a licence file with one, its own folder included; without
    either the licence is null.  Rows of one path are one file; a null path is no file and gets nulls.  Null and empty
    texts have no lines.
    """
    found = stored(statements(files, known, path_col, text_col, least), "statements")
    first = F.min(F.struct((-F.col("cosine")).alias("c"), "line", "license")).alias("s")
    own = found.groupBy("path").agg(first).select("path", F.col("s.license").alias("license"), (-F.col("s.c")).alias("cosine"))
    own = stored(own, "own-licenses")
    of_folder = (
        own.where(F.lower(name_of(F.col("path"))).rlike(LICENSE_FILE))
        .groupBy(folder_of(F.col("path")).alias("folder"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "path")).alias("s"))
        .select("folder", F.col("s.license").alias("inherited"), (-F.col("s.c")).alias("its_cosine"))
    )
    paths = files.select(F.col(path_col).alias("path")).distinct()
    folders = paths.select(folder_of(F.col("path")).alias("of")).where("of is not null").distinct()
    # Each folder meets those above it once, however many files it has.
    parts = F.split("of", "/")
    above = folders.select(
        "of",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"),
    ).distinct()
    nearest = above.join(of_folder, "folder").groupBy("of").agg(
        F.max(F.struct(F.length("folder").alias("n"), "inherited", "its_cosine")).alias("s")
    )
    met = (
        paths.withColumn("of", folder_of(F.col("path")))
        .join(own.withColumnRenamed("path", "p"), F.col("path").eqNullSafe(F.col("p")), "left")
        .join(nearest, "of", "left")
    )
    return met.select(
        "path",
        F.coalesce("license", "s.inherited").alias("license"),
        F.coalesce("cosine", "s.its_cosine").alias("cosine"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("s").isNotNull(), "folder").alias("origin"),
    )
