"""License scan of a tree of files, in DataFrame operations only.

Lines that hold an anchor word are candidates. Distinct candidates and the lines of the
license templates form a collection; a line is a sparse TF-IDF vector over it, and its
cosine to each template line is a join on shared terms. A file declares the license of its
best line. A directory has the license of its best license file, and a file that declares
nothing inherits from the nearest directory above that has one: the distinct directories
are unfolded into their prefixes and joined with the licensed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import stored

# Usual notice lines by license.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to deal in the Software without restriction under the MIT license"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright, all rights reserved, no part may be reproduced without permission"),
)
ANCHORS = r"(?i)licen[sc]e|copyright|all rights reserved|public domain|released under|spdx"
TERMS = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_NAMES = r"(?i)^(licen[sc]e|copying|notice|unlicense)(\.\w+)?$"


def _templates(spark: SparkSession, templates) -> DataFrame:
    quoted = [", ".join("'" + v.replace("'", "\\'") + "'" for v in t) for t in templates]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({q})" for q in quoted) + " AS t(license, line)")


def _terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERMS), F.lit(0))


def match_lines(lines: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """(line, license, score) of the distinct ``lines`` whose best cosine reaches the threshold."""
    every = stored(lines.select("line").union(templates.select("line")).distinct(), "lines")
    counts = every.select("line", F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "term").agg(F.count("*").alias("tf"))
    total = every.select(F.count("*")).scalar()
    seen = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = seen.select("term", (F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    weights = counts.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    aims = templates.join(weights, "line").join(norms, "line").select("license", F.col("line").alias("template"), "term", F.col("w").alias("tw"), F.col("norm").alias("tn"))
    found = weights.join(aims, "term").groupBy("line", "license", "template", "tn").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = found.join(norms, "line").select("line", "license", F.round(F.col("dot") / (F.col("tn") * F.col("norm")), 6).alias("score"))
    scored = scored.filter(F.col("score") >= threshold).join(lines.select("line").distinct(), "line", "left_semi")
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    return best.select("line", "best.license", (-F.col("best.s")).alias("score"))


def scan(files: DataFrame, threshold: float = 0.6, licence_file: Column | None = None, templates=TEMPLATES) -> DataFrame:
    """(directory, name, declared, score, license, origin, from_directory), one row per row of ``files``.

    ``files`` has directory ("/a/b"), name and text. ``licence_file`` says which files
    speak for their directory; by default those whose name is one of the usual ones.
    origin is "file", "directory" or "none". Rows that agree in directory and name are one
    file, whose lines are those of all of them. A null text declares nothing; null
    directories and names stand for an empty one; an empty table gives no rows. Other
    columns are not read.
    """
    speaks = F.col("name").rlike(LICENSE_NAMES) if licence_file is None else licence_file
    own = files.withColumns({"directory": F.coalesce("directory", F.lit("")), "name": F.coalesce("name", F.lit(""))})
    candidates = own.select("directory", "name", F.coalesce(speaks, F.lit(False)).alias("speaks"), F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(ANCHORS))
    candidates = stored(candidates, "candidates")  # the texts are read once
    best = match_lines(candidates.select("line").distinct(), _templates(files.sparkSession, templates), threshold)
    pick = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")
    declared = candidates.join(best, "line").groupBy("directory", "name").agg(pick, F.max("speaks").alias("speaks"))
    declared = declared.select("directory", "name", "speaks", F.col("best.license").alias("declared"), (-F.col("best.s")).alias("score"))
    licensed = declared.filter("speaks").groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("name"), F.col("declared"))).alias("d"))
    licensed = licensed.select(F.col("directory").alias("above"), F.col("d.declared").alias("inherited"))

    parts = F.split("directory", "/")
    prefixes = own.select("directory").distinct().select("directory", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("depth", "above"))
    nearest = prefixes.join(licensed, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "inherited")).alias("n"))
    nearest = nearest.select("directory", F.col("n.above").alias("above"), F.col("n.inherited").alias("inherited"))
    out = own.select("directory", "name").join(declared.drop("speaks"), ["directory", "name"], "left").join(nearest, "directory", "left")
    origin = F.when(F.col("declared").isNotNull(), "file").when(F.col("inherited").isNotNull(), "directory").otherwise("none")
    return out.select(
        "directory", "name", "declared", "score", F.coalesce("declared", "inherited").alias("license"), origin.alias("origin"),
        F.when(origin == "directory", F.col("above")).alias("from_directory"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: /source/lang/ and a level per digit of doc_id div 1000, named by doc_id."""
    far = F.abs(F.col("doc_id")) >= 1000
    levels = F.when(far, F.regexp_replace(F.floor(F.abs(F.col("doc_id")) / 1000).cast("string"), "(.)", "/$1")).otherwise("")
    place = F.concat(F.lit("/"), F.coalesce("source", F.lit("~")), F.lit("/"), F.coalesce("lang", F.lit("~")), levels)
    return docs.select(place.alias("directory"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("string").alias("text"))


#: A document of at most this many characters that declares a license speaks for its directory.
SHORT = 600


def scan_documents(docs: DataFrame) -> DataFrame:
    found = scan(as_files(docs), licence_file=F.length("text") <= SHORT)
    return found.select(F.when(F.col("name") != "", F.col("name")).cast("long").alias("doc_id"), "directory", "declared", "score", "license", "origin", "from_directory")


_VALUES = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in t) + ")" for t in TEMPLATES)
SQL = rf"""
WITH templates(license, line) AS (VALUES {_VALUES}),
files AS (
  SELECT '/' || coalesce(source, '~') || '/' || coalesce(lang, '~') ||
    CASE WHEN abs(doc_id) >= 1000 THEN regexp_replace(CAST(abs(doc_id) // 1000 AS VARCHAR), '(.)', '/\1', 'g') ELSE '' END AS directory,
    coalesce(CAST(doc_id AS VARCHAR), '') AS name, text FROM documents),
candidates AS (
  SELECT * FROM (SELECT directory, name, length(text) <= {SHORT} AS speaks, unnest(string_split(text, chr(10))) AS line FROM files)
  WHERE regexp_matches(line, '{ANCHORS}')),
collection AS (SELECT line FROM candidates UNION SELECT line FROM templates),
counts AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{TERMS}')) AS term FROM collection) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM collection) + 1.0::DOUBLE) / (count(*) + 1.0::DOUBLE)) + 1.0 AS idf FROM counts GROUP BY term),
weights AS (SELECT line, term, tf * idf AS w FROM counts JOIN idf USING (term)),
norms AS (SELECT line, sqrt(sum(w * w)) AS norm FROM weights GROUP BY line),
aims AS (SELECT license, line AS template, term, w AS tw, norm AS tn FROM templates JOIN weights USING (line) JOIN norms USING (line)),
scored AS (
  SELECT f.line, license, round(dot / (tn * norm), 6) AS score
  FROM (SELECT line, license, template, tn, sum(w * tw) AS dot FROM weights JOIN aims USING (term) GROUP BY ALL) f JOIN norms n ON f.line = n.line),
best AS (SELECT line, license, score FROM scored WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
declared AS (
  SELECT directory, name, first(license ORDER BY score DESC, license) AS declared, max(score) AS score, bool_or(speaks) AS speaks
  FROM candidates JOIN best USING (line) GROUP BY directory, name),
licensed AS (SELECT directory AS above, first(declared ORDER BY score DESC, name) AS inherited FROM declared WHERE speaks GROUP BY directory),
prefixes AS (
  SELECT directory, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) AS above
  FROM (SELECT directory, string_split(directory, '/') AS parts FROM (SELECT DISTINCT directory FROM files))),
nearest AS (SELECT directory, above, inherited FROM prefixes JOIN licensed USING (above) QUALIFY row_number() OVER (PARTITION BY directory ORDER BY length(above) DESC) = 1)
SELECT CAST(nullif(f.name, '') AS BIGINT) AS doc_id, f.directory, declared, score, coalesce(declared, inherited) AS license,
  CASE WHEN declared IS NOT NULL THEN 'file' WHEN inherited IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CASE WHEN declared IS NULL AND inherited IS NOT NULL THEN above END AS from_directory
FROM files f LEFT JOIN declared d ON f.directory = d.directory AND f.name = d.name LEFT JOIN nearest n ON f.directory = n.directory
"""
