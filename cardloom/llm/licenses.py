"""License scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance along directories.

Texts are cut into passages at the ends of sentences and lines, and where a template's opening words begin; passages
with a template's key term are compared with all templates, each distinct passage once. The whole text of a likely licence
file (by its name, or as it holds a phrase of a licence's body) is compared with the bodies of licences. Document frequencies are counted
over all texts, for the terms of the templates; any other term counts as the rarest. A file is a licence file by its name
or because licence passages make up most of its text; its licence holds for the files below its directory that have none
of their own, the nearest directory first. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import small, stored, table

THRESHOLD = 0.7
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([._-][^/]*)?$"
#: Share of a text that licence passages make up if it is a licence file.
MOSTLY = 0.5
TERM = r"[^\p{L}\p{N}.\-]+"

#: (licence, key term, text): what headers usually say.
TEMPLATES = (
    ("MIT", "license", "Released under the MIT License."),
    ("MIT", "license", "Licensed under the MIT License."),
    ("Apache-2.0", "license", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "license", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "license", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "license", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "license", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "license", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "licensed", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "licensed", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "licensed", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "public", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "reserved", "All rights reserved."),
)

#: Won by any other licence over the threshold.
GENERIC = "proprietary"
#: A phrase by which a text may be the whole licence; the bodies are in licence_texts.
BODIES = {
    "MIT": "permission is hereby granted, free of charge",
    "ISC": "permission to use, copy, modify",
    "BSD-2-Clause": "redistribution and use in source and binary forms",
    "BSD-3-Clause": "redistribution and use in source and binary forms",
    "Apache-2.0": "terms and conditions for use, reproduction, and distribution",
    "GPL-2.0": "copy and distribute verbatim copies",
    "GPL-3.0": "copy and distribute verbatim copies",
    "LGPL-2.1": "copy and distribute verbatim copies",
    "LGPL-3.0": "copy and distribute verbatim copies",
    "MPL-2.0": "covered software",
    "CC0-1.0": "affirmer",
}


def licence_bodies(spark: SparkSession) -> DataFrame:
    """(license, key, text) of the licences whose whole texts are known."""
    folder = Path(__file__).with_name("licence_texts")
    return spark.createDataFrame([(n, k, (folder / f"{n}.txt").read_text("utf-8")) for n, k in BODIES.items()], "license string, key string, text string")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits, dots and hyphens, without dots and hyphens at their ends."""
    pieces = F.transform(F.split(F.lower(text), TERM), lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
    return F.filter(pieces, lambda t: t != "")


def _openings(templates: DataFrame) -> tuple[str, str, list[str]]:
    """Patterns for where passages begin and for key terms, and the templates' terms. Templates are the caller's list."""
    rows = templates.collect()
    first = sorted({r"\s+".join(re.escape(w) for w in r["text"].split()[:2]) for r in rows})
    keys = sorted({re.escape(r["key"].lower()) for r in rows})
    vocabulary = {t for r in templates.select(F.explode(terms(F.col("text"))).alias("t")).distinct().collect() for t in r}
    return rf"(?<=[.!?;])\s+|\n+|\s+(?=(?i:{'|'.join(first)}))", rf"(?i){'|'.join(keys)}", sorted(vocabulary)


def scan_licenses(files: DataFrame, templates: DataFrame, id_col: str, path_col: str, text_col: str, threshold: float = THRESHOLD, bodies: DataFrame | None = None) -> DataFrame:
    """(id, path, license, score, origin, licence_path) for each row of `files`.

    origin is `file` or `header` if the row's own text names the licence (the best cosine, of equal ones the first by
    name; `proprietary` only if no other is over the threshold), `inherited` if a licence file in its directory or the nearest one above does, else `none`. Null and empty texts
    have no licence of their own; a null path has no directory. Repeated rows get equal results; other columns are left
    out. templates and bodies are (license, key, text), lists small enough for the driver; bodies are the library's unless given.
    """
    spark = files.sparkSession
    bodies = licence_bodies(spark) if bodies is None else bodies
    begin, key, vocabulary = _openings(templates)
    _, _, more = _openings(bodies)
    vocabulary = sorted({*vocabulary, *more})
    body_key = "(?i)" + "|".join(sorted({r"\s+".join(map(re.escape, r["key"].split())) for r in bodies.collect()}))
    templates = templates.withColumn("body", F.lit(False)).unionByName(bodies.withColumn("body", F.lit(True)))
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    row = [F.xxhash64(F.lit(n), "id", "path", "text") for n in (1, 2)]
    rows = rows.withColumns({"row1": row[0], "row2": row[1]})

    # Document frequencies of the templates' terms, over all texts.
    words_ = F.array(*[F.lit(w) for w in vocabulary])
    found = rows.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(terms(F.coalesce("text", F.lit(""))), words_))).alias("term"))
    counts = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()}  # as many rows as terms
    total = counts.get("", 0)
    rarest = math.log(1 + total) + 1
    idf = spark.createDataFrame([(w, math.log((1 + total) / (1 + counts.get(w, 0))) + 1) for w in vocabulary], "term string, idf double")

    vectors = templates.select("license", "body", F.md5(F.concat_ws("|", F.col("body").cast("string"), "license", "text")).alias("template"), F.explode(terms(F.col("text"))).alias("term"))
    vectors = vectors.groupBy("license", "body", "template", "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    lengths = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    vectors = small(stored(vectors.join(lengths, "template").select("license", "body", "template", "term", (F.col("weight") / F.col("length")).alias("unit"))))

    passages = rows.where(F.col("text").rlike(key)).select("row1", "row2", F.length("text").alias("whole"), F.posexplode(F.split("text", begin)).alias("pos", "passage"))
    passages = passages.where(F.col("passage").rlike(key)).select("row1", "row2", "whole", "pos", F.length("passage").alias("size"), F.lower("passage").alias("passage"), F.lit(False).alias("body"))
    by_name = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    likely = rows.where((F.col("text") != "") & (by_name | F.col("text").rlike(body_key)))
    likely = likely.select("row1", "row2", F.length("text").alias("whole"), F.lit(-1).alias("pos"), F.length("text").alias("size"), F.lower("text").alias("passage"), F.lit(True).alias("body"))
    passages = passages.unionByName(likely).withColumn("mark", F.md5(F.concat(F.col("body").cast("string"), "passage")))
    distinct = passages.groupBy("mark", "body").agg(F.first("passage").alias("passage"))
    counted = distinct.select("mark", "body", F.explode(terms(F.col("passage"))).alias("term")).groupBy("mark", "body", "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(rarest)))
    matched = weighed.where("idf is not null").join(vectors, ["term", "body"]).groupBy("mark", "license", "template").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    size = weighed.groupBy("mark").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("length"))
    near = matched.join(size, "mark").withColumn("score", F.round(F.least(F.col("dot") / F.col("length"), F.lit(1.0)), 9)).where(F.col("score") >= threshold)
    best = near.groupBy("mark").agg(F.min(F.struct((F.col("license") == GENERIC).alias("generic"), (-F.col("score")).alias("back"), "license")).alias("b"))

    # Equal rows bring each passage as often as there are copies; the share is of one of them.
    copies = F.count("*") / F.size(F.collect_set("pos"))
    own = passages.join(best, "mark").groupBy("row1", "row2").agg(F.min("b").alias("b"), (F.sum("size") / copies / F.first("whole")).alias("share"))
    own = stored(own.select("row1", "row2", F.col("b.license").alias("license"), (-F.col("b.back")).alias("score"), "share"))
    judged = rows.select("id", "path", "row1", "row2").join(own, ["row1", "row2"], "left")
    judged = judged.withColumn("is_file", F.col("license").isNotNull() & (by_name | (F.col("share") >= MOSTLY)))
    judged = stored(judged.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")).drop("row1", "row2", "share"))

    rules = judged.where("is_file and dir is not null").groupBy(F.col("dir").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("back"), "path", "license")).alias("r"))
    lacking = judged.where("license is null and dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.concat_ws("/", F.slice(steps, F.lit(1), n)))
    above = lacking.select("dir", F.explode(F.array_distinct(ancestors)).alias("at"))
    nearest = above.join(rules, "at").groupBy("dir").agg(F.max_by("r", F.length("at")).alias("r"))
    out = judged.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "id", "path",
        F.coalesce("license", "r.license").alias("license"),
        F.when(has, F.col("score")).otherwise(-F.col("r.back")).alias("score"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("r").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("r.path")).alias("licence_path"),
    )


def op1_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, whose paths are source/language/id."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
    templates = spark.createDataFrame(TEMPLATES, "license string, key string, text string")
    return scan_licenses(docs, templates, "doc_id", "path", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"op1_license_tfidf": op1_license_tfidf}
ORACLES: dict[str, str] = {}
