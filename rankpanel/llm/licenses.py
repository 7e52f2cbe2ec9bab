"""Scan texts for licences and let directories pass them on.

Units of text are the lines of a document (headers) and, for documents that
hold a licence-like line, the whole text (licence files). A unit is compared
with every template by the cosine of sparse TF-IDF vectors. Document frequencies
of the templates' terms are counted over all documents; a term outside the
templates' vocabulary has frequency 0. A line is scored only if it holds one of
the terms without which no template can reach ``least``: in every template the
terms of least weight whose weights alone stay below the threshold are dispensable.

A document without a licence of its own takes the one of the nearest ancestor
directory that has one. A directory has the licence that most of its licence
files (or, where it has none, of its documents with a header) declare.

Rows: one per input row. Null and empty texts declare nothing; a null path has
no directory; equal scores go to the smaller template name, equally frequent
licences of a directory to the smaller name; repeated rows each count; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpanel.llm.tables import row_key
from rankpanel.session import materialize

LEAST, FILE_LEAST = 0.6, 0.6
#: Licence notices by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated this work to the public domain, CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is free software under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
}
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def terms_of(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and rows that hold each term; one row per term of the vocabulary reaches the driver."""
    held = F.array_intersect(_terms(F.coalesce("text", F.lit(""))), F.array(*[F.lit(t) for t in vocabulary]))
    rows = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("term")).groupBy("term").count().collect()
    counts = {r["term"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def weights(templates: Mapping[str, str], n: int, df: Mapping[str, int]) -> tuple[dict[str, float], float]:
    """Smoothed inverse document frequencies of the templates' terms, and that of any other term."""
    vocabulary = sorted({t for text in templates.values() for t in terms_of(text)})
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}, math.log(1 + n) + 1


def needed_terms(templates: Mapping[str, str], idf: Mapping[str, float], least: float) -> list[str]:
    """Terms of which a unit must hold one to reach ``least`` with any template."""
    needed: set[str] = set()
    for text in templates.values():
        tf = terms_of(text)
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in tf.items()))
        spare = 0.0
        for t in sorted(tf, key=lambda t: (tf[t] * idf[t], t)):
            spare += (tf[t] * idf[t] / norm) ** 2
            if math.sqrt(spare) >= least:
                needed.add(t)
    return sorted(needed)


def declared(docs: DataFrame, row: str, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST, file_least: float = FILE_LEAST) -> DataFrame:
    """(row, license, score, is_file) of the documents that declare a licence."""
    spark = docs.sparkSession
    texts = docs.select(F.col(row).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({t for text in templates.values() for t in terms_of(text)})
    n, df = document_frequencies(texts, vocabulary)
    idf, other = weights(templates, n, df)
    needed = "|".join(re.escape(t) for t in needed_terms(templates, idf, least))
    hint = rf"(?i)(?<![a-z0-9])(?:{needed})(?![a-z0-9])"
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(hint))
    units = texts.where(F.col("text").rlike(hint)).select(
        "_row", F.posexplode(F.array_append(lines, F.col("text"))).alias("_n", "_unit"), F.size(lines).alias("_lines")
    )
    units = units.select("_row", (F.col("_n") == F.col("_lines")).alias("_whole"), F.col("_n").alias("_n"), _terms("_unit").alias("_terms"))
    vectors = []
    for name, text in templates.items():
        tf = terms_of(text)
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in tf.items()))
        vectors += [(name, t, k * idf[t] ** 2 / norm) for t, k in tf.items()]
    parts = spark.createDataFrame(vectors, "license string, _term string, _part double")
    rates = spark.createDataFrame(list(idf.items()), "_t string, _idf double")
    bag = units.select("_row", "_whole", "_n", F.explode("_terms").alias("term")).groupBy("_row", "_whole", "_n", "term").agg(F.count(F.lit(1)).alias("tf"))
    bag = materialize(bag.join(F.broadcast(rates), F.col("term") == F.col("_t"), "left").withColumn("_w", F.col("tf") * F.coalesce("_idf", F.lit(other))), "terms")
    unit = ["_row", "_whole", "_n"]
    norms = bag.groupBy(*[F.col(c).alias(f"{c}_") for c in unit]).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    dots = bag.join(F.broadcast(parts), F.col("term") == F.col("_term")).groupBy(*unit, "license").agg(F.sum(F.col("tf") * F.col("_part")).alias("_dot"))
    same = (F.col("_row") == F.col("_row_")) & (F.col("_whole") == F.col("_whole_")) & (F.col("_n") == F.col("_n_"))
    scored = dots.join(norms, same).select("_row", "_whole", "license", F.round(F.col("_dot") / F.col("_norm"), 6).alias("score"))
    good = scored.where(F.when(F.col("_whole"), F.col("score") >= file_least).otherwise(F.col("score") >= least))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("license"))).alias("best")
    return good.groupBy("_row").agg(best, F.max("_whole").alias("is_file")).select(
        F.col("_row").alias(row), F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"), "is_file"
    )


def scan(docs: DataFrame, path: str, key: str = "doc_id", templates: Mapping[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Per row: key, own license and score, is_file, the directory it inherits from and the license in force."""
    docs, row = row_key(docs, key)
    own = materialize(declared(docs, row, templates, least), "declared")
    own = own.select(F.col(row).alias("_own"), "license", "score", "is_file")
    folder = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    placed = docs.select(F.col(row).alias("_row"), F.col(key).alias("_key"), F.when(F.col(path).isNotNull(), folder).alias("_folder"))
    placed = materialize(placed.join(own, F.col("_row") == F.col("_own"), "left").drop("_own"), "placed")
    votes = placed.where("license is not null and _folder is not null").groupBy(F.col("_folder").alias("_from"), "is_file", "license").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((~F.col("is_file")).alias("f"), (-F.col("n")).alias("n"), F.col("license").alias("license"))
    by_folder = votes.groupBy("_from").agg(F.min(order).alias("best")).select("_from", F.col("best.license").alias("_inherited"))
    names = F.split("_folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/"))
    folders = placed.where("_folder is not null").select("_folder").distinct()
    chain = folders.select("_folder", F.posexplode(up).alias("_depth", "_up"))
    near = F.max(F.struct("_depth", "_from", "_inherited")).alias("near")
    nearest = chain.join(by_folder, F.col("_up") == F.col("_from")).groupBy(F.col("_folder").alias("_f")).agg(near)
    out = placed.join(nearest, F.col("_folder") == F.col("_f"), "left")
    taken = F.col("license").isNull()
    return out.select(
        F.col("_key").alias(key), "license", "score", F.coalesce("is_file", F.lit(False)).alias("is_file"),
        F.when(taken, F.col("near._from")).alias("inherited_from"), F.coalesce("license", "near._inherited").alias("license_in_force"),
    )
