"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line, or a run of lines between blank ones, so that a wrapped notice is one
paragraph.  Comment marks at the ends of lines are left out, and a line of marks only is blank.
A run of several lines is reported, at its first line, if a family stands for it that stands for
none of its lines; its lines that would be ``unknown`` are then parts of it and not reported.  A
run is one notice at most: of two notices wrapped without a blank line between them one is named.
The features of a paragraph are the word bigrams and trigrams that occur in the licence
templates.  A multinomial logistic regression (Spark ML) over those sparse counts names the
licence family or ``unknown``; it is trained on variants of the templates and on a bounded
sample of lines of the corpus, and its probabilities are calibrated by a temperature fitted on
variants that were left out.  A predicted family stands if its calibrated probability reaches
MIN_PROBABILITY and the paragraph holds MIN_OVERLAP of the features of one of the family's
templates; else a paragraph that was predicted as a licence is reported as ``unknown``.

Only DataFrame functions run over the corpus (Spark ML trains).  A paragraph without any
template feature has the score of an empty one, which training labels unknown, and goes no
further than its row.

Defined results: a null text has no paragraphs; repeated rows report their paragraphs each; extra
columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricesieve.llm.common import staged
from pricesieve.llm.line_quality import let, words_of

UNKNOWN = "unknown"
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.6
#: White space and comment marks, left out before and after the words of a line.
MARKS_BEFORE = " \t\x0b\x0c\r/*#;%>|<!-"
MARKS_AFTER = " \t\x0b\x0c\r/*#|>"
#: Marks that are no part of a word at its ends.
MARKS = ".,;:!?()\"'"
#: Documents of the corpus (those of least hash) whose lines train the unknown class, and the number
#: of lines taken from them (those of least hash).
TRAIN_DOCS = 2000
TRAIN_LINES = 2000
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)

#: Short notices of common licences.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "Licensed under the GPL version 2 only."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0."),
    ("all-rights-reserved", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."),
]
FAMILIES = sorted({f for f, _ in TEMPLATES})


def normal_words(paragraph: str) -> list[str]:
    """Words in lower case without marks at their ends; used for templates, as ``_words`` is for
    columns."""
    return [w for w in (x.strip(MARKS) for x in paragraph.lower().split()) if w]


def _words(paragraph: Column) -> Column:
    return F.filter(F.transform(words_of(F.lower(paragraph)), lambda w: F.btrim(w, F.lit(MARKS))), lambda w: w != "")


def ngrams(words: list[str]) -> list[str]:
    """Distinct bigrams and trigrams."""
    return list(dict.fromkeys(" ".join(words[i:i + n]) for n in (2, 3) for i in range(len(words) - n + 1)))


def features(paragraph: Column) -> Column:
    """Distinct template features of a paragraph.  Only where two words of the templates stand side
    by side are n-grams formed, so everyday text costs two set look-ups a word."""
    known = vocabulary()
    words = sorted({w for g in known for w in g.split(" ")})

    def of(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 2),
                      lambda i: F.get(w, i).isin(words) & F.get(w, i + 1).isin(words))
        # past the end a trigram is its bigram once more
        grams = let(at, lambda p: F.concat(
            F.transform(p, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))),
            F.transform(p, lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
        return F.when(F.size(w) > 1, F.array_distinct(F.filter(grams, lambda g: g.isin(known)))).otherwise(
            F.array().cast("array<string>"))

    return let(_words(paragraph), of)


def vocabulary() -> list[str]:
    return sorted({g for _, text in TEMPLATES for g in ngrams(normal_words(text))})


def _variants(text: str) -> list[list[str]]:
    """Word lists of a template: whole, and with each word in turn left out."""
    words = normal_words(text)
    return [words, *(words[:i] + words[i + 1:] for i in range(len(words)))]


def _training_lines(docs: DataFrame) -> DataFrame:
    """(grams) of at most TRAIN_LINES distinct lines of about TRAIN_DOCS documents.  A line is whole,
    but only its template features, of which there are a fixed number, go on to the driver."""
    h = F.xxhash64("doc_id", "text")
    last = docs.select(h.alias("h")).orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    some = staged(docs.where(h <= F.lit(last)).select("text").distinct(), "license_training")
    lines = some.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    lines = lines.select(F.xxhash64("line").alias("h"), features(F.col("line")).alias("grams"))
    return staged(lines.groupBy("h").agg(F.first("grams").alias("grams")).orderBy("h").limit(TRAIN_LINES), "license_lines")


def train(spark: SparkSession, docs: DataFrame) -> dict:
    """Weights by feature and class, intercepts, class names and the temperature."""
    index = {g: i for i, g in enumerate(vocabulary())}
    classes = [UNKNOWN, *FAMILIES]

    def row(grams, family):
        return (SparseVector(len(index), sorted((index[g], 1.0) for g in set(grams) if g in index)), float(classes.index(family)))

    rows, left_out = [], []
    for family, text in TEMPLATES:
        for k, words in enumerate(_variants(text)):
            (left_out if k % 5 == 4 else rows).append(row(ngrams(words), family))
    for k, grams in enumerate(sorted(sorted(r.grams) for r in _training_lines(docs).collect())):
        if not any(set(ngrams(normal_words(t))) <= set(grams) for _, t in TEMPLATES):
            (left_out if k % 5 == 4 else rows).append(row(grams, UNKNOWN))
    rows += [row([], UNKNOWN)] * (1 + len(rows) // 4)
    # no paragraph may be named for one or two everyday features
    rows += [row([g], UNKNOWN) for g in index]
    frame = spark.createDataFrame(rows, ["features", "label"])
    model = LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial", standardization=False).fit(frame)
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def loss(t: float) -> float:
        total = 0.0
        for x, y in left_out:
            z = [(b + sum(w[i] for i in x.indices)) / t for w, b in zip(matrix, bias)]
            top = max(z)
            total += top + math.log(sum(math.exp(v - top) for v in z)) - z[int(y)]
        return total

    return {"classes": [classes[i] for i in range(len(bias))], "bias": bias.tolist(), "temperature": min(TEMPERATURES, key=loss),
            "weights": [(g, [float(w[i]) for w in matrix]) for g, i in index.items()]}


def _runs(text: Column) -> Column:
    """Runs of non-blank lines, without comment marks: the number of the first and the lines."""
    def of(lines: Column) -> Column:
        def line(i: Column) -> Column:
            return F.coalesce(F.get(lines, i), F.lit(""))

        at = F.sequence(F.lit(0), F.size(lines) - 1)
        first = F.filter(at, lambda i: (line(i) != "") & (line(i - 1) == ""))
        last = F.filter(at, lambda i: (line(i) != "") & (line(i + 1) == ""))
        return F.zip_with(first, last, lambda i, j: F.struct(i.alias("at"), F.slice(lines, i + 1, j - i + 1).alias("lines")))

    return let(F.transform(F.split(text, "\n"), lambda x: F.rtrim(F.ltrim(x, F.lit(MARKS_BEFORE)), F.lit(MARKS_AFTER))), of)


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, paragraph, family, predicted, probability, template, overlap): every paragraph
    predicted as a licence.  paragraph is its first line, from 0; template numbers TEMPLATES."""
    spark = docs.sparkSession

    def joined(lines: Column) -> Column:
        # a word cut behind its hyphen is whole again
        return F.array_join(F.transform(lines, lambda x: F.when(x.endswith("-"), x).otherwise(F.concat(x, F.lit(" ")))), "")

    # the features of every run; only runs that have one go on, and only their lines are looked at
    found = F.filter(F.transform(_runs(F.coalesce("text", F.lit(""))), lambda r: F.struct(
        r["at"].alias("run"), r["lines"].alias("lines"), features(joined(r["lines"])).alias("grams"))),
        lambda r: F.size(r["grams"]) > 0)
    runs = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.explode(found).alias("r")).select("doc_id", "_row", "r.*")
    several = F.size("lines") > 1

    def unit(at: Column, whole: Column, grams: Column) -> Column:
        return F.struct(at.alias("paragraph"), whole.alias("whole"), grams.alias("grams"))

    units = F.concat(F.array(unit(F.col("run"), several, F.col("grams"))), F.when(several, F.transform(
        "lines", lambda x, i: unit(F.col("run") + i, F.lit(False), features(x)))).otherwise(F.array()))
    rows = runs.select("doc_id", "_row", "run", F.explode(units).alias("u")).select("doc_id", "_row", "run", "u.*").where(F.size("grams") > 0)
    key = ["doc_id", "_row", "run", "paragraph", "whole"]
    # bounded: one row per template feature
    weights = F.broadcast(spark.createDataFrame(model["weights"], "gram string, w array<double>"))
    k = len(model["bias"])
    hits = rows.select(*key, "grams", F.explode("grams").alias("gram")).join(weights, "gram")
    scored = hits.groupBy(*key, "grams").agg(*(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)))
    z = F.array(*((F.col(f"z{i}") + model["bias"][i]) / model["temperature"] for i in range(k)))
    scored = scored.select(*key, "grams", z.alias("z"))
    names = F.array(*(F.lit(c) for c in model["classes"]))
    top = F.array_max("z")
    scored = scored.select(*key, "grams", F.get(names, F.array_position("z", top).cast("int") - 1).alias("predicted"),
                           (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("probability"))
    templates = spark.createDataFrame([(f, i, ngrams(normal_words(t))) for i, (f, t) in enumerate(TEMPLATES)],
                                      "predicted string, template int, features array<string>")
    compared = scored.where(F.col("predicted") != UNKNOWN).join(F.broadcast(templates), "predicted")
    compared = compared.withColumn("overlap", F.size(F.array_intersect("features", "grams")) / F.size("features"))
    best = compared.groupBy(*key, "predicted", "probability").agg(
        F.max(F.struct("overlap", (-F.col("template")).alias("t"))).alias("b"))
    sure = (F.col("probability") >= MIN_PROBABILITY) & (F.col("b.overlap") >= MIN_OVERLAP)
    best = best.withColumn("family", F.when(sure, F.col("predicted")).otherwise(UNKNOWN))
    of_run, stands = Window.partitionBy("_row", "run"), F.col("family") != UNKNOWN
    best = best.withColumn("_lines", F.collect_set(F.when(stands & ~F.col("whole"), F.col("family"))).over(of_run))
    best = best.withColumn("_whole", F.max(stands & F.col("whole") & ~F.array_contains("_lines", F.col("family"))).over(of_run))
    best = best.where(F.when(F.col("whole"), F.col("_whole")).otherwise(stands | ~F.col("_whole")))
    return best.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"),
                       "family", "predicted",
                       F.round("probability", 6).alias("probability"), (-F.col("b.t")).cast("long").alias("template"),
                       F.round("b.overlap", 6).alias("overlap"))


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """Licence paragraphs of all documents."""
    docs = docs.select("doc_id", "text")
    return scan(docs, train(docs.sparkSession, docs))
