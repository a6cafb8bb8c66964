"""Licence scan: a trained paragraph classifier, confirmed by the templates.

Paragraphs are lines with a word.  Their features are the word 2- and 3-grams that occur in
the templates of licence notices, so a paragraph's vector is sparse and mostly empty.  A
multinomial logistic regression with an elastic net is trained on varied templates and
on paragraphs of the corpus as the class ``unknown``.  Part of both is kept for
calibration: a temperature for the probabilities, and the probability a family must reach
for all but a small share of the unknown ones to stay unknown.  A prediction counts if
the paragraph also shares enough n-grams with a template of that family.

Training and scoring are DataFrame operations.  Scoring is one pass over the texts without a
shuffle; the model is a few hundred weights in the plan.

Defined results: a null or empty text has no paragraphs; a paragraph with fewer words than
an n-gram is unknown; repeated rows are each reported; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from payrecheck.llm.lines import has_word
from payrecheck.operators.once import compute_once
from payrecheck.session import stage

UNKNOWN = "unknown"

#: Opening or short notices of public licences, by family; an argument of ``train``.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "CC0": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, "
        "or transmitted in any form without the prior written permission of the publisher.",
    ),
}


@dataclass(frozen=True)
class LicenceRule:
    """``variants``: of each template; ``unknown``: paragraphs of the corpus to train on, about.

    ``false_share``: unknown paragraphs of the calibration part that may pass;
    ``similarity``: shared n-grams of paragraph and template, as a share of the lesser set.
    """

    variants: int = 40
    unknown: int = 4000
    false_share: float = 0.005
    similarity: float = 0.5
    regularisation: float = 0.002
    elastic: float = 0.9


@dataclass(frozen=True)
class LicenceModel:
    families: list[str]
    grams: list[str]
    #: One row a gram, one column a family; ``unknown`` is the last.
    weights: list[list[float]]
    bias: list[float]
    temperature: float
    threshold: float
    templates: dict[str, tuple[str, ...]]


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _grams(words: Column) -> Column:
    """The distinct 2- and 3-grams of an array of words."""

    def of(w: Column) -> Column:
        two = F.transform(
            F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))
        )
        three = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        return (
            F.when(F.size(w) > 2, F.array_distinct(F.concat(two, three)))
            .when(F.size(w) == 2, two)
            .otherwise(F.array().cast("array<string>"))
        )

    return F.element_at(F.transform(F.array(words), of), 1)


def _template_grams(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(f, t) for f, texts in templates.items() for t in texts]
    return spark.createDataFrame(rows, "family string, text string").withColumn(
        "grams", _grams(_words(F.col("text")))
    )


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its line in the text), text."""
    return docs.select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text")
    ).filter(has_word(F.col("text")))


def _likeness(grams: Column, templates: list[list[str]]) -> Column:
    """The best share of n-grams in common with any of the templates."""
    each = [
        F.size(F.array_intersect(grams, _literal(t))) / F.least(F.size(grams), F.lit(len(t)))
        for t in templates
        if t
    ]
    best = each[0] if len(each) == 1 else F.greatest(*each)
    return F.when(F.size(grams) > 0, best).otherwise(0.0)


def train(
    docs: DataFrame,
    rule: LicenceRule = LicenceRule(),
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
) -> LicenceModel:
    """Learn the families of ``templates`` against paragraphs of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    families = [*sorted(templates), UNKNOWN]
    known = _template_grams(spark, templates)
    rows = known.select("family", "grams").collect()
    grams = sorted({g for r in rows for g in r.grams})
    all_grams = [r.grams for r in rows]

    # Variants lose up to a third of their words, by a hash of word, place and variant.
    loses = lambda i: F.pmod(F.xxhash64("text", "variant", i), F.lit(100)) < F.pmod(
        F.col("variant"), F.lit(4)
    ) * 11
    varied = (
        known.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(rule.variants - 1))))
        .withColumn("grams", _grams(F.filter(_words(F.col("text")), lambda w, i: ~loses(i))))
        .select("family", "grams", F.xxhash64("text", "variant").alias("key"))
    )
    lines = paragraphs(docs).select("text")
    total = max(lines.count(), 1)
    share = min(1.0, rule.unknown / total)
    pick = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    others = (
        lines.filter(pick)
        .distinct()
        .select("text", _grams(_words(F.col("text"))).alias("grams"))
        # What looks like a notice is no example of anything else.
        .filter(_likeness(F.col("grams"), all_grams) < 0.3)
        .select(F.lit(UNKNOWN).alias("family"), "grams", F.xxhash64("text").alias("key"))
    )
    # Ordinary words around a notice are seen with no family.
    examples = varied.unionAll(others).unionAll(
        spark.createDataFrame([(UNKNOWN, [], k) for k in range(50)], "family string, grams array<string>, key long")
    )
    examples = stage(
        examples.select(
            F.array_position(_literal(families), F.col("family")).cast("double").alias("label") - 1,
            F.array_intersect("grams", _literal(grams)).alias("grams"),
            (F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(5)) == 0).alias("kept"),
        )
        .toDF("label", "grams", "kept")
        .coalesce(4),
        "licence-examples",
    )
    vectors = CountVectorizerModel.from_vocabulary(
        grams, inputCol="grams", outputCol="features", binary=True
    ).transform(examples)
    fitted = LogisticRegression(
        family="multinomial",
        regParam=rule.regularisation,
        elasticNetParam=rule.elastic,
        maxIter=50,
        standardization=False,
    ).fit(vectors.filter("NOT kept"))

    # The probabilities of the part that was kept, at each temperature.
    raw = fitted.transform(vectors.filter("kept")).select(
        "label", vector_to_array("rawPrediction").alias("z")
    )
    temperature = (
        raw.withColumn("t", F.explode(F.array(*[F.lit(0.1 * k) for k in range(2, 41)])))
        .withColumn("own", F.get("z", F.col("label").cast("int")))
        .select(
            "t",
            (
                F.log(F.aggregate(_shifted("z", "t"), F.lit(0.0), lambda a, x: a + x))
                - (F.col("own") - F.array_max("z")) / F.col("t")
            ).alias("loss"),
        )
        .groupBy("t")
        .agg(F.avg("loss").alias("loss"))
        .orderBy("loss", "t")
        .first()["t"]
    )
    unknown = float(len(families) - 1)
    best = F.array_max(F.slice("p", 1, len(families) - 1))
    threshold = (
        raw.withColumn("t", F.lit(temperature))
        .withColumn("p", _softmax("z", "t"))
        .filter(F.col("label") == unknown)
        .agg(F.percentile_approx(best, 1 - rule.false_share, 10_000))
        .first()[0]
    )
    matrix = fitted.coefficientMatrix
    size = len(families)
    weights = [[float(matrix[c, g]) for c in range(size)] for g in range(len(grams))]
    used = [k for k, w in enumerate(weights) if any(w)]
    return LicenceModel(
        families,
        [grams[k] for k in used],
        [weights[k] for k in used],
        [float(fitted.interceptVector[c]) for c in range(size)],
        float(temperature),
        max(float(threshold or 0.0), 0.5),
        templates,
    )


def _shifted(z: str, t: str) -> Column:
    return F.transform(F.col(z), lambda x: F.exp((x - F.array_max(z)) / F.col(t)))


def _softmax(z: str, t: str) -> Column:
    e = _shifted(z, t)
    return F.element_at(
        F.transform(
            F.array(e),
            lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)),
        ),
        1,
    )


def scan_licences(
    docs: DataFrame, model: LicenceModel, rule: LicenceRule = LicenceRule()
) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity of every licence notice."""
    spark = docs.sparkSession
    rows = _template_grams(spark, model.templates).collect()
    vocabulary = _literal(model.grams)
    weights = F.array(*[F.array(*[F.lit(x) for x in w]) for w in model.weights])
    bias = F.array(*[F.lit(b) for b in model.bias])
    z = F.aggregate(
        "met",
        bias,
        lambda a, g: F.zip_with(
            a, F.get(weights, (F.array_position(vocabulary, g) - 1).cast("int")), lambda x, y: x + y
        ),
    )
    known = paragraphs(docs).withColumn("grams", _grams(_words(F.col("text"))))
    # Each step is evaluated once, and only where the one before it leaves something.
    met = compute_once(known, {"met": F.array_intersect("grams", vocabulary)})
    # Without any of these the scores are the bias alone, which is for unknown.
    scored = compute_once(met.filter(F.size("met") > 0), {"z": z})
    best = F.array_position("z", F.array_max("z")).cast("int") - 1
    named = compute_once(
        scored.drop("met"), {"family": F.get(_literal(model.families), best)}
    ).filter(F.col("family") != UNKNOWN)
    # A notice is compared with the templates of the family it was given.
    similarity = F.lit(None).cast("double")
    for family in model.families[:-1]:
        own = [r.grams for r in rows if r.family == family]
        similarity = F.when(F.col("family") == family, _likeness(F.col("grams"), own)).otherwise(
            similarity
        )
    probability = F.array_max(_softmax("z", "t"))
    return (
        compute_once(
            named.withColumn("t", F.lit(model.temperature)),
            {"probability": probability, "similarity": similarity},
        )
        .filter(F.col("probability") >= model.threshold)
        .filter(F.col("similarity") >= rule.similarity)
        .select(
            "doc_id",
            F.col("paragraph").cast("long").alias("paragraph"),
            "family",
            "probability",
            "similarity",
        )
    )
