"""Licence families of paragraphs: a sparse logistic regression over word n-grams, in DataFrame operations only.

Features are the n-grams of one to three words that hold an anchor, a word of licensing. A paragraph without one has no feature,
so it is certainly unknown, and only texts and paragraphs with an anchor are taken apart. Weights of n-grams are joined on and
summed per paragraph; a family must be more probable than the calibrated unknown class, and a template of the same family must
confirm it: both must have most of each other's n-grams, one of them the family's alone, and no word may turn the permission round.

The model is fitted on the templates, whole and in parts, and for the unknown class on notices of other licences and a bounded sample
of the corpus' own paragraphs with an anchor that no template confirms. Half of the examples fit the weights, the other half the temperature of the
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import let
from ..session import cut_lineage
from .base import row_key

UNKNOWN = "unknown"
SAMPLE = 2_000  # unknown paragraphs that fit the model, chosen by a hash of their text
VOCABULARY = 6_000  # n-grams with weights, the most frequent of the examples; bounds what is broadcast
CONFIRMED = 0.5  # share of a template's n-grams, and of the paragraph's, that both have
WRAPPED = 12  # lines of a paragraph above which its stretches are taken as texts, too
BEFORE = 8  # words that a stretch has before its first word with an anchor, so that a denying one is seen
STRETCHES = (8, 16, 40)  # words of a stretch from there on; no template is longer than the last
# fixed values: words that turn a permission round
DENYING = ["not", "never", "no", "nor", "neither", "cannot", "without", "prohibited", "forbidden", "revoked", "nicht", "kein", "keine", "keiner", "untersagt", "verboten", "pas", "aucune", "interdite", "interdit", "prohibida", "prohibido", "ninguna", "instead"]
# fixed values: notices of licences without a family here, and sentences that only name one
OTHERS = [
    "Licensed under the Eclipse Public License 2.0.",
    "This program is made available under the terms of the Eclipse Public License, version 1.0.",
    "Licensed under the GNU Affero General Public License, version 3.",
    "SPDX-License-Identifier: AGPL-3.0-only",
    "Licensed under the EUPL, version 1.2.",
    "Licensed under the European Union Public Licence.",
    "Licensed under the ISC License.",
    "SPDX-License-Identifier: ISC",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "Licensed under the Artistic License 2.0.",
    "Licensed under the Boost Software License 1.0.",
    "Licensed under the zlib license.",
    "Released under the Unlicense.",
    "Licensed under the Common Development and Distribution License.",
    "Licensed under the Microsoft Public License.",
    "Licensed under the Open Software License 3.0.",
    "Licensed under the University of Illinois License.",
    "The license of this file is unclear.",
    "A driving licence is required.",
    "This is not licensed under the MIT License.",
    "We compared the Apache License with the GNU General Public License.",
    "Redistribution and use in source and binary forms are prohibited.",
]
ANCHOR = r"(?:licen[sc]|lizen[sz]|licencia|copyright|reserved|warrant|apache|gnu|[al]?gpl|bsd|mozilla|mpl|commons|cc0?(?![a-z0-9])|spdx|redistribut|permission|proprietary|unlicense)"
# fixed values: opening and notice lines of well-known licences
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the CC BY-NC-SA 4.0 license.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020. All rights reserved.",
        "This document is proprietary and confidential; no part may be reproduced without prior written permission.",
    ],
}


def words(text: Column) -> Column:
    """Lower-case words; full stops and hyphens stay inside a word only."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.+-]+(?=[^\p{L}\p{N}]|$)|(?<![\p{L}\p{N}])[.+-]+", " ")
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def grams(own: Column) -> Column:
    """Distinct n-grams of one to three words that hold an anchor."""

    def runs(bound: Column, n: int) -> Column:
        return F.transform(bound, lambda _, i: F.array_join(F.slice(bound, i + 1, n), " "))

    # bound once: inside a lambda the words would be made anew for every n-gram
    every = let(own, lambda bound: F.concat(*[runs(bound, n) for n in (1, 2, 3)]))
    return F.array_distinct(F.filter(every, lambda g: g.rlike(rf"(?:^|[ -]){ANCHOR}")))


@dataclass(frozen=True)
class Model:
    weights: DataFrame  # (gram, w): a weight for each family, in order
    bias: list[float]
    families: list[str]
    templates: DataFrame  # see ``_templates``
    temperature: float


def _template_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, i, t) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)], "family string, template int, text string")


def _examples(spark: SparkSession) -> DataFrame:
    """Templates whole, behind other words, and as their first two thirds."""
    rows = _template_rows(spark)
    own = F.split("text", " ")
    forms = F.array(
        F.col("text"), F.concat(F.lit("Note: "), "text"), F.concat(F.lit("Project files. "), "text"), F.concat_ws(" ", F.slice(own, 1, F.ceil(F.size(own) * 0.67).cast("int")))
    )
    return rows.select("family", F.explode(forms).alias("text")).distinct()


def paragraphs(docs: DataFrame) -> DataFrame:
    """(row_id, row_hash, place, paragraph, grams) of (row_id, row_hash, text): lines with an anchor, and as one text each the paragraphs of
    several lines with one, over which a notice may be wrapped. A paragraph of more than ``WRAPPED`` lines may hold more than the notice, so its
    stretches of words around each word with an anchor are texts, too, however many lines they take."""
    hint = rf"(?i)(?<![\p{{L}}\p{{N}}]){ANCHOR}"

    def stretches(block: Column) -> Column:
        def around(own: Column) -> Column:
            found = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.get(own, i).rlike(hint))
            return F.flatten(F.transform(found, lambda i: F.array(*[part(own, i, n) for n in STRETCHES])))

        return let(F.split(block, r"\s+"), around)

    def part(own: Column, i: Column, n: int) -> Column:
        first = F.greatest(i - BEFORE, F.lit(0))
        return F.array_join(F.slice(own, first + 1, i - first + n), " ")

    def texts(block: Column) -> Column:
        one = F.regexp_replace(block, r"[ \t\r]*\n[ \t>*#/]*", " ")
        long = F.size(F.split(block, "\n")) > WRAPPED
        return let(one, lambda t: F.concat(F.array(t), F.when(long & t.rlike(hint), F.array_distinct(stretches(t))).otherwise(F.array().cast("array<string>"))))

    blocks = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda b: b.contains("\n"))
    whole = F.flatten(F.transform(blocks, texts))
    lines = docs.where(F.col("text").rlike(hint)).select("row_id", "row_hash", F.posexplode(F.concat(F.split("text", "\n"), whole)).alias("place", "paragraph"))
    return lines.where(F.col("paragraph").rlike(hint)).withColumn("grams", grams(words(F.col("paragraph")))).where(F.size("grams") > 0)


def _templates(spark: SparkSession) -> DataFrame:
    """(family, template, gram, n, own, denying): the n-grams of each template, whether only its family has them, and its denying words."""
    made = _template_rows(spark).withColumn("words", words(F.col("text")))
    made = made.select("family", "template", grams(F.col("words")).alias("grams"), _denying(F.col("words")).alias("denying"))
    made = made.select("family", "template", F.explode("grams").alias("gram"), F.size("grams").alias("n"), "denying")
    families = made.groupBy("gram").agg(F.count_distinct("family").alias("families"))
    return made.join(F.broadcast(families), "gram").withColumn("own", F.col("families") == 1).drop("families")


def _denying(own: Column) -> Column:
    return F.array_intersect(own, F.array(*[F.lit(w) for w in DENYING]))


def fit(found: DataFrame) -> Model:
    """Fit on templates, fixed notices of other licences, and a bounded sample of the corpus' ``paragraphs`` that no template confirms."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    spark = found.sparkSession
    templates = _templates(spark)
    other = found.groupBy("paragraph").agg(F.first("grams").alias("grams"))
    alike = _shares(other.select(F.col("paragraph").alias("id"), "paragraph", "grams"), templates).groupBy("id").agg(F.max("share").alias("share"))
    unlike = other.join(alike.where(F.col("share") >= CONFIRMED), other["paragraph"] == alike["id"], "left_anti")
    sample = unlike.orderBy(F.xxhash64("paragraph"), "paragraph").limit(SAMPLE).select(F.lit(UNKNOWN).alias("family"), F.col("paragraph").alias("text"))
    sample = sample.unionByName(spark.createDataFrame([(UNKNOWN, t) for t in OTHERS], "family string, text string"))
    examples = _examples(spark).unionByName(sample)
    families = [UNKNOWN, *TEMPLATES]
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    rows = examples.select(number.alias("label"), grams(words(F.col("text"))).alias("grams"), "text")
    # an example of the unknown class without any feature, so that the class always exists
    rows = rows.unionByName(spark.createDataFrame([(0.0, [], "")], "label double, grams array<string>, text string"))
    rows = rows.coalesce(1)  # at most SAMPLE paragraphs and the templates
    rows = cut_lineage(rows.withColumn("half", F.when(F.col("text") == "", 0).otherwise(F.abs(F.xxhash64("text", F.lit(1))) % 2)))
    vectors = CountVectorizer(inputCol="grams", outputCol="x", vocabSize=VOCABULARY, binary=True).fit(rows)
    ready = vectors.transform(rows).select("label", "x", "half")
    sizes = ready.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    # as many sizes as families
    ready = cut_lineage(ready.join(F.broadcast(sizes), "label").select("label", "x", "half", (1 / F.sqrt("size")).alias("weight")))
    curve = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=25)
    fitted = curve.fit(ready)
    temperature = _temperature(curve.fit(ready.where("half = 0")).transform(ready.where("half = 1")), spark)
    table = fitted.coefficientMatrix.toArray().T
    count = fitted.numClasses
    bias = [float(b) for b in fitted.interceptVector] + [-1e9] * (len(families) - count)
    weights = [(g, [float(v) for v in row] + [0.0] * (len(families) - count)) for g, row in zip(vectors.vocabulary, table)]
    return Model(spark.createDataFrame(weights, "gram string, w array<double>"), bias, families, templates, temperature)


def _temperature(scored: DataFrame, spark: SparkSession) -> float:
    """The divisor of the raw scores under which the other half's labels are likeliest, out of a row of candidates."""
    from pyspark.ml.functions import vector_to_array

    raw = scored.select(F.col("label").cast("int").alias("k"), vector_to_array("rawPrediction").alias("r")).where(F.col("k") < F.size("r"))
    candidates = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0)
    top = F.array_max("r")

    def loss(t: float) -> Column:
        total = F.aggregate("r", F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / t))
        return F.avg(F.log(total) - (F.element_at("r", F.col("k") + 1) - top) / t)

    row = raw.agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(candidates)]).first()
    known = [(loss, t) for loss, t in zip(row, candidates) if loss is not None]
    return min(known)[1] if known else 1.0


def _shares(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(id, family, share): how well the best template of each family confirms a paragraph (id, paragraph, grams), for families that share
    an n-gram with it.

    It is the share of the template's n-grams that both have, or that of the paragraph's if that is less. It is zero without an n-gram that
    only templates of this family have, as many licences share their phrases, and with a denying word that the template has not.
    """
    # templates are a fixed table of this module: bounded, so they are compared inside the row, without a row per n-gram and template
    known: dict[tuple, list] = {}
    for r in templates.orderBy("family", "template", "gram").collect():
        known.setdefault((r.family, r.template, tuple(r.denying)), []).append((r.gram, r.own))

    def texts(values) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    families: dict[str, list[Column]] = {}
    for (family, _, denying), parts in known.items():
        fields = texts(g for g, _ in parts).alias("grams"), texts(g for g, own in parts if own).alias("own"), texts(denying).alias("denying")
        families.setdefault(family, []).append(F.struct(*fields))

    def best(candidates: list[Column]) -> Column:
        def share(t: Column) -> Column:
            common = F.size(F.array_intersect("grams", t["grams"]))
            holds = F.arrays_overlap("grams", t["own"]) & (F.size(F.array_except("denies", t["denying"])) == 0)
            return F.when(holds, common / F.greatest(F.size(t["grams"]), F.size("grams"))).when(common > 0, 0.0)

        return F.array_max(F.transform(F.array(*candidates), share))

    each = found.select("id", "grams", _denying(words(F.col("paragraph"))).alias("denies"))
    made = F.array(*[F.struct(F.lit(f).alias("family"), best(c).alias("share")) for f, c in families.items()])
    return each.select("id", F.explode(made).alias("x")).select("id", "x.family", "x.share").where("share is not null")


def classify(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, family, probability, confirmed, n_paragraphs, families.

    Without a ``model`` one is fitted on the paragraphs of ``df``. ``family`` is that of the most probable confirmed
    paragraph, else "unknown"; ``probability`` is that paragraph's, or the greatest of a family without confirmation, and NULL where
    no paragraph looks like a licence. ``families`` lists all confirmed families in order. NULL and empty texts are unknown; repeated rows give equal rows; an empty table
    gives none.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = docs.select("doc_id", *row_key(), "text")
    # repeated rows give repeated paragraphs, which are one: equal texts have equal lines at equal places
    found = cut_lineage(paragraphs(keyed).dropDuplicates(["row_id", "row_hash", "place"]))
    model = model or fit(found)
    found = found.withColumn("id", F.struct("row_id", "row_hash", "place"))
    size = len(model.families)
    # at most VOCABULARY n-grams
    parts = found.select("id", F.explode("grams").alias("gram")).join(F.broadcast(model.weights), "gram")
    sums = parts.groupBy("id").agg(*[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(size)])
    scores = [(F.coalesce(F.col(f"w{i}"), F.lit(0.0)) + F.lit(b)) / F.lit(model.temperature) for i, b in enumerate(model.bias)]
    every = found.select("id").join(sums, "id", "left").select("id", F.array(*scores).alias("s"))
    top = F.array_max("s")
    odds = every.withColumn("total", F.aggregate("s", F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
    best = odds.select(
        "id", F.element_at(F.array(*[F.lit(f) for f in model.families]), F.array_position("s", top).cast("int")).alias("family"), (1 / F.col("total")).alias("probability")
    )
    named = best.where(F.col("family") != UNKNOWN)
    judged = named.join(_shares(found, model.templates), ["id", "family"], "left").withColumn("confirmed", F.coalesce(F.col("share"), F.lit(0.0)) >= CONFIRMED)
    per_doc = judged.groupBy("id.row_id", "id.row_hash").agg(
        F.max(F.struct("confirmed", "probability", "family")).alias("best"),
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
    )
    joined = keyed.drop("text").join(per_doc, ["row_id", "row_hash"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("best.confirmed"), F.col("best.family")).otherwise(UNKNOWN).alias("family"),
        F.col("best.probability").alias("probability"),
        F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"),
        F.coalesce("n_paragraphs", F.lit(0).cast("bigint")).alias("n_paragraphs"),
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
    )
