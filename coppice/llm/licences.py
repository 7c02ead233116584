"""Licence scan by a trained paragraph classifier.

A multinomial logistic regression over hashed word uni- and bigrams is trained on sentences of licence texts and, as
the unknown class, on a bounded sample of corpus paragraphs that resemble no template. On held-back paragraphs a
temperature is chosen for its probabilities, and a paragraph below ``MIN_PROBABILITY`` is unknown. A predicted family
is confirmed when the paragraph holds most word pairs of one of the family's templates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, whole_text, written

#: How works commonly state their licence, by family.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is free software under the GNU Affero General Public License, version 3.",
             "Licensed under the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "You may not use this file except in compliance with the License. You may obtain a copy of the Apache License.",
               "Released under the terms of the Apache License 2.0."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Released under the BSD 3-Clause License.", "Licensed under the 2-Clause BSD License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
            "Licensed under the GNU General Public License, version 2."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
            "Released under the ISC License."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "Licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0."],
}
UNKNOWN = "unknown"
FEATURES = 1 << 14
#: Bound of the unknown sample, confidence below which a paragraph is unknown, template share that confirms.
SAMPLE, MIN_PROBABILITY, CONFIRM = 4000, 0.5, 0.75
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]


def terms(paragraph: Column) -> Column:
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), "")


def pairs(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                                                lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def with_features(df: DataFrame, words: str = "words") -> DataFrame:
    """Hashed counts of words and word pairs."""
    listed = df.withColumn("grams", F.concat(F.col(words), pairs(F.col(words))))
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features").transform(listed).drop("grams")


def template_pairs(templates: Mapping[str, Sequence[str]]) -> list[tuple[str, list[str]]]:
    found = []
    for family, texts in templates.items():
        for text in texts:
            words = "".join(c.lower() if c.isalnum() else " " for c in text).split()
            found.append((family, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return found


def confirmation(words: Column, templates: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Per family the largest share of a template's word pairs that the paragraph holds."""
    held = F.array_distinct(pairs(words))
    shares: dict[str, list[Column]] = {}
    for family, listed in template_pairs(templates):
        shares.setdefault(family, []).append(F.size(F.array_intersect(held, F.array(*[F.lit(p) for p in listed]))) / F.lit(float(len(listed))))
    return {family: F.greatest(F.lit(0.0), *values) for family, values in shares.items()}


def paragraphs_of(df: DataFrame, text: str) -> DataFrame:
    listed = F.transform(F.split(whole_text(text), "\n"), lambda p, i: F.struct(i.alias("pos"), p.alias("paragraph")))
    return df.withColumn("p", F.explode(listed)).select(*[c for c in df.columns if c != text], "p.pos", "p.paragraph")


class LicenceModel:
    """Fitted regression, its class names and its temperature."""

    def __init__(self, model: LogisticRegressionModel, classes: list[str], temperature: float):
        self.model, self.classes, self.temperature = model, classes, temperature


def probabilities(raw: Column, temperature: Column, n: int) -> Column:
    """Softmax of the raw scores at a temperature."""
    top = F.array_max(raw)
    grown = F.transform(raw, lambda x: F.exp((x - top) / temperature))
    return F.transform(grown, lambda x: x / F.aggregate(grown, F.lit(0.0), lambda a, b: a + b))


def fit(df: DataFrame, text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, sample: int = SAMPLE) -> LicenceModel:
    """Train on the templates and on at most ``sample`` corpus paragraphs, chosen by the hash of their text."""
    spark = df.sparkSession
    families = sorted(templates)
    fixed = [(families.index(f), t, float(sample) / 4 / sum(len(v) for v in templates.values())) for f in families for t in templates[f]]
    known = spark.createDataFrame(fixed, "label int, paragraph string, weight double")
    # a template also stands in a longer paragraph
    joined = known.unionByName(known.withColumn("paragraph", F.concat(F.lit("This document and its parts are (c) the authors. "), "paragraph")))
    share = confirmation(F.col("words"), templates)
    share_of_rows = max(1, df.count() // sample)  # about ``sample`` texts, so that sorting does not grow with the table
    texts = df.select(F.col(text)).where(F.pmod(F.xxhash64(text), F.lit(share_of_rows)) == 0)
    drawn = (paragraphs_of(texts, text).select("paragraph").where(F.length("paragraph") > 0)
             .withColumn("h", F.xxhash64("paragraph")).where(F.length("paragraph") <= 4000)
             .orderBy("h", "paragraph").limit(sample).withColumn("words", terms(F.col("paragraph"))))
    other = drawn.where(F.greatest(F.lit(0.0), *share.values()) < 0.3).select(F.lit(len(families)).alias("label"), "paragraph", F.lit(1.0).alias("weight"))
    rows = written(with_features(joined.unionByName(other).withColumn("words", terms(F.col("paragraph"))))
                   .select(F.col("label").cast("double").alias("label"), "weight", "features", F.xxhash64("paragraph").alias("h")), "licence-training")
    background = F.col("label") == len(families)
    train = rows.where(~background | (F.pmod("h", F.lit(4)) != 0))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60, family="multinomial").fit(train)
    held = model.transform(rows.where(~background | (F.pmod("h", F.lit(4)) == 0))).select("label", "weight", vector_to_array("rawPrediction").alias("raw"))
    loss = [F.sum(F.col("weight") * -F.log(F.greatest(F.element_at(probabilities(F.col("raw"), F.lit(t), len(families) + 1),
                                                                  F.col("label").cast("int") + 1), F.lit(1e-12)))).alias(f"t{i}")
            for i, t in enumerate(TEMPERATURES)]
    losses = held.agg(*loss).first()
    best = min(range(len(TEMPERATURES)), key=lambda i: (losses[i] if losses[i] is not None else 0.0, i))
    return LicenceModel(model, [*families, UNKNOWN], TEMPERATURES[best])


def classify(df: DataFrame, model: LicenceModel, text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES,
             min_probability: float = MIN_PROBABILITY, confirm: float = CONFIRM) -> DataFrame:
    """One row per paragraph: the other columns, ``pos``, ``paragraph``, ``family``, ``probability``, ``template_share``.

    ``family`` is ``unknown`` unless the calibrated probability reaches ``min_probability`` and a template of that
    family confirms it. Empty paragraphs are unknown without being scored.
    """
    rows = paragraphs_of(df, text).withColumn("words", terms(F.col("paragraph")))
    n = len(model.classes)
    scored = model.model.setPredictionCol("").setProbabilityCol("").setFeaturesCol("features").transform(with_features(rows))
    scored = scored.withColumn("raw", vector_to_array("rawPrediction")).drop("rawPrediction", "features")
    scored = scored.withColumn("top", F.array_max(F.transform("raw", lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))))
    chosen = F.element_at(F.array(*[F.lit(c) for c in model.classes]), 1 - F.col("top.i"))
    predicted = scored.withColumn("predicted", F.when(F.size("words") == 0, F.lit(UNKNOWN)).otherwise(chosen))
    likely = F.when(F.col("predicted") != UNKNOWN, F.element_at(probabilities(F.col("raw"), F.lit(model.temperature), n), 1 - F.col("top.i")))
    share = F.lit(None).cast("double")
    for family, value in confirmation(F.col("words"), templates).items():
        share = F.when(F.col("predicted") == family, value).otherwise(share)
    judged = predicted.withColumn("probability", likely).withColumn("template_share", share)
    sure = (F.col("probability") >= min_probability) & (F.col("template_share") >= confirm)
    return judged.withColumn("family", F.when(sure, F.col("predicted")).otherwise(UNKNOWN)).select(
        *rows.columns[:-1], "family", "probability", "template_share")


def anchors(templates: Mapping[str, Sequence[str]], confirm: float) -> list[str]:
    """Words of which a text must hold at least one before any template can reach the ``confirm`` share.

    A confirmed paragraph misses at most ``1 - confirm`` of a template's pairs, so it holds one of any larger number of
    them, and with it the pair's longer word.
    """
    found = set()
    for _, listed in template_pairs(templates):
        longest = sorted((max(p.split(), key=lambda w: (len(w), w)) for p in listed), key=lambda w: (-len(w), w))
        found.update(longest[: int((1 - confirm) * len(listed)) + 1])
    return sorted(found)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", model: LicenceModel | None = None,
         templates: Mapping[str, Sequence[str]] = TEMPLATES, confirm: float = CONFIRM) -> DataFrame:
    """Per row: key, n_paragraphs, n_licence, licences (distinct families, sorted, comma-joined) and the best probability.

    Null text is one empty paragraph. Rows equal in key and text are scanned as one and returned as often as they
    occur. Other columns are ignored. An empty table gives no rows (the model is then trained on templates alone).
    A text without any of the ``anchors`` cannot be confirmed for any family, so its paragraphs are not scored.
    """
    named = only(df, key, text).toDF("id", "text")
    fitted = model or fit(named, templates=templates)
    needed = F.array(*[F.lit(word) for word in anchors(templates, confirm)])
    # bound once: written out, the lower-cased text would be made anew for every word
    possible = F.element_at(F.transform(F.array(F.lower(whole_text())), lambda low: F.exists(needed, lambda word: F.contains(low, word))), 1)
    rows = named.withColumn("n_paragraphs", F.size(F.split(whole_text(), "\n")).cast("long")).withColumn("possible", possible)
    plain = rows.where(~F.col("possible")).select(F.col("id").alias(key), "n_paragraphs", F.lit(0).cast("long").alias("n_licence"),
                                                  F.lit("").alias("licences"), F.lit(None).cast("double").alias("probability"))
    candidates = rows.where("possible").drop("possible").withColumn("h", F.xxhash64("text", F.reverse("text")))
    hit = F.col("family") != UNKNOWN
    found = classify(candidates, fitted, templates=templates, confirm=confirm).groupBy("id", "h", "n_paragraphs").agg(
        F.count_if(F.col("pos") == 0).alias("copies"), F.collect_set(F.when(hit, F.struct("pos", "family"))).alias("hits"),
        F.round(F.max(F.when(hit, F.col("probability"))), 4).alias("probability"))
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["family"])))
    scored = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(key), "n_paragraphs", F.size("hits").cast("long").alias("n_licence"), F.array_join(names, ",").alias("licences"), "probability")
    return plain.unionByName(scored)
