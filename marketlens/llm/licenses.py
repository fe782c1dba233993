"""Licence scans by a trained paragraph classifier (operator 5).

Word 1- and 2-grams of a paragraph go to a multinomial logistic regression over licence families
and an unknown class. It is trained on variants of the families' notices and on half of all
paragraphs of the corpus; a probability bound is set on the other half so that unknown ones stay
unknown. What it identifies is confirmed by comparison with the family's notices. The model knows the
grams of the notices and their variants, so paragraphs that hold the same of them are one row with a
weight, and the whole corpus trains it. All steps are DataFrame operations.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Usual notices of the families.
NOTICES = {
    "all-rights-reserved": ["All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Released under the BSD License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
}
UNKNOWN = "unknown"
#: Weight of a family's notices in training, shared by their variants, for so many paragraphs of the
#: corpus that train the unknown class, and at least; any other paragraph weighs 1.
FAMILY_WEIGHT, PARAGRAPHS = 300.0, 4000
#: Least share of the shorter of paragraph and notice in the other that confirms a family.
CONFIRM = 0.6
#: Limits of the bound on a family's probability.
LEAST_PROBABILITY, MOST_BOUND = 0.5, 0.9


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word stands for itself."""
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.element_at(w, i + 2)))
    return F.when(F.size(w) == 1, w).otherwise(F.array_distinct(pairs))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), text of each line with a letter or digit."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("paragraph", "text"))
    return lines.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def notices(spark: SparkSession) -> DataFrame:
    """number, family, notice, grams of each notice."""
    rows = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("notice")) for f, texts in sorted(NOTICES.items()) for t in texts]
    return (spark.range(1).select(F.posexplode(F.array(*rows)).alias("number", "x")).select("number", "x.*")
            .withColumn("grams", bigrams(words(F.col("notice")))))


def _variants(known: DataFrame) -> DataFrame:
    """Each notice as it is, without each of its words, and its longer beginnings and ends."""
    w = known.select("family", words(F.col("notice")).alias("w")).withColumn("n", F.size("w"))
    without = w.select("family", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(
        F.slice("w", F.lit(1), i - 1), F.slice("w", i + 1, F.col("n"))))).alias("w"), "n")
    cut = F.greatest(F.lit(3), F.ceil(F.col("n") * 0.7).cast("int"))
    parts = w.where("n > 4").select("family", F.explode(F.array(F.slice("w", F.lit(1), cut), F.slice("w", F.col("n") - cut + 1, cut))).alias("w"), "n")
    return w.select("family", "w", "n").union(without.where("n > 3")).union(parts).select("family", F.concat_ws(" ", "w").alias("text"))


@dataclass
class Scanner:
    model: LogisticRegressionModel
    grams: CountVectorizerModel
    families: list[str]
    bound: float


def _grams(w: Column, vocabulary: list[str]) -> Column:
    """The distinct words and pairs of neighbouring words that are in the vocabulary, in order."""
    one, two = [g for g in vocabulary if " " not in g], [g for g in vocabulary if " " in g]
    fewer = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), fewer), F.slice(w, F.lit(2), fewer), lambda x, y: F.when(x.isin(one) & y.isin(one), F.concat_ws(" ", x, y)))
    return F.sort_array(F.array_distinct(F.concat(F.filter(w, lambda x: x.isin(one)), F.filter(pairs, lambda x: x.isin(two)))))


def _vocabulary(made: DataFrame) -> list[str]:
    """Words and pairs of neighbouring words of the notices' variants."""
    w = words(F.col("text"))
    return sorted(r.gram for r in made.select(F.explode(F.concat(w, bigrams(w))).alias("gram")).distinct().collect())


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for a row: a filter is not pushed into a generator, where it would
    repeat their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _unlike(rows: DataFrame, text: str, known: list, vocabulary: list[str]) -> DataFrame:
    """The rows whose text shares less than half its pairs of words with every notice, with its words ``w``
    and ``grams``. The vocabulary holds all pairs of the notices."""
    rows = _once(rows, w=words(F.col(text)))
    rows = _once(rows, grams=_grams(F.col("w"), vocabulary))
    rows = _once(rows, pairs=F.filter("grams", lambda g: g.contains(" ")))
    rows = _once(rows, n=F.when(F.size("pairs") > 0, F.size(bigrams(F.col("w")))))
    like = [2 * F.size(F.array_intersect("pairs", F.array(*map(F.lit, r.grams)))) >= F.least("n", F.lit(len(r.grams))) for r in known]
    return rows.where((F.size("pairs") == 0) | ~functools.reduce(lambda x, y: x | y, like)).drop("pairs", "n")


def _around(drawn: DataFrame, numbers: int) -> DataFrame:
    """other, number of the training half: the number comes from other bits of h than the half does."""
    return drawn.where("pmod(h, 2) = 0").select(F.col("text").alias("other"), F.pmod(F.shiftright("h", 1), F.lit(numbers)).alias("number"))


def fit(docs: DataFrame) -> Scanner:
    """Train on variants of the notices and on all paragraphs of ``docs``.

    Half of the paragraphs, by a hash of the text, trains the unknown class, alone and around notices;
    the other half sets the bound: the highest probability that a family gets among them. Without
    documents the unknown class has only an empty paragraph.
    """
    spark = docs.sparkSession
    known = notices(spark)
    rows, made = known.orderBy("number").collect(), _variants(known)  # fixed and few
    families, vocabulary = [UNKNOWN, *sorted(NOTICES)], _vocabulary(made)
    drawn = paragraphs(docs).select("text", F.xxhash64("text").alias("h"))
    around = _around(drawn, 8 * len(rows)).join(F.broadcast(known.select("number", "family", "notice")), "number")
    inside = _once(_unlike(around, "other", rows, vocabulary), both=F.concat("w", words(F.col("notice"))))
    inside = inside.select(F.lit(0).alias("half"), "family", _grams(F.col("both"), vocabulary).alias("grams"))
    alone = _unlike(drawn, "text", rows, vocabulary).select(F.pmod("h", F.lit(2)).cast("int").alias("half"), F.lit(UNKNOWN).alias("family"), "grams")
    counted = written(alone.union(inside).groupBy("half", "family", "grams").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    size = counted.where((F.col("half") == 0) & (F.col("family") == UNKNOWN)).agg(F.sum("weight")).first()[0] or 0.0
    share = FAMILY_WEIGHT * max(1.0, size / PARAGRAPHS)
    empty = spark.range(1).select(F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("grams"), F.lit(1.0).alias("weight"))
    taught = made.select("family", _grams(words(F.col("text")), vocabulary).alias("grams"), (share / F.count(F.lit(1)).over(Window.partitionBy("family"))).alias("weight"))
    train = counted.where("half = 0").select("family", "grams", "weight").union(empty).union(taught)
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    of = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    regression = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial", weightCol="weight")
    scanner = Scanner(regression.fit(of.transform(train.withColumn("label", label))), of, families, LEAST_PROBABILITY)
    wrong = _judged(counted.where("half = 1").select("grams"), scanner).where(F.col("family") != UNKNOWN).agg(F.max("probability")).first()[0]
    scanner.bound = max(LEAST_PROBABILITY, min(wrong or 0.0, MOST_BOUND))
    return scanner


def _judged(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """Adds family and probability to rows with ``grams``, and takes the model's own columns away."""
    chances = _once(scanner.model.setRawPredictionCol("").transform(scanner.grams.transform(rows)), _p=vector_to_array("probability"))
    best = F.array_max("_p")
    family = F.element_at(F.array(*map(F.lit, scanner.families)), F.array_position("_p", best).cast("int"))
    return chances.select(*rows.columns, family.alias("family"), best.alias("probability"))


def _identified(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """Adds family and probability to rows with a text."""
    held = _once(_once(rows, _w=words(F.col("text"))), grams=_grams(F.col("_w"), scanner.grams.vocabulary)).drop("_w")
    return _judged(held, scanner).drop("grams")


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of each identified paragraph.

    A paragraph is a line of the text; its number counts all lines from 0. Null and empty texts, and
    lines without a letter or digit, have none. Rows are judged one by one: repeated rows and null
    ids give rows of their own, other columns are ignored whatever their names, an empty table
    gives an empty result. ``similarity`` is the best share of word pairs with a notice of the
    family; ``confirmed`` tells whether it reaches CONFIRM.
    """
    found = _identified(paragraphs(docs), scanner).where((F.col("family") != UNKNOWN) & (F.col("probability") >= scanner.bound))
    known = notices(docs.sparkSession).groupBy("family").agg(F.collect_list("grams").alias("known"))
    own = bigrams(words(F.col("text")))
    share = F.array_max(F.transform("known", lambda k: F.size(F.array_intersect(F.col("own"), k)) / F.greatest(F.least(F.size("own"), F.size(k)), F.lit(1))))
    return (found.withColumn("own", own).join(F.broadcast(known), "family").withColumn("similarity", share)
            .select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed")))
