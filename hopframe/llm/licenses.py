"""License scan by diagonal voting.

Templates and documents are cut into words; the hash of every pair of neighbouring words of a document is joined to the
pairs of the templates. A hit at document word d and template word t votes for the diagonal d - t, on which an
unchanged copy puts all its votes. Neighbouring diagonals are merged, since an inserted or missing word moves the rest
of a copy to the next diagonal, and a merged span is accepted if it covers enough of the template without being
stretched. The template table holds a few hundred rows whatever the data, so it is broadcast.

Null and empty texts have no words, no labels and score 0. A very long text is one array of word hashes, whose rows are
filtered by the template table at once. Repeated rows get the same result each. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.llm.common import whole

# The phrases and labels of the contract.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
# Opening words of public license notices.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("all rights reserved", "all-rights-reserved"),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "K"  # the only character outside ASCII whose lower case is one ASCII letter


def license_words(text: Column) -> Column:
    """Words of the text with A-Z in lower case.

    ``lower`` also folds letters outside ASCII, which changes no word boundary and, but for the Kelvin sign, makes no
    ASCII letter alone; so exactly the words of the ASCII folding become equal to a template word.
    """
    folded = F.lower(F.replace(text, F.lit(KELVIN), F.lit("é")))
    return F.array_remove(F.split(folded, NOT_WORD), "")


def template_pairs(spark: SparkSession, templates=None) -> DataFrame:
    """One row per pair of neighbouring template words: template, label, is_base, n_pairs, t, h."""
    rows = []
    for number, (phrase, label, base) in enumerate(templates or default_templates()):
        parts = phrase.split()
        if len(parts) < 2:
            raise ValueError(f"a template needs two words: {phrase!r}")
        rows += [(number, label, base, len(parts) - 1, t, a, b) for t, (a, b) in enumerate(zip(parts, parts[1:]))]
    return spark.createDataFrame(
        rows, "template int, label string, is_base boolean, n_pairs int, t int, a string, b string") \
        .withColumn("h", F.xxhash64("a", "b")).drop("a", "b")


def default_templates() -> list[tuple[str, str, bool]]:
    return [(p, label, True) for p, label in BASE] + [(p, label, False) for p, label in NOTICES]


def find_spans(docs: DataFrame, id_col="doc_id", text_col="text", templates=None, slack=2) -> DataFrame:
    """Merged spans: doc_id, text_hash, template, label, is_base, n_pairs, start, stop, hits, coverage, places, exact.

    ``start`` and ``stop`` are the first and last word of the span, ``hits`` the distinct template pairs found,
    ``places`` the starts of the diagonals on which every pair was found. ``slack`` is the largest distance of
    diagonals to merge.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")) \
        .select("doc_id", F.xxhash64("text").alias("text_hash"), license_words(F.col("text")).alias("words")) \
        .select("doc_id", "text_hash",
                F.expr("zip_with(words, slice(words, 2, size(words)), (a, b) -> xxhash64(a, b))").alias("hashes"))
    votes = source.select("doc_id", "text_hash", F.posexplode("hashes").alias("d", "h")) \
        .join(F.broadcast(template_pairs(docs.sparkSession, templates)), "h") \
        .groupBy("doc_id", "text_hash", "template", "label", "is_base", "n_pairs",
                 (F.col("d") - F.col("t")).alias("diagonal")) \
        .agg(F.collect_set("t").alias("found"))
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int")
    islands = votes.withColumn("fresh", F.coalesce(fresh, F.lit(0))) \
        .withColumn("island", F.sum("fresh").over(order))
    full = F.size("found") == F.col("n_pairs")
    return islands.groupBy("doc_id", "text_hash", "template", "label", "is_base", "n_pairs", "island").agg(
        F.min(F.col("diagonal") + F.array_min("found")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("found") + 1).alias("stop"),
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("hits"),
        F.collect_list(F.when(full, F.col("diagonal"))).alias("places")) \
        .withColumn("coverage", F.col("hits") / F.col("n_pairs"))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates=None, min_coverage=0.75, max_stretch=1.5,
         slack=2) -> DataFrame:
    """One row per document with its labels, the places of the base phrases and the best coverage as score."""
    spans = find_spans(docs, id_col, text_col, templates, slack)
    base, places = F.col("is_base"), F.col("places")
    stretched = (F.col("stop") - F.col("start") + 1) > max_stretch * (F.col("n_pairs") + 1)
    accepted = ((F.col("coverage") >= min_coverage) & ~stretched) | (F.size(places) > 0)
    per_doc = spans.groupBy("doc_id", "text_hash").agg(
        F.sum(F.when(base, F.size(places)).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.array_min(places))).alias("first_word"),
        F.max(F.when(base, F.array_max(places))).alias("last_word"),
        F.collect_set(F.when(base & (F.size(places) > 0), F.col("label"))).alias("base_set"),
        F.collect_set(F.when(accepted, F.col("label"))).alias("label_set"),
        F.max("coverage").alias("score"))
    counts = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")) \
        .select("doc_id", F.xxhash64("text").alias("text_hash"),
                F.size(license_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counts.alias("c").join(per_doc.alias("p"), F.expr("c.doc_id <=> p.doc_id AND c.text_hash = p.text_hash"),
                                    "left")

    def labels(name):
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit(""))

    return joined.select(
        "c.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        labels("base_set").alias("base_labels"), labels("label_set").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
