"""License scans by diagonal voting, in DataFrame functions only.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. Every ``K`` consecutive words
of every whole text are joined, by hash and then word by word, to their places in templates of license
notices, which may have any number of words. Of a hit, document place minus template place is the diagonal. Hits vote by
document, template and diagonal; a diagonal and those up to ``SLACK`` beyond it (words put in or left out shift the
diagonal) are one span, so that a span never drifts farther. A span is verified by the share of the template's k-grams
that stand in it, each compared word by word: ``SHARE`` or more gives the template's label. Base phrases are found as they
stand.

The templates are broadcast up to ``MOST_GRAMS`` k-grams; more of them are joined like any other table.

Defined results: a null or empty text has no words, score 0 and empty labels; rows with the same id and text
are scanned alike, each gets its row; an empty table gives no rows; a template of fewer than ``K`` words is an error;
other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitlens.llm.common import chosen, saved

K, SLACK, SHARE = 3, 3, 0.6
MOST_GRAMS = 100_000

#: Notices in common use, as words; label and template.
TEMPLATES = [
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "this work is licensed under cc by"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

#: Base phrase and label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

SEPARATORS = "".join(chr(c) for c in [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def words(text: Column) -> Column:
    """The words; one empty word where there are none."""
    return F.split(F.lower(F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``t``, ``label``, ``place``, ``total`` and the k words of each k-gram of each template."""
    rows = []
    for t, (label, text) in enumerate(templates):
        w = text.split()
        total = len(w) - K + 1
        if total < 1:
            raise ValueError(f"a template has {K} words at least: {text}")
        rows += [(t, label, place, total, *w[place : place + K]) for place in range(total)]
    grams = spark.createDataFrame(rows, "t int, label string, place int, total int, x0 string, x1 string, x2 string").withColumn("gram", F.xxhash64("x0", "x1", "x2"))
    return F.broadcast(grams) if len(rows) <= MOST_GRAMS else grams


def verified_spans(hits: DataFrame) -> DataFrame:
    """Of hits (``doc_id``, ``rk``, ``pos``, ``t``, ``label``, ``place``, ``total``, each once) the spans: per ``diagonal`` with
    hits, ``share`` of the template's k-grams on it and up to ``SLACK`` beyond, ``first_word`` and ``end_word`` of them."""
    key = ["doc_id", "rk", "t", "label", "total"]
    votes = hits.withColumn("diagonal", F.col("pos") - F.col("place")).groupBy(*key, "diagonal").agg(F.collect_list("place").alias("places"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    near = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(0, SLACK)
    share = F.size(F.array_distinct(F.flatten(F.collect_list("places").over(near)))) / F.col("total")
    return votes.select(*key, "diagonal", share.alias("share"), F.min("lo").over(near).alias("first_word"), (F.max("hi").over(near) + K).alias("end_word"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per document ``doc_id``, ``n_words``; ``n_base``, ``first_word``, ``last_word``, ``base_labels`` of the base
    phrases; ``labels`` of phrases and verified templates; ``score``, the largest share of a template found."""
    spark = docs.sparkSession
    own = chosen(docs, doc_id=id_col, text=text_col).withColumn("rk", F.xxhash64("text"))
    placed = own.select("doc_id", "rk", words(F.col("text")).alias("w")).select("doc_id", "rk", "w", F.posexplode("w").alias("pos", "w0"))
    placed = placed.select("doc_id", "rk", "pos", "w0", F.get("w", F.col("pos") + 1).alias("w1"), F.get("w", F.col("pos") + 2).alias("w2"))

    def stands(phrase: str) -> Column:
        return reduce(Column.__and__, [F.col(f"w{i}") == x for i, x in enumerate(phrase.split())])

    base = reduce(lambda rest, p: F.when(stands(p[0]), p[1]).otherwise(rest), PHRASES, F.lit(None).cast("string"))
    grams = template_grams(spark, TEMPLATES if templates is None else templates)
    same = (F.col("hash") == F.col("gram")) & (F.col("w0") == F.col("x0")) & (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2"))
    found = placed.withColumn("hash", F.xxhash64("w0", "w1", "w2")).withColumn("base", base).join(grams, same, "left").where("t is not null or base is not null")
    found = saved(found.select("doc_id", "rk", "pos", "base", "t", "label", "place", "total").distinct(), "license-hits")

    spans = verified_spans(found.where("t is not null").select("doc_id", "rk", "pos", "t", "label", "place", "total").distinct())
    by_template = spans.groupBy("doc_id", "rk").agg(F.max("share").alias("score"), F.collect_set(F.when(F.col("share") >= SHARE, F.col("label"))).alias("more"))
    by_phrase = (
        found.where("base is not null").select("doc_id", "rk", "pos", "base").distinct()
        .groupBy("doc_id", "rk").agg(F.count(F.lit(1)).alias("n_base"), F.min("pos").cast("long").alias("first_word"), F.max("pos").cast("long").alias("last_word"), F.collect_set("base").alias("phrases"))
    )
    w = words(F.col("text"))
    counted = own.select("doc_id", "rk", F.when(F.get(w, F.lit(0)) == "", 0).otherwise(F.size(w)).cast("long").alias("n_words"))

    def joined_to(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"doc_id": "__id", "rk": "__rk"})
        return left.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("rk") == F.col("__rk")), "left").drop("__id", "__rk")

    none = F.array().cast("array<string>")
    joined = joined_to(joined_to(counted, by_phrase), by_template)
    phrases, more = F.coalesce("phrases", none), F.coalesce("more", none)
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(phrases), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(phrases, more)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
