"""Licence scans by diagonal voting, in DataFrame expressions only.

Every run of three words of every text is joined to the places of the same three words in the templates. A match votes
for the diagonal (place in the text minus place in the template); neighbouring diagonals are merged, so that inserted
or dropped words don't part a match; a merged span is verified by the share of the template's runs that it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals at most so far apart are one span.
NEIGHBOUR = 3
#: Share of a template's runs of three words that a span must hold.
COVER = 0.6
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a licence, found only where their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of common licences, found also when reworded in part.
NOTICES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc-notice": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "proprietary-notice": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased. The Kelvin sign, the one other letter that lower() makes ASCII, is held apart."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")))
    return F.split(F.regexp_replace(low, f"^{BREAK}", ""), BREAK)


def runs(df: DataFrame, words_: Column, *keys: str) -> DataFrame:
    """A row for each run of three words: keys, pos, a, b, c and their hash h."""
    w = df.select(*keys, words_.alias("w"))
    shifted = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("c"))
    rows = w.select(*keys, F.posexplode(shifted).alias("pos", "x")).where("x.c is not null and x.c <> ''")
    return rows.select(*keys, "pos", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.c").alias("c"), F.xxhash64("x.a", "x.b", "x.c").alias("h"))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Runs of the templates: name, exact, total, t_pos, a, b, c, h. Their number is fixed by the two lists."""
    rows = [(label, True, text) for text, label in phrases.items()] + [(label, False, text) for label, text in notices.items()]
    listed = spark.sql("select * from values " + ", ".join(f"('{n}', {str(e).lower()}, '{t}')" for n, e, t in rows) + " as t(name, exact, text)")
    listed = listed.withColumn("total", F.size(words(F.col("text"))) - (K - 1))
    keyed = runs(listed, words(F.col("text")), "name", "exact", "total")
    return keyed.select("name", "exact", "total", F.col("pos").alias("t_pos"), "h", *[F.col(c).alias(f"t_{c}") for c in "abc"])


def _key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.col("text")).alias("text_hash")]


def spans(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(doc_id, text_hash, name, exact, first_word, last_word, cover) of every verified span, once for equal rows."""
    mine = docs.select(*_key(), F.col("text").alias("text"))
    marks = F.broadcast(templates(docs.sparkSession, phrases, notices))  # as many rows as the templates have words
    hits = runs(mine, words(F.col("text")), "doc_id", "text_hash").join(marks, "h").where("a = t_a and b = t_b and c = t_c")
    votes = hits.groupBy("doc_id", "text_hash", "name", "exact", "total", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    one = votes.where("exact and size(places) = total").select("doc_id", "text_hash", "name", "exact", F.col("diagonal").alias("first_word"), (F.col("last") + K - 1).alias("last_word"), F.lit(1.0).alias("cover"))
    order = Window.partitionBy("doc_id", "text_hash", "name").orderBy("diagonal")
    banded = (
        votes.where("not exact").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOUR).cast("int"), F.lit(1)))
        .withColumn("band", F.sum("new").over(order)).groupBy("doc_id", "text_hash", "name", "exact", "total", "band")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.min("first").alias("first_word"), (F.max("last") + K - 1).alias("last_word"))
        .withColumn("cover", F.col("n") / F.col("total")).where(F.col("cover") >= COVER)
    )
    return one.unionByName(banded.select(*one.columns))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """A row for each of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are those of the phrases; notices add labels; score is the best cover of any span. Null texts are
    empty, texts of under three words match nothing, rows that repeat get the same result each, a null doc_id is
    matched as such. An empty table gives no rows; other columns are not read.
    """
    found = spans(docs, phrases, notices).groupBy("doc_id", "text_hash").agg(
        F.count_if("exact").alias("n_base"), F.min(F.when(F.col("exact"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word"))).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("name"))).alias("base"), F.collect_set("name").alias("every"), F.max("cover").alias("score"),
    )
    counted = docs.select(*_key(), F.size(F.filter(words(F.col("text")), lambda w: w != "")).cast("long").alias("n_words"))
    joined = counted.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    sorted_ = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    return joined.select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"), sorted_(F.col("base")).alias("base_labels"), sorted_(F.col("every")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
