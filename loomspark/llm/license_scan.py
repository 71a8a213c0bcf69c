"""License scans by diagonal voting [native].

A text is read and split once. Its words' rolling 2-grams are hashed and joined
to the template's positions (fixed texts below, so the broadcast side is
bounded by this file); each hit's words are compared with the template's, so no
collision counts. A hit at word p on template position t lies on diagonal
p - t. Votes are aggregated by row, template and diagonal, as a bit for each
template position. Around each diagonal those at most ``slack`` away are merged,
so that inserted or missing words don't part a span; what is merged lies within
the template's length and ``slack`` words on either side, however many
diagonals there are in a row. A span counts if its diagonals together hold
``min_share`` of the template's 2-grams, none of the spans of that template that
it could overlap holds more (of equal ones the first), and no other template
fits there with a larger share (of equal ones the longer). Short phrases must
stand word for word: all their 2-grams on one diagonal.

Only DataFrame functions run. Nulls are empty texts; a document without words
or hits has counts of zero and no label. Long texts are read whole. Every row
gets its own result, equal rows equal ones; columns of any name may be there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm._common import materialise

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening or typical sentences of licenses, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]

#: Bytes that are no part of a word: ASCII but for digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, NOT_WORD), "")


def grams(rows: DataFrame, words: Column, keep: list[str]) -> DataFrame:
    """keep, p, one, two, gram: each word with the one behind it, and the hash of both; the last word has none, a row without words gets one row. No step is interpreted."""
    pairs = rows.select(*keep, words.alias("one")).select(*keep, "one", F.slice("one", F.lit(2), F.size("one") + 1).alias("two"))
    pairs = pairs.select(*keep, F.posexplode_outer(F.arrays_zip("one", "two")).alias("p", "g")).select(*keep, "p", "g.one", "g.two")
    return pairs.withColumn("gram", F.xxhash64("one", "two"))


def templates(spark: SparkSession) -> DataFrame:
    """template, label, phrase (must stand word for word), size (words), t (position), gram, _one, _two"""
    rows = [(i, label, True, text, len(text.split())) for i, (text, label) in enumerate(PHRASES.items())]
    rows += [(len(PHRASES) + i, label, False, text, len(text.split())) for i, (label, text) in enumerate(TEMPLATES)]
    df = spark.createDataFrame(rows, "template int, label string, phrase boolean, body string, size int")
    out = grams(df, F.split("body", " "), ["template", "label", "phrase", "size"]).where("two IS NOT NULL")
    return out.withColumnsRenamed({"p": "t", "one": "_one", "two": "_two"})


def hits(docs: DataFrame) -> DataFrame:
    """uid (of the row), doc_id, n_words, p, template, label, phrase, size, t: verified hits, and a row without template for each document."""
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    base = base.withColumn("n_words", F.size("words").cast("long"))
    at = grams(base, F.col("words"), ["uid", "doc_id", "n_words"])
    found = at.join(F.broadcast(templates(docs.sparkSession)), "gram", "left")  # as many rows as this file has template words
    same = (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    return found.where(same | (F.coalesce("p", F.lit(0)) == 0)).select("uid", "doc_id", "n_words", "p", *[F.when(same, F.col(c)).alias(c) for c in ("template", "label", "phrase", "size", "t")])


def spans(found: DataFrame, min_share: float = 0.7, slack: int = 2) -> DataFrame:
    """uid, template, label, phrase, start (word), end, share (of the template's 2-grams) of each span, from ``hits`` (written)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t"))
    votes = found.where("template IS NOT NULL").groupBy("uid", "template", "label", "phrase", "size", (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.bit_or(bit).alias("held"), F.min("p").alias("low"), F.max("p").alias("high")
    )
    of_phrases = votes.where(F.col("phrase") & (F.bit_count("held") == F.col("size") - 1))
    near = W.partitionBy("uid", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = votes.where(~F.col("phrase")).select(
        "uid", "template", "label", "phrase", "diagonal", "size", F.bit_count(F.bit_or("held").over(near)).alias("votes"), F.min("low").over(near).alias("start"), F.max("high").over(near).alias("high")
    )
    merged = merged.withColumn("share", F.col("votes") / (F.col("size") - 1)).where(F.col("share") >= min_share)
    # spans of a template overlap if their diagonals are less than its size apart (here, not over 1); other templates fit the same words if theirs are near
    own = W.partitionBy("uid", "template").orderBy(2 * F.col("diagonal") / (2 * F.col("size") - 1)).rangeBetween(-1, 1)
    others = W.partitionBy("uid").orderBy("diagonal").rangeBetween(-slack, slack)
    rank, among = F.struct(F.col("votes"), -F.col("diagonal")), F.struct("share", "votes", -F.col("template"))
    merged = merged.withColumns({"first": rank == F.max(rank).over(own), "fits": among == F.max(among).over(others)}).where("first AND fits")
    columns = ["uid", "template", "label", "phrase"]
    return of_phrases.select(*columns, F.col("low").alias("start"), (F.col("high") + 2).alias("end"), F.lit(1.0).alias("share")).union(
        merged.select(*columns, "start", (F.col("high") + 2).alias("end"), "share")
    )


def scan(docs: DataFrame, min_share: float = 0.7, slack: int = 2) -> DataFrame:
    """A row for each span found: uid (of the row), doc_id, template, label, phrase, start (word), end, share."""
    found = materialise(hits(docs), "hits")
    ids = found.where("coalesce(p, 0) = 0").select("uid", "doc_id").distinct()
    return spans(found, min_share, slack).join(ids, "uid").select("uid", "doc_id", "template", "label", "phrase", "start", "end", "share")


def license_report(docs: DataFrame, min_share: float = 0.7, slack: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans of every row."""
    found = materialise(hits(docs), "hits")
    rows = found.where("coalesce(p, 0) = 0").select("uid", "doc_id", "n_words")
    each = rows.unionByName(spans(found, min_share, slack), allowMissingColumns=True)
    base = lambda x: F.when(F.col("phrase"), F.col(x))
    out = each.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(base("start")).alias("n_base"),
        F.min(base("start")).cast("long").alias("first_word"), F.max(base("start")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base("label"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.count("template").alias("n_spans"),
    )
    return out.drop("uid")


assert max(len(t.split()) for _, t in TEMPLATES) <= 64  # a bit for each 2-gram
assert all(re.fullmatch("[a-z0-9 ]+", x) for x in [*PHRASES, *[t for _, t in TEMPLATES]])
