"""License scans by diagonal voting: word k-grams of all texts meet the places of license wordings.

All runs of ``K`` words of every text are hashed and joined with the hashes of the wordings' runs.  A hit
at word p of a text and word t of a wording votes for the diagonal p - t: words that stand in a text
as in the wording vote for one diagonal, and a word more or less moves the rest to a diagonal
beside it.  Votes are summed by diagonal, diagonals up to ``GAP`` apart are merged, and a span is
verified by the words it covers: ``COVERED`` of the wording, and half of the text's words between
the span's ends.  Hits are compared as words, not as hashes alone, so covered words are equal words.

Phrases are wordings that must stand complete: the places where a diagonal has every run of the phrase.

All steps are DataFrame operations.  The table of wordings is fixed (some hundred rows), so it is
broadcast; texts pass the join where they are read, and only hits are shuffled, by text and diagonal.
A row is known by the hash of its id and text, so rows that are equal get the same, once.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased.  Null and empty texts have no words and no
labels, and score 0.  An empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 3
GAP = 3
COVERED = 0.6
#: The words before A-Z is lower-cased: the same runs.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases that count by themselves, and their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Wordings of notices, and their labels.
WORDINGS = [
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def wordings() -> list[tuple[int, str, bool, str]]:
    """(number, label, whether it is a phrase, words) of all wordings."""
    return [(k, label, k < len(PHRASES), words) for k, (label, words) in enumerate([*PHRASES, *WORDINGS])]


def _places(spark: SparkSession) -> DataFrame:
    """wording, at, gram and hash of every run of K words of the wordings."""
    rows = [(k, at, " ".join(words.split()[at : at + K])) for k, _, _, words in wordings() for at in range(len(words.split()) - K + 1)]
    return spark.createDataFrame(rows, "wording int, at int, gram string").withColumn("hash", F.xxhash64("gram"))


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, label, phrase, len(words.split())) for k, label, phrase, words in wordings()], "wording int, label string, phrase boolean, length int")


def _key() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def _hits(docs: DataFrame) -> DataFrame:
    """key, wording, diagonal and at: the places of wordings that runs of words meet."""
    # the Kelvin sign alone has an ASCII letter as its lower case; it is no letter k here
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("K"), F.lit("ĸ")))
    words = docs.select(_key().alias("key"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    run = lambda i: F.concat_ws(" ", *[F.get("w", i + k) for k in range(K)])
    grams = words.where(F.size("w") >= K).select("key", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - K), run)).alias("p", "gram"))
    met = grams.withColumn("hash", F.xxhash64("gram")).join(F.broadcast(_places(docs.sparkSession).withColumnRenamed("gram", "same")), "hash").where("gram = same")
    return met.select("key", "wording", (F.col("p") - F.col("at")).alias("diagonal"), "at")


def spans(docs: DataFrame) -> DataFrame:
    """key, label, phrase, first and last word, and covered (share of the wording) of every verified span."""
    seen = _hits(docs).groupBy("key", "wording", "diagonal").agg(F.collect_set("at").alias("seen"))  # as many as a wording has
    rows = seen.join(F.broadcast(_labels(docs.sparkSession)), "wording")
    whole = rows.where(F.col("phrase") & (F.size("seen") == F.col("length") - (K - 1)))
    exact = whole.select("key", "label", "phrase", F.col("diagonal").cast("long").alias("first"), (F.col("diagonal") + F.col("length") - 1).cast("long").alias("last"), F.lit(1.0).alias("covered"))
    # neighbouring diagonals: a gap of more than GAP begins the next span
    votes = rows.where(~F.col("phrase"))
    own = "partition by key, wording order by diagonal"
    votes = votes.withColumn("opens", F.expr(f"coalesce(diagonal - lag(diagonal) over ({own}) > {GAP}, true)")).withColumn("span", F.expr(f"count_if(opens) over ({own})"))
    merged = votes.groupBy("key", "wording", "label", "length", "span").agg(
        F.min(F.col("diagonal") + F.array_min("seen")).alias("first"), F.max(F.col("diagonal") + F.array_max("seen") + (K - 1)).alias("last"), F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"),
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda t: F.sequence(t, t + (K - 1))))))
    checked = merged.withColumn("words", words).where((F.col("words") >= COVERED * F.col("length")) & (2 * F.col("words") >= F.col("last") - F.col("first") + 1))
    return exact.unionByName(checked.select("key", "label", F.lit(False).alias("phrase"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), (F.col("words") / F.col("length")).alias("covered")))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (places of phrases), base_labels, labels and score of every row."""
    base = lambda c: F.when(F.col("phrase"), F.col(c))
    found = spans(docs).groupBy("key").agg(
        F.count(base("first")).alias("n_base"), F.min(base("first")).alias("first_word"), F.max(base("first")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base("label"))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("covered").alias("score"),
    )
    rows = docs.select("doc_id", _key().alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    none = F.lit("")
    return rows.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
