"""License scans by diagonal voting, with DataFrame expressions alone.

Texts are lower-cased (A-Z alone) and cut into words of digits, ASCII letters and non-ASCII characters. Every run of three words
is hashed and joined with the positions of the same run in the templates (a fixed list, broadcast). A hit votes
for its diagonal: the word at which the template would start. Diagonals at most ``DRIFT`` words apart, of one
template and document, are merged, so that a word put in or left out costs a few votes alone.

A *base* phrase counts at each diagonal that has the votes of all its runs, whose words are compared themselves:
there it stands word for word. Other templates count where the merged votes verify the span: ``SHARE`` of
the template's runs are there, in a span about as long as the template.

Null texts have no words; very long ones are scanned whole, their words dealt as rows. Where several templates of one label
verify, the label is given once. Repeated rows are each scanned; null keys are kept; other columns are not carried. An empty table
gives no rows. Shuffled are hits and one row per document, never texts.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

GRAM, DRIFT, SHARE = 3, 3, 0.7

# The phrases that are searched word for word, and their labels.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Opening or telling sentences of public licences, and their labels.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "this work is dedicated to the public domain under the cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def _words(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0))


def _grams(words):
    """A hash for each place of an array of words; the last places, where no whole run starts, match none of length GRAM."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, GRAM)]))


def templates(spark: SparkSession, base=BASE, notices=NOTICES) -> DataFrame:
    """(gram, said, template, label, is_base, place, size): every run of every template; runs of one template may repeat."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [(i, label, is_base, text) for i, (label, text, is_base) in enumerate([*((a, b, True) for a, b in base), *((a, b, False) for a, b in notices)])]
    if any(len(text.split()) < GRAM for *_, text in rows):
        raise ValueError(f"a template has fewer than {GRAM} words")
    values = ", ".join(f"({i}, {quoted(label)}, {str(is_base).lower()}, {quoted(text)})" for i, label, is_base, text in rows)
    t = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, is_base, text)").withColumn("words", F.split("text", " "))
    t = t.withColumn("size", F.size("words") - GRAM + 1)
    t = t.select("template", "label", "is_base", "size", "words", F.posexplode(F.slice(_grams(F.col("words")), F.lit(1), F.col("size"))).alias("place", "gram"))
    return t.select("gram", F.array_join(F.slice("words", F.col("place") + 1, GRAM), " ").alias("said"), "template", "label", "is_base", "place", "size")


def votes(docs: DataFrame, runs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, n_words, template, diagonal, places): the places of a template that voted for a diagonal; each document also has a row without a template."""
    every = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), _words(F.col(text)).alias("words"))
    # The place after the last stands for the document itself, whatever it holds.
    placed = every.select("row", "key", "words", F.posexplode(F.concat(_grams(F.col("words")), F.array(F.lit(0).cast("long")))).alias("at", "gram"))
    known = F.broadcast(runs.unionByName(runs.sparkSession.sql("SELECT 0L AS gram, CAST(NULL AS STRING) AS said, -1 AS template, CAST(NULL AS STRING) AS label, false AS is_base, 0 AS place, 0 AS size")))
    hits = placed.join(known, "gram")
    own = F.array_join(F.slice("words", F.col("at") + 1, GRAM), " ")
    document = (F.col("template") == -1) & (F.col("at") == F.size("words"))
    hits = hits.filter(document | (own == F.col("said")))
    hits = hits.select("row", "key", F.size("words").cast("long").alias("n_words"), "template", "label", "is_base", "size", "place", (F.col("at") - F.col("place")).alias("diagonal"))
    return hits.groupBy("row", "key", "n_words", "template", "label", "is_base", "size", "diagonal").agg(F.collect_set("place").alias("places"))


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """(row, key, n_words, label, is_base, start, share): every verified place of a template; documents have a row of null label each."""
    found = votes(docs, templates(docs.sparkSession, base, notices), key, text)
    by = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT)
    grouped = found.withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by))
    merged = grouped.groupBy("row", "key", "n_words", "template", "label", "is_base", "size", "group").agg(
        F.min("diagonal").cast("long").alias("start"),
        F.max("diagonal").cast("long").alias("last"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"),
    )
    share = F.when(F.col("size") > 0, F.col("n") / F.col("size")).otherwise(0.0)
    span = F.col("last") - F.col("start") <= F.col("size") / 2 + 1
    right = F.when(F.col("is_base"), F.col("n") == F.col("size")).otherwise(span & (share >= SHARE))
    return merged.select("row", "key", "n_words", F.when(right, F.col("label")).alias("label"), "is_base", "start", share.alias("share"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """A row for each document, with its labels: see the module's text for what they mean.

    score: the largest share of a template's runs that lie on one diagonal or neighbouring ones (0 to 1).
    """
    is_base = F.col("is_base") & F.col("label").isNotNull()
    return (
        matches(docs, key, text, base, notices)
        .groupBy("row", F.col("key").alias(key), "n_words")
        .agg(
            F.count(F.when(is_base, 1)).alias("n_base"),
            F.min(F.when(is_base, F.col("start"))).alias("first_word"),
            F.max(F.when(is_base, F.col("start"))).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
        )
        .drop("row")
    )


def sql(base=BASE, notices=NOTICES) -> str:
    """DuckDB SQL for ``scan`` over ``documents``."""
    rows = ", ".join(f"({i}, '{label}', {str(is_base).lower()}, '{said}')" for i, (label, said, is_base) in enumerate([*((a, b, True) for a, b in base), *((a, b, False) for a, b in notices)]))
    return f"""
WITH runs AS (SELECT t, label, is_base, len(w) - 2 AS size, i - 1 AS place, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT t, label, is_base, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT t, label, is_base, string_split(said, ' ') AS w FROM (VALUES {rows}) AS v(t, label, is_base, said)))),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
said AS (SELECT r, i - 1 AS spot, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
votes AS (SELECT r, t, label, is_base, size, spot - place AS diagonal, list(DISTINCT place) AS places FROM said JOIN runs USING (g) GROUP BY ALL),
apart AS (SELECT *, sum(CASE WHEN is_base OR before IS NULL OR diagonal - before > {DRIFT} THEN 1 ELSE 0 END) OVER (PARTITION BY r, t ORDER BY diagonal) AS k
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) AS before FROM votes)),
merged AS (SELECT r, t, label, is_base, size, k, min(diagonal) AS a, max(diagonal) AS b, len(list_distinct(flatten(list(places)))) AS n FROM apart GROUP BY ALL),
judged AS (SELECT *, n / size AS share, CASE WHEN is_base THEN n = size ELSE b - a <= size / 2 + 1 AND n / size >= {SHARE} END AS ok FROM merged)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (WHERE ok AND is_base) AS n_base,
  min(a) FILTER (WHERE ok AND is_base) AS first_word, max(a) FILTER (WHERE ok AND is_base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE ok AND is_base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE ok), '') AS labels,
  coalesce(max(share), 0.0) AS score
FROM d LEFT JOIN judged USING (r) GROUP BY r, doc_id, len(w)
"""
