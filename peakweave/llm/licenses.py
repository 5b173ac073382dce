"""License scan by diagonal voting over word k-grams, with built-in functions only.

Every rolling 2-word gram of a text is hashed and joined to the gram positions of the templates. A hit
whose next words agree as well, up to the template's own gram length, is a vote for the diagonal
(text position - template position). Votes are counted per diagonal, neighbouring diagonals are merged
(words put in or left out shift the diagonal), and a merged span is verified by the share of the
template that it covers. Votes compare the words themselves, so hash collisions cast none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import ascii_lower, materialise

#: Characters between words: ASCII other than letters and digits.
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BROADCAST_GRAMS = 50_000  #: the templates are broadcast up to so many grams, shuffled beyond


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  #: a phrase counts only where all its words stand consecutively


#: Phrases that count wherever their words stand consecutively.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
#: Opening sentences of public license texts and notices.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc", "licensed under a creative commons attribution 4 0 international license"),
)


def words_of(text: Column) -> Column:
    """Lower-cased words of a text (null: none)."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP, -1), lambda w: w != "")


def _grams(spark: SparkSession, templates: tuple[Template, ...], gram_words: int) -> DataFrame:
    rows = []
    for t, template in enumerate(templates):
        words = template.text.split()
        if len(words) < 2:
            raise ValueError("a template needs two words")
        k = len(words) if template.phrase else min(gram_words, len(words))
        rows += [(t, at, len(words), k, template.phrase, words[at : at + k]) for at in range(len(words) - k + 1)]
    values = ", ".join(f"({t}, {at}, {n}, {k}, {str(p).lower()}, array({', '.join(repr(w) for w in ws)}))" for t, at, n, k, p, ws in rows)
    grams = spark.sql(f"SELECT * FROM VALUES {values} AS g(template, at, template_words, k, phrase, gram)")
    grams = grams.withColumn("key", F.xxhash64(F.col("gram")[0], F.col("gram")[1]))
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams


def scan(
    docs: DataFrame,
    templates: tuple[Template, ...] = PHRASES + NOTICES,
    *,
    text: str = "text",
    ident: str = "doc_id",
    gram_words: int = 4,
    drift: int = 8,
    least_cover: float = 0.7,
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: uid, id, n_words per input row. spans: uid, template, phrase, first, last (word
    positions, from 0), cover (share of the template's words that voted grams cover, 0 to 1).

    Texts are scanned whole; null counts as empty; texts of fewer than two words have no grams. Equal
    rows and repeated identifiers are scanned each on its own (uid tells them apart). An empty table
    gives empty frames; other columns are ignored.
    A phrase is a span where all its words stand consecutively. Other templates: diagonals at most
    drift apart are merged, and the span counts when cover reaches least_cover.
    """
    spark = docs.sparkSession
    words = words_of(F.col(f"`{text}`"))
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{ident}`").alias("id"), words.alias("words"))
    # One pass over the texts: a row per gram and a last one with a null key that carries the word count.
    # The words stay in the generating row, so only what passes the filter copies anything. The result
    # is stored, so the row numbers are generated once.
    keys = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1)))
    keys = F.when(F.size("words") >= 2, F.array_append(keys, F.lit(None).cast("long"))).otherwise(F.array(F.lit(None).cast("long")))
    keyed = numbered.select("uid", "id", "words", keys.alias("keys")).select("uid", "id", "words", F.posexplode("keys").alias("pos", "key"))
    voted = F.slice("words", F.col("pos") + 1, F.col("k")) == F.col("gram")
    hits = keyed.join(_grams(spark, templates, gram_words), "key", "left").where(F.col("key").isNull() | voted)
    hits = materialise(hits.select("uid", "id", F.when(F.col("key").isNull(), F.size("words")).alias("n_words"), "template", "template_words", "phrase", "k", "pos", "at"), "license-votes")
    votes = hits.where("template is not null")
    votes = votes.withColumn("diagonal", F.col("pos") - F.col("at"))
    diagonals = votes.groupBy("uid", "template", "template_words", "phrase", "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k")).alias("stop"), F.collect_set(F.struct("at", "k")).alias("parts")
    )
    # Neighbouring diagonals of notices: a new span starts where the diagonal jumps by more than drift
    # or the text positions part by more than the template is long.
    line = Window.partitionBy("uid", "template").orderBy("first", "diagonal")
    gap = (F.col("diagonal") - F.lag("diagonal").over(line) > drift) | (F.lag("diagonal").over(line) - F.col("diagonal") > drift) | (F.col("first") - F.lag("stop").over(line) > F.col("template_words"))
    runs = diagonals.withColumn("new", F.when(F.col("phrase") | F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_set("parts")), lambda p: F.sequence(p["at"], p["at"] + p["k"] - 1)))))
    spans = runs.groupBy("uid", "template", "template_words", "phrase", "run").agg(F.min("first").alias("first"), (F.max("stop") - 1).alias("last"), covered.alias("covered"))
    spans = spans.withColumn("cover", F.col("covered") / F.col("template_words")).where(F.col("phrase") & (F.col("cover") == 1.0) | ~F.col("phrase") & (F.col("cover") >= least_cover))
    rows = hits.where("template is null").select("uid", "id", F.col("n_words").cast("long").alias("n_words"))
    return rows, spans.select("uid", "template", "phrase", "first", "last", "cover")


def license_report(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, **options) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases; first_word and last_word are the smallest and largest start of
    those. labels holds the labels of phrases and notices; score is the best cover, 0 without a span.
    """
    rows, spans = scan(docs, templates, **options)
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.when(F.col("phrase"), F.col("first"))
    found = spans.withColumn("label", label).groupBy("uid").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("cover").alias("score"),
    )
    out = rows.join(found, "uid", "left")
    return out.select(
        "id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
