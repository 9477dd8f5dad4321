"""License scans: phrases, and an exact set-similarity join with license templates.

A block is a window of consecutive words of a text, also across line ends, as a set; for
a template of n words all windows of ``WINDOW`` * n words are blocks, so a notice is found
however its lines are broken, and words scattered over a long line are none.  A block
matches a template if it contains at least ``THRESHOLD`` of the template's words.  Words
are ordered by how many texts hold them, rare ones first.  With ``need`` words to share, a
block must hold one of the first ``size - need + 1`` words of a template (prefix filter),
so only windows around those words' places are looked at; such a surrounding must hold
``need`` words of the template at all (length filter), and those from the place's own word
on, in the global order, must still suffice (positional filter).  What remains is compared
in full, window by window, so nothing is missed.
Templates are a fixed short list, so the order of their words is small at every scale.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.joins import one_per_key

THRESHOLD = 0.85
WINDOW = 2

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Sentences that licenses are stated with, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_OF_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased."""
    return F.array_remove(F.split(_lower(text), _GAPS), "")


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall("[0-9a-z]+", text.lower())))


def _phrase_places(words: str, phrase: str) -> str:
    """SQL: all positions in the array column ``words`` where the phrase stands."""
    parts = phrase.split()
    same = " AND ".join(f"{words}[i + {k}] = '{p}'" for k, p in enumerate(parts))
    return f"filter(IF(size({words}) >= {len(parts)}, sequence(0, size({words}) - {len(parts)}), array()), i -> {same})"


def word_order(docs: DataFrame, words: Sequence[str]) -> list[str]:
    """``words`` by the number of texts of ``docs`` that hold them, ties by themselves."""
    known = F.array(*[F.lit(w) for w in words])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select(F.explode(F.array_intersect(known, words_of(text))).alias("word"))
    # One row for each template word at most comes to the driver.
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def template_hits(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(content, label, containment): the best block of each text for each label matched."""
    sets = [(label, template, template_words(template)) for label, template in templates]
    ordered = word_order(docs, sorted({w for *_, s in sets for w in s}))
    rank = {w: k for k, w in enumerate(ordered)}
    index = []
    for label, template, words in sets:
        words = sorted(words, key=rank.get)
        need = math.ceil(threshold * len(words) - 1e-9)
        width = WINDOW * len(re.findall("[0-9a-z]+", template.lower()))
        index += [(w, label, at, words, need, width) for at, w in enumerate(words[: len(words) - need + 1])]
    spark = docs.sparkSession
    prefixes = spark.createDataFrame(index, "word string, label string, at int, template array<string>, need int, width int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    starts = sorted({w for w, *_ in index})
    # Texts without any prefix word are left out before they are split.
    some = _lower(text).rlike("(?:" + "|".join(map(re.escape, starts)) + ")")
    texts = docs.filter(some).select(F.unhex(F.md5(text)).alias("content"), words_of(text).alias("words"))
    most = max(width for *_, width in index)
    prefix_words = F.array(*[F.lit(w) for w in starts])
    # All words in the widest reach of each place of a prefix word.
    places = texts.withColumn("places", F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(prefix_words, w), i)), lambda i: i.isNotNull()))

    def surrounding(place: Column) -> Column:
        low = F.greatest(place - most + 1, F.lit(0))
        return F.struct(F.element_at("words", place + 1).alias("word"), (place - low).alias("own"), F.slice("words", low + 1, F.lit(2 * most - 1)).alias("near"))

    # Surroundings are cut out before the explode, so that no row carries a whole text.
    probes = places.select("content", F.explode(F.transform("places", surrounding)).alias("probe")).select("content", "probe.*")
    # The index has a row for each prefix word of each template of the fixed list.
    found = probes.join(F.broadcast(prefixes), "word")
    # The windows that hold the place begin at the first word of ``around`` to the place itself.
    begin = F.greatest(F.col("own") - F.col("width") + 1, F.lit(0))
    found = found.select("content", "label", "at", "template", "need", "width", (F.col("own") - begin).alias("last"), F.slice("near", begin + 1, F.col("own") - begin + F.col("width")).alias("around"))
    held = F.array_intersect("template", "around")
    later = F.array_intersect(F.slice("template", F.col("at") + 1, F.size("template")), F.col("around"))
    likely = found.filter((F.size(held) >= F.col("need")) & (F.size(later) >= F.col("need")))
    shared = F.array_max(F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.size(F.array_intersect(F.col("template"), F.slice("around", k + 1, F.col("width"))))))
    hits = likely.withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
    hits = hits.select("content", "label", (F.col("shared") / F.size("template")).alias("containment"))
    return hits.groupBy("content", "label").agg(F.max("containment").alias("containment"))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: words, phrase places, labels and score.

    Columns: doc_id, n_words, n_base (places of phrases), first_word and last_word (their
    smallest and largest start, null without one), base_labels, labels (also those of
    templates) and score: 1 with a phrase, else the largest containment, 0 without any.
    Null is the empty text, which has no words and no labels.  Rows that repeat a text
    get the same answer.  Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.unhex(F.md5(text)).alias("content"),
        F.regexp_count(text, F.lit(_WORD_OF_ANY_CASE)).cast("long").alias("n_words"),
        # All phrases end in one word; texts without it are not split.
        F.when(_lower(text).contains("license"), words_of(text)).alias("words"),
    )
    for k, phrase in enumerate(PHRASES):
        rows = rows.withColumn(f"p{k}", F.expr(f"coalesce({_phrase_places('words', phrase)}, array())"))
    places = F.concat(*[f"p{k}" for k in range(len(PHRASES))])
    named = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    rows = rows.select(
        "doc_id", "content", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), named.alias("base"),
    )
    hits = one_per_key(template_hits(docs, templates, threshold), ["content"], F.collect_set("label").alias("own"), F.max("containment").alias("containment"))
    joined = rows.join(hits, "content", "left")
    both = F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        score.alias("score"),
    )
