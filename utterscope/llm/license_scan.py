"""License scan: base phrases, and an exact containment join with license templates; no Python on the executors.

A text block is a window of consecutive words. A block meets a template when it holds at least
``threshold`` of the template's distinct words. The join finds all such pairs:

- Words are ordered by the number of documents that hold them, counted over all documents, rare ones first.
- Prefix filter: a block that meets a template of n words with at least o of them holds one of the
  first n - o + 1 of these words. Documents without any such word are left out before they are cut
  into blocks, and only prefix words are joined.
- Length filter: the block must have at least o words that occur in templates at all.
- Positional filter: from the first common word on, both sides must have enough words left.

Two things are found as runs of words in the whole text instead: templates of fewer than ``LEAST_WORDS``
distinct words, which a block could hold scattered, and templates whose threshold forgives no word,
with one word missing or replaced that is not among ``REQUIRED``. With one such word at most, the first
or the second half of the run is intact, so all texts without either are passed over.

Templates are a constant of the program, so their table, the vocabulary and its counts are bounded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import lower_ascii, save

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices of well-known licenses and the label of each.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software"),
    ("mit", "The Software is provided as is, without warranty of any kind, express or implied, including but not "
            "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors "
             "be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
                  "modify, publish, use, compile, sell, or distribute this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                 "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                 "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the "
              "GNU General Public License as published by the Free Software Foundation, version 3"),
    ("lgpl-3", "Licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
               "Lesser General Public License as published by the Free Software Foundation; either version 3"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("agpl-3", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
            "promote products derived from this software without specific prior written permission"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
              "License 2.0"),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright "
            "and related or neighboring rights to this work"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
]
THRESHOLD = 0.95
#: Words that tell a license from others; of these none may be missing or replaced.
REQUIRED = {
    "mit": ("mit",),
    "apache-2": ("apache", "2"),
    "gpl-3": ("gnu", "general", "3"),
    "lgpl-3": ("gnu", "lesser", "3"),
    "agpl-3": ("gnu", "affero", "3"),
    "mpl-2": ("mozilla", "2"),
    "epl-2": ("eclipse", "2"),
    "cc-by-nc": ("cc", "by", "nc", "creative", "commons", "attribution", "noncommercial"),
    "cc-by-sa": ("creative", "commons", "attribution", "sharealike"),
    "all-rights-reserved": ("all", "rights", "reserved"),
}
#: Templates of fewer distinct words are matched as a run only.
LEAST_WORDS = 5
#: Words of a block and the distance of block starts: every run of up to 64 words lies in one block.
BLOCK, STEP = 128, 64


def normal(text: Column) -> Column:
    """The words of a text, joined by single blanks."""
    bare = F.regexp_replace(
        lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "
    )
    return F.btrim(bare)


def _words(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _count(joined: Column) -> Column:
    bare = F.btrim(joined)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " ")))


def _phrase_words(phrase: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in phrase.lower()).split()


def _template_words(phrase: str) -> list[str]:
    return list(dict.fromkeys(_phrase_words(phrase)))


def _need(words: list[str], threshold: float) -> int:
    return math.ceil(threshold * len(words) - 1e-9)


def _runs(padded: Column, threshold: float) -> list[Column]:
    """Label and containment of each template that ``padded`` holds as a run of words, else null."""
    out = []
    for label, phrase in TEMPLATES:
        run, distinct = _phrase_words(phrase), _template_words(phrase)
        if len(distinct) < LEAST_WORDS:
            hit, containment = F.contains(padded, F.lit(f" {' '.join(run)} ")), 1.0
        elif _need(distinct, threshold) == len(distinct):
            half = len(run) // 2
            intact = F.contains(padded, F.lit(f" {' '.join(run[:half])} ")) | F.contains(
                padded, F.lit(f" {' '.join(run[half:])} ")
            )
            variants = []
            for i, word in enumerate(run):
                if word not in REQUIRED.get(label, ()):
                    other = "(?:[^ ]+ )?" if 0 < i < len(run) - 1 else ""
                    before, after = ("".join(f"{w} " for w in part) for part in (run[:i], run[i + 1 :]))
                    variants.append(f"{before}{other}{after}")
            hit, containment = intact & F.rlike(padded, F.lit(f" (?:{'|'.join(variants)})")), 1 - 1 / len(distinct)
        else:
            continue
        out.append(F.when(hit, F.struct(F.lit(label).alias("label"), F.lit(containment).alias("containment"))))
    return out


def word_order(documents: DataFrame, text_column: str = "text") -> list[str]:
    """All template words, the one in fewest documents first, ties by the word."""
    vocabulary = sorted({w for _, phrase in TEMPLATES for w in _template_words(phrase)})
    held = F.array_intersect(F.array(*map(F.lit, vocabulary)), _words(normal(F.col(text_column))))
    counts = documents.select(F.explode(held).alias("word")).groupBy("word").count()
    found = {row["word"]: row["count"] for row in counts.collect()}  # one row per template word at most
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def scan_licenses(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits, A to Z in lower case, and of characters beyond ASCII.
    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are their
    smallest and largest starts, null without any. ``labels`` adds those of the templates that any
    block meets or that the text holds as a run, with one word missing or replaced where the threshold
    forgives none. ``score`` is 1 with a base phrase, else the largest containment of a template that is
    met, else 0. A null, empty or wordless text has no words, no labels and score 0. Repeated rows give
    repeated results; an empty table gives none. Other columns are not read.
    """
    order = word_order(documents, text_column)
    rank = {word: i for i, word in enumerate(order)}
    prefixes, templates = [], []
    for number, (label, phrase) in enumerate(TEMPLATES):
        words = sorted(_template_words(phrase), key=rank.get)
        if len(words) < LEAST_WORDS:
            continue
        need = _need(words, threshold)
        templates.append((number, label, words, need))
        prefixes += [(w, number, at) for at, w in enumerate(words[: len(words) - need + 1])]
    prefix_words = sorted({w for w, _, _ in prefixes})
    fewest = min(need for *_, need in templates)

    joined = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("doc_id"),
        normal(F.col(text_column)).alias("joined"),
    )
    joined = joined.withColumn("padded", F.concat(F.lit(" "), F.col("joined"), F.lit(" ")))
    padded = F.col("padded")
    found = []
    for phrase, label in BASE.items():
        # The look-ahead leaves the phrase in place, so phrases may follow each other directly.
        parts = F.split(padded, f" (?={phrase} )", -1)
        first = _count(F.element_at(parts, 1))
        last = F.col("n_words") - _count(F.element_at(parts, -1))
        found.append(
            F.when(
                F.contains(padded, F.lit(f" {phrase} ")),
                F.struct(
                    F.lit(label).alias("label"),
                    (F.size(parts) - 1).cast("long").alias("places"),
                    first.cast("long").alias("first"),
                    last.cast("long").alias("last"),
                ),
            )
        )
    starts = F.sequence(F.lit(1), F.greatest(F.col("n_words").cast("int"), F.lit(1)), F.lit(STEP))
    ordered, prefix = F.array(*map(F.lit, order)), F.array(*map(F.lit, prefix_words))
    blocks = F.when(
        F.arrays_overlap("words", prefix),
        F.filter(
            F.transform(starts, lambda at: F.array_intersect(ordered, F.slice("words", at, BLOCK))),
            lambda tokens: (F.size(tokens) >= fewest) & F.arrays_overlap(tokens, prefix),
        ),
    )
    scan = save(
        joined.withColumn("words", _words(F.col("joined")))
        .withColumn("n_words", F.size("words").cast("long"))
        .select(
            "row",
            "doc_id",
            "n_words",
            F.filter(F.array(*found), lambda hit: hit.isNotNull()).alias("base"),
            F.filter(F.array(*_runs(padded, threshold)), lambda hit: hit.isNotNull()).alias("runs"),
            blocks.alias("blocks"),
        ),
        "license-scan",
    )

    spark = documents.sparkSession
    prefix_table = spark.createDataFrame(prefixes, "word string, template int, at int")
    template_table = spark.createDataFrame(templates, "template int, label string, words array<string>, need int")
    block = scan.select("row", F.posexplode("blocks").alias("block", "tokens"))
    probes = block.select("row", "block", "tokens", F.posexplode("tokens").alias("block_at", "word"))
    left = F.least(
        F.size("words") - F.col("at"), F.size("tokens") - F.col("block_at")
    )  # common words from this one on, at most
    met = (
        probes.join(F.broadcast(prefix_table), "word")
        .join(F.broadcast(template_table), "template")
        .where((F.size("tokens") >= F.col("need")) & (left >= F.col("need")))
        .withColumn("common", F.size(F.array_intersect("tokens", "words")))
        .where(F.col("common") >= F.col("need"))
        .groupBy("row")
        .agg(
            F.collect_set("label").alias("met"),
            F.max(F.col("common") / F.size("words")).alias("containment"),
        )
    )
    run_labels = F.transform("runs", lambda hit: hit["label"])
    run_best = F.coalesce(F.array_max(F.transform("runs", lambda hit: hit["containment"])), F.lit(0.0))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda hit: hit["label"])))
    total = F.aggregate("base", F.lit(0).cast("long"), lambda n, hit: n + hit["places"])
    return scan.drop("blocks").join(met, "row", "left").select(
        "doc_id",
        "n_words",
        total.alias("n_base"),
        F.array_min(F.transform("base", lambda hit: hit["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda hit: hit["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(
            F.array_sort(
                F.array_union(
                    F.array_union(base_labels, run_labels), F.coalesce("met", F.array().cast("array<string>"))
                )
            ),
            ",",
        ).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0))
        .otherwise(F.greatest(F.coalesce("containment", F.lit(0.0)), run_best))
        .alias("score"),
    )
