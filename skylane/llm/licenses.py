"""License scans as an exact set-similarity join, in DataFrame operations only.

A text block is a run of as many consecutive words as a template has, over any number of lines. It meets a template when
it holds at least ``threshold`` of the template's distinct words (containment), all words that distinguish it (names
and version numbers) and none that belongs to another license. Words are ordered by their number of uses in all texts,
rarest first. A block that meets the threshold must hold one of the first n - ceil(threshold * n) + 1 words (prefix
filter; where words are required, the rarest of those alone), a match at place i of the order leaves n - i words at most
(positional filter), and no block is longer than its template (length filter). Only blocks around such a word are looked
at, and verified by an exact intersection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm.staging import staged

#: What stands between words; a word holds ASCII lower-case letters and digits and any characters beyond ASCII.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
#: Phrases whose exact places count (the base), with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates of the method (fixed values): label, wording as plain words, words that a block must hold, words that it must not hold.
#: Licenses of one family share sentences; a shared one names the family ("bsd"), the clauses that differ name the license.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission granted software", ""),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2", ""),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache 2", ""),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", "nd sa"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "commons noncommercial", "sharealike noderivatives"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general 3", "lesser affero"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general 2", "lesser affero"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general 3", "lesser affero"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "gnu general 2", "lesser affero"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3", "gnu lesser 3", ""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
    ("cc-by-sa", "licensed under a creative commons attribution share alike 4 0 international license", "commons share alike", "noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "commons sharealike", "noncommercial"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived copyright", ""),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission substantial portions", ""),
    ("isc", "released under the isc license", "isc license", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission fee appear", "documentation"),
    ("bsd", "released under the bsd license", "bsd license", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary", ""),
    ("bsd-2", "in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is", "distribution contributors provided", "neither"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "neither endorse contributors", ""),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising acknowledgement", ""),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", "affero 3", ""),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "affero 3", ""),
    ("lgpl-3", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", "lesser 3", ""),
    ("lgpl-2.1", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license", "lesser 2 1", ""),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse 2", ""),
    ("mpl-2", "licensed under the mozilla public license version 2 0", "mozilla 2", ""),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "commons attribution", "noncommercial sharealike noderivatives share alike"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd", ""),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "commons noncommercial noderivatives", "sharealike"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa", ""),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "commons noncommercial sharealike", "noderivatives"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered domain", ""),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "express warranty authors", ""),
)
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    """Cut at what stands between words: one pass, where collecting matches would copy the text for each of them."""
    return F.array_remove(F.split(text, f"{BETWEEN}+"), "")


def _ordered(words: set[str], frequency: dict[str, int]) -> list[str]:
    return sorted(words, key=lambda w: (frequency.get(w, 0), w))


def prefix_rows(templates: tuple, threshold: float, frequency: dict[str, int]) -> list[tuple]:
    """``(word, template, label, wording, length, need, required, excluded)``: a row for each word around which a block can meet a template."""
    out = []
    for k, (label, wording, required, excluded) in enumerate(templates):
        words, must = _ordered(set(wording.split()), frequency), _ordered(set(required.split()), frequency)
        need = math.ceil(threshold * len(words) - 1e-9)
        prefix = must[:1] or [w for place, w in enumerate(words[: len(words) - need + 1]) if len(words) - place >= need]
        out += [(w, k, label, words, len(wording.split()), need, must, sorted(set(excluded.split()))) for w in prefix]
    return out


def word_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Uses in all texts of the templates' words (a bounded list): partial counts first, a row for each word to the driver."""
    used = words.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("w"))
    return {r.w: r.n for r in used.groupBy("w").agg(F.count("*").alias("n")).collect()}


def matching_blocks(around: DataFrame, keys: list[str], prefix: list[tuple]) -> DataFrame:
    """Templates that some block meets: ``keys, label, similarity``.

    ``around`` holds ``keys, word, at, words``: a prefix word, its place in ``words``, which are those around it as far as
    the longest template with that prefix word reaches.
    """
    schema = "word string, template int, label string, wording array<string>, length int, need int, required array<string>, excluded array<string>"
    table = around.sparkSession.createDataFrame(prefix, schema)  # a few rows for each template of a fixed list, so it is broadcast
    met = around.join(F.broadcast(table), "word")
    first = F.greatest(F.col("at") - F.col("length") + 1, F.lit(0))
    last = F.least("at", F.greatest(F.size("words") - F.col("length"), F.lit(0)))
    shared = F.size(F.array_intersect("wording", "block"))
    holds = (F.size(F.array_intersect("required", "block")) == F.size("required")) & ~F.arrays_overlap("excluded", "block")
    blocks = met.where(first <= last).withColumn("block", F.explode(F.transform(F.sequence(first, last), lambda s: F.slice("words", s + 1, F.col("length")))))
    return blocks.where(holds & (shared >= F.col("need"))).groupBy(*keys, "label").agg(F.max(shared / F.size("wording")).alias("similarity"))


def license_scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: tuple = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licenses named in every text: one row per row of ``docs``.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: places where a phrase's words stand
    consecutively (words counted from 0; null without a place), labels of the phrases, labels of phrases and matching
    blocks (distinct, sorted, comma-joined; empty if none), and the best containment (1 for a phrase, 0 for none). Labels
    of templates that tie are all named. A null text counts as empty. Rows with equal id and text have equal results; a null id is kept. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    keyed = rows.select("doc_id", F.xxhash64("raw").alias("h"), F.length("raw").alias("n"), lower_ascii(F.col("raw")).alias("text"))
    keys = ["doc_id", "h", "n"]
    vocabulary = sorted({w for _, wording, required, _ in templates for w in f"{wording} {required}".split()})
    frequency = word_frequencies(keyed.select(words_of(F.col("text")).alias("words")), vocabulary)
    prefix = prefix_rows(templates, threshold, frequency)
    reaches = {w: max(length for v, _, _, _, length, *_ in prefix if v == w) for w in sorted({row[0] for row in prefix})}
    reach_of = F.create_map(*[F.lit(x) for pair in reaches.items() for x in pair])

    def around(words: Column) -> Column:
        """Each prefix word with the words around it, as far as its longest template reaches."""
        at = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("i")))
        here = F.filter(at, lambda x: x["word"].isin(list(reaches)))
        here = F.transform(here, lambda x: F.struct(x["word"].alias("word"), x["i"].alias("i"), reach_of[x["word"]].alias("reach")))
        here = F.transform(here, lambda x: F.struct(x["word"].alias("word"), x["i"].alias("i"), x["reach"].alias("reach"), F.greatest(x["i"] - x["reach"] + 1, F.lit(0)).alias("low")))
        return F.transform(here, lambda x: F.struct(x["word"].alias("word"), (x["i"] - x["low"]).alias("at"), F.slice(words, x["low"] + 1, x["i"] - x["low"] + x["reach"]).alias("words")))

    flat = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    parts = [phrase.split() for phrase in phrases]

    def places(words: list[str]) -> Column:
        at = lambda i: F.forall(
            F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(words)]), lambda x: F.get("words", i + x["k"]) == x["w"]
        )
        there = F.filter(F.sequence(F.lit(0), F.size("words") - len(words)), lambda i: (F.get("words", i) == words[0]) & at(i))
        return F.when(F.col("flat").contains(f" {' '.join(words)} "), there).otherwise(F.expr("cast(array() as array<int>)"))

    found = (
        keyed.withColumn("words", words_of(F.col("text")))
        .withColumn("flat", flat)
        .select(*keys, F.size("words").cast("long").alias("n_words"), F.array(*[places(p) for p in parts]).alias("places"), around(F.col("words")).alias("around"))
    )
    found = staged(found, "license-places")
    met = matching_blocks(found.select(*keys, F.explode("around").alias("x")).select(*keys, "x.*"), keys, prefix)
    more = met.groupBy(*keys).agg(F.collect_set("label").alias("more"), F.max("similarity").alias("best"))
    joined = found.alias("d").join(more.alias("m"), [F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left")
    every = F.flatten("places")
    base = F.filter(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]), lambda x: x.isNotNull())
    return joined.select(
        "d.doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", F.expr("cast(array() as array<string>)"))))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
