"""License scan: phrases, and an exact set-similarity join with license notices.

Phrases are counted where their words stand consecutively. Notices are templates of distinct words. A block of a document
(a line, or the lines between two blank ones) matches a template if it holds at least ``CONTAINMENT`` of the template's
words, however long it is. Template words are ordered by how many documents hold them, the rarest
first: a matching block must hold one of the first |T| - need + 1, so blocks are joined with the templates on those words,
then cut by length and by the position of the shared word, and verified on the whole sets. Templates are a parameter of
bounded size and are broadcast.

Cases: a null text is empty. Repeated rows come back each. An empty table gives none. Blocks are never cut.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.tables import ascii_lower

# fixed values: phrases and labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# fixed values: public notices
TEMPLATES = {
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mit-line": "Released under the MIT License.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
CONTAINMENT = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(r"[^0-9a-z]+", text.lower()) if w})


def _spaces(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(line: Column) -> dict[str, Column]:
    """For a text as `` word word ``: n_words, n_base, first_word, last_word, base_labels (array)."""
    n_words = F.greatest(F.lit(0), _spaces(line) - 1)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        has, size = line.contains(f" {phrase} "), len(phrase.split())
        parts = F.split(line, f" {phrase}(?= )", -1)
        counts.append(F.when(has, F.size(parts) - 1).otherwise(0))
        firsts.append(F.when(has, _spaces(F.get(parts, F.lit(0)))))
        lasts.append(F.when(has, n_words - size - (_spaces(F.element_at(parts, -1)) - 1)))
        labels.append(F.when(has, F.lit(label)))
    return {
        "n_words": n_words.cast("long"),
        "n_base": reduce(lambda a, b: a + b, counts).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base_labels": F.array_compact(F.array(*labels)),
    }


def word_ranks(docs: DataFrame, words: list[str]) -> list[str]:
    """The template words by the number of documents that hold them, the rarest first; one row a word reaches the driver."""
    held = F.array_intersect(F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0)), F.array(*map(F.lit, words)))
    found = {r["w"]: r["n"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (found.get(w, 0), w))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id and the phrase columns, with ``found``: (template, share) of the matching blocks of each row."""
    templates = TEMPLATES if templates is None else templates
    sets = {k: template_words(t) for k, t in templates.items()}
    ranks = word_ranks(docs, sorted({w for ws in sets.values() for w in ws}))
    place = {w: k + 1 for k, w in enumerate(ranks)}
    rows = []
    for name, ws in sets.items():
        order = sorted(place[w] for w in ws)
        need = math.ceil(containment * len(order) - 1e-9)
        rows += [(rank, name, order, need, k) for k, rank in enumerate(order[: len(order) - need + 1])]
    index = docs.sparkSession.createDataFrame(rows, "rank int, template string, words array<int>, need int, place int")
    prefix = sorted({r[0] for r in rows})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", ascii_lower(text).alias("t"))
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace("t", GAP, " ")), F.lit(" "))
    with_line = lower.select("rid", "doc_id", "t", F.when(line == "  ", F.lit(" ")).otherwise(line).alias("line"))
    base = with_line.select("rid", "doc_id", "t", *(c.alias(k) for k, c in phrase_places(F.col("line")).items()))

    ordered = F.array(*map(F.lit, ranks))
    rare = "|".join(ranks[k - 1] for k in prefix)
    holds = rf"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:{rare})(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
    pieces = F.array_union(F.split("t", "\n", -1), F.split("t", r"\n[\x20\t\r]*(?=\n)", -1))
    some = F.filter(pieces, lambda b: b.rlike(holds))

    def described(b: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(b, F.lit(WORD), F.lit(0)))
        held = F.array_sort(F.transform(F.array_intersect(words, ordered), lambda w: F.array_position(ordered, w).cast("int")))
        return F.struct(F.size(words).alias("size"), held.alias("held"))

    blocks = F.when(F.col("t").rlike(holds), F.transform(some, described))
    each = base.withColumn("block", F.explode_outer(blocks)).drop("t").withColumn("rank", F.explode_outer(F.array_intersect("block.held", F.array(*map(F.lit, prefix)))))
    joined = each.join(F.broadcast(index), "rank", "left")
    shared_ahead = F.size(F.filter("block.held", lambda r: r >= F.col("rank")))
    possible = F.col("template").isNotNull() & (F.col("block.size") >= F.col("need"))
    possible = possible & (F.col("place") + F.least(F.size("words") - F.col("place"), shared_ahead) >= F.col("need"))
    both = F.when(possible, F.size(F.array_intersect("block.held", "words")))
    hit = F.when(both >= F.col("need"), F.struct("template", (both / F.size("words")).alias("share")))
    keys = ["rid", "doc_id", "n_words", "n_base", "first_word", "last_word"]
    return joined.select(*keys, "base_labels", hit.alias("hit")).groupBy(*keys).agg(F.first("base_labels").alias("base_labels"), F.collect_set("hit").alias("found")).drop("rid")


def op2_license_scan(docs: DataFrame) -> DataFrame:
    found = licenses(docs)
    labels = F.array_union("base_labels", F.transform("found", lambda f: F.regexp_replace(f["template"], "-line$", "")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)))
    text = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base_labels")).alias("base_labels"), text(labels).alias("labels"), score.alias("score"))
