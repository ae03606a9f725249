"""License scan: phrases, and an exact set-similarity join with license templates.

Phrases are found as consecutive words.  For the join text blocks and templates
are sets of words; a block matches a template when it contains at least
`threshold` hundredths of the template's words.  Blocks are the lines of a text,
and, for notices that are wrapped, windows of consecutive words: a template of m
words in a row meets windows of the least power of two that is 2 m or more (16 at
least), which overlap by half, so any m words in a row lie in one of them.

The join is the prefix filtering kind: template words are ordered by the number of
documents that hold them, rarest first; a matching block must hold a word of the
template's prefix, must hold enough template words at all (length filter), and what
is left behind the first common words must still suffice (positional filter).  The
pairs that pass are verified by their whole intersection.  A text is cut into blocks
only if as a whole it holds enough words of some template; no other can match.

Everything is DataFrame expressions.  The texts are read once: counts, phrases and
the template words of each go to a checkpoint, with the text itself only where it
can match.  The templates are a constant of this module, so what is broadcast has a
fixed size.

Defined cases: null, empty and wordless texts have no words, no labels and score
0; a repeated row is judged by itself; documents with one doc_id and different
texts, and null doc_ids, are kept apart; ties between templates of one label go to
the larger share; an empty table gives no rows; other columns are not carried.
"""

import re

from pyspark.sql import Column, DataFrame, functions as F

from .tables import cut

#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Short notices and the opening paragraphs of public licenses.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2."),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LINE_GAPS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def phrase_places(words: Column, phrases=PHRASES) -> Column:
    """Structs (at, label) of every place where a phrase's words stand consecutively."""
    return F.concat(*(_places(words, phrase.split(" "), label) for phrase, label in phrases))


def _places(words, phrase, label):
    def stands(i):
        return _all(F.get(words, i + k) == w for k, w in enumerate(phrase))

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
    return F.transform(places, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


class Templates:
    """Templates as word sets, how many words a match needs, and the windows that each meets."""

    def __init__(self, templates, threshold):
        self.rows = []
        for label, text in templates:
            words = re.findall(_WORD, text.lower())
            held = frozenset(words)
            self.rows.append((label, held, -(-threshold * len(held) // 100), max(16, 1 << (2 * len(words) - 1).bit_length())))
        self.vocabulary = sorted(frozenset().union(*(r[1] for r in self.rows)))
        self.least = min(r[2] for r in self.rows)

    def windows(self, held: Column) -> Column:
        """The window sizes of the templates that a text with these template words can match; null for the others."""
        sizes = [F.when(F.size(F.array_intersect(held, _strings(words))) >= need, size) for _, words, need, size in self.rows]
        return F.array_distinct(F.array_compact(F.array(*sizes)))

    def prefixes(self, counts: dict[str, int]):
        """Rank of each word, and (size, word, template, label, position, need, words by rank) of each prefix word; size 0 are lines."""
        rank = {w: k for k, w in enumerate(sorted(self.vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        out = []
        for i, (label, words, need, size) in enumerate(self.rows):
            ordered = sorted(words, key=rank.__getitem__)
            for position, word in enumerate(ordered[: len(words) - need + 1]):
                out.extend((s, word, i, label, position, need, ordered) for s in (0, size))
        return rank, out


def _strings(words):
    return F.array(*(F.lit(w) for w in sorted(words)))


def read_texts(docs: DataFrame, templates: Templates) -> DataFrame:
    """One row per row of docs (doc, key, body): n_words, places, held (template words), windows, and lines of a text that can match."""
    lined = F.regexp_replace(_lower(F.col("body")), _LINE_GAPS, " ")
    rows = docs.select("doc", "key", lined.alias("lined"))
    rows = rows.select("*", F.trim(F.regexp_replace("lined", r"[ \n]+", " ")).alias("plain"))
    some = _any(F.contains(F.col("plain"), F.lit(p)) for p, _ in PHRASES)
    nothing = F.array().cast("array<struct<at:bigint,label:string>>")
    # The words are bound once: an expression inside a lambda is evaluated at every step.
    seen = lambda words: F.struct(F.when(some, phrase_places(words)).otherwise(nothing).alias("places"), F.array_intersect(words, _strings(templates.vocabulary)).alias("held"))
    bound = F.get(F.transform(F.array(F.split("plain", " ")), seen), 0)
    n_words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.translate("plain", " ", "")) + 1).cast("long")
    rows = rows.select("doc", "key", n_words.alias("n_words"), bound.alias("b"), "lined").select("doc", "key", "n_words", "b.places", "b.held", "lined")
    windows = F.when(F.size("held") >= templates.least, templates.windows(F.col("held"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("windows", windows)
    return cut(rows.withColumn("lined", F.when(F.size("windows") > 0, F.col("lined"))))


def text_blocks(read: DataFrame, templates: Templates) -> DataFrame:
    """(doc, key, size, words): the template words of the lines (size 0) and windows of the texts that can match."""
    known = _strings(templates.vocabulary)
    block = lambda size, words: F.struct(size.alias("size"), F.array_intersect(words, known).alias("words"))
    lines = F.transform(F.split("lined", "\n"), lambda line: block(F.lit(0), F.split(line, " ")))

    def of_words(words):
        starts = lambda size: F.sequence(F.lit(0), F.size(words) - 1, (size / 2).cast("int"))
        return F.flatten(F.transform("windows", lambda size: F.transform(starts(size), lambda at: block(size, F.slice(words, at + 1, size)))))

    words = F.split(F.trim(F.regexp_replace("lined", r"[ \n]+", " ")), " ")
    windows = F.get(F.transform(F.array(words), of_words), 0)
    made = read.filter(F.size("windows") > 0).select("doc", "key", F.explode(F.concat(lines, windows)).alias("b")).select("doc", "key", "b.size", "b.words")
    # Length filter: a block with fewer template words than the smallest template needs matches none.
    return made.filter(F.size("words") >= templates.least)


def template_matches(read: DataFrame, templates: Templates) -> DataFrame:
    """(doc, key, label, contained): templates met by a block of the text, and the largest share contained."""
    counts = {r.word: r["count"] for r in read.select(F.explode("held").alias("word")).groupBy("word").count().collect()}  # one row a template word
    rank, rows = templates.prefixes({w: n for w, n in counts.items() if w})
    prefixes = F.broadcast(read.sparkSession.createDataFrame(rows, "size int, word string, template int, label string, t_at int, need int, t_words array<string>"))
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    ordered = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(ranks, w).alias("r"), w.alias("w")))), lambda x: x["w"])
    blocks = text_blocks(read, templates).select("doc", "key", "size", ordered.alias("b_words"))
    pairs = blocks.select("doc", "key", "size", "b_words", F.posexplode("b_words").alias("b_at", "word")).join(prefixes, ["size", "word"])
    # Positional filter, for a pair's first common word: it and all behind it must suffice.
    behind = F.least(F.size("t_words") - F.col("t_at"), F.size("b_words") - F.col("b_at"))
    first = F.slice("t_words", 1, F.col("t_at"))
    pairs = pairs.filter((behind >= F.col("need")) & ~F.arrays_overlap(first, "b_words"))
    share = F.size(F.array_intersect("t_words", "b_words"))
    met = pairs.select("doc", "key", "label", "need", share.alias("shared"), F.size("t_words").alias("n")).filter(F.col("shared") >= F.col("need"))
    return met.groupBy("doc", "key", "label").agg(F.max(F.col("shared") / F.col("n")).alias("contained"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 92, templates=TEMPLATES) -> DataFrame:
    """One row per document row: words, phrase places, labels of phrases and of templates, score (1, or the largest share contained)."""
    chosen = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    known = Templates(templates, threshold)
    read = read_texts(chosen, known)
    met = template_matches(read, known).groupBy(F.col("doc").alias("m_doc"), F.col("key").alias("m_key")).agg(F.collect_set("label").alias("more"), F.max("contained").alias("contained"))
    out = read.drop("lined", "held", "windows").join(met, F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("key") == F.col("m_key")), "left")
    own = F.array_distinct(F.transform("places", lambda p: p["label"]))
    starts = F.transform("places", lambda p: p["at"])
    return out.select(
        F.col("doc").alias(doc_id),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def _any(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out
