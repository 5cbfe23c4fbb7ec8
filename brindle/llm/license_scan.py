"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A template is a set of words. Blocks are windows of a document's words, twice as long as the template's class of length and
half overlapping, so that each stretch of the template's length lies whole in one. A block holds a template when it has at least
`percent` of the template's distinct words. The join finds all such pairs:

* words are in one global order, from the one in the fewest documents of the corpus, ties by the word;
* prefix filter: a template of n words of which `need` have to be there shares one of its n - need + 1 rarest with each block
  that holds it, so only these are indexed, and texts without any of them are left before anything is joined;
* length filter: a text has at least `need` words that occur in templates;
* positional filter: after the first shared word, both sides must have enough words left to reach `need`;
* pairs that pass are verified on the whole sets.

The join is made with whole documents first, which hold what their blocks hold; in those that pass, blocks with a prefix word
are verified. Words that occur in no template can't count towards containment, so documents are cut down to the templates' words.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_places

#: The characters between words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# License notices, short ones by their full wording and the opening paragraphs of the license texts.
TEMPLATES = (
    ("afl-3.0", "Licensed under the Academic Free License version 3.0"),
    ("agpl-3.0", "GNU Affero General Public License version 3"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("gpl-2.0", "GNU General Public License version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)

#: Templates, and distinct words of them, that may be sent to every task.
MOST_TEMPLATES, MOST_WORDS = 5_000, 100_000
#: The shortest class of templates, in words.
LEAST_SPAN = 8


class Template(NamedTuple):
    number: int
    label: str
    span: int
    need: int
    words: list[str]


def split_words(text: str) -> list[str]:
    """The words of a template, as words() has them of a column."""
    low = text.translate(str.maketrans(UPPER, LOWER))
    out, word = [], ""
    for c in low:
        if "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f":
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out + ([word] if word else [])


def words(text: Column) -> Column:
    """The words of a text; none of a null or empty one."""
    filled = F.coalesce(text.cast("string"), F.lit(""))
    # the capitals whose lower case is an ASCII letter are not A-Z
    odd = filled.contains("\u0130") | filled.contains("\u212a")
    return F.array_remove(F.split(F.when(odd, F.translate(filled, UPPER, LOWER)).otherwise(F.lower(filled)), GAP), "")


def class_of(n: int) -> int:
    """The least of 8, 16, 32, ... that is no less than n."""
    return max(LEAST_SPAN, 1 << (n - 1).bit_length())


def compiled(templates: tuple[tuple[str, str], ...], percent: int) -> list[Template]:
    """Templates with their distinct words; those without words can be held by nothing and go."""
    if not 0 < percent <= 100:
        raise ValueError("percent is from 1 to 100")
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    out = []
    for number, (label, text) in enumerate(templates):
        found = split_words(text)
        if found:
            own = sorted(set(found))
            out.append(Template(number, label, class_of(len(found)), -(-percent * len(own) // 100), own))
    if len({w for t in out for w in t.words}) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} words in templates")
    return out


def global_order(split: DataFrame, vocabulary: set[str]) -> list[str]:
    """The vocabulary from the word that is in the fewest documents; split has their words as `w`. The vocabulary's size bounds what the driver gets."""
    if not vocabulary:
        return []
    held = split.select(F.explode(F.array_intersect(_texts(sorted(vocabulary)), F.col("w"))).alias("word"))
    known = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (known.get(w, 0), w))


def _texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def held_templates(split: DataFrame, key: str, templates: list[Template], order: list[str]) -> DataFrame:
    """(key, number, label, block, share) of all blocks and templates that they hold; split has a document's words as `w`.

    block: the place of the block's first word in the document. share: of the template's words that are there. A document
    that holds too few of a template's words has no block that holds it, so the join is first made with whole documents as blocks.
    """
    rank = {w: i for i, w in enumerate(order)}
    ordered = {t.number: sorted(t.words, key=rank.__getitem__) for t in templates}
    prefix = {t.number: ordered[t.number][: len(t.words) - t.need + 1] for t in templates}
    index = [(w, t.number, t.label, t.span, t.need, i, ordered[t.number], prefix[t.number]) for t in templates for i, w in enumerate(prefix[t.number])]
    # at most MOST_WORDS words in MOST_TEMPLATES templates
    table = F.broadcast(split.sparkSession.createDataFrame(index, "word string, number int, label string, span int, need int, spot int, words array<string>, prefix array<string>"))
    signs = _texts(sorted({e[0] for e in index}, key=rank.__getitem__))
    known = split.select(key, "w", F.array_intersect(_texts(order), F.col("w")).alias("own")).where(F.arrays_overlap("own", signs))
    probes = known.select("*", F.posexplode("own").alias("at", "word"))
    need, shared = F.col("need"), F.array_intersect("own", "words")
    pairs = probes.join(table, "word").where((F.size("own") >= need) & (F.size("own") - F.col("at") >= need) & (F.size("words") - F.col("spot") >= need))
    # each pair once, at the first word that both have
    likely = pairs.where((F.element_at(shared, 1) == F.col("word")) & (F.size(shared) >= need)).select(key, "w", "number", "label", "span", "need", "words", "prefix")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - F.col("span") - 1), F.col("span"))
    window = lambda s: F.slice("w", s + 1, 2 * F.col("span"))
    signed = F.filter(starts, lambda s: F.arrays_overlap(window(s), F.col("prefix")))
    found = F.filter(F.transform(signed, lambda s: F.struct(s.alias("block"), F.size(F.array_intersect("words", window(s))).alias("held"))), lambda x: x["held"] >= F.col("need"))
    blocks = likely.select(key, "number", "label", F.size("words").alias("n"), F.explode(found).alias("x"))
    return blocks.select(key, "number", "label", "x.block", (F.col("x.held") / F.col("n")).alias("share"))


def _phrase_places(split: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after another."""
    own = phrase.split(" ")
    same = lambda i: reduce(lambda a, b: a & b, (F.coalesce(F.get(split, i + k) == w, F.lit(False)) for k, w in enumerate(own)))
    places = F.filter(F.sequence(F.lit(0), F.size(split) - 1), same)
    none = F.array().cast("array<int>")
    return F.when(reduce(lambda a, b: a & b, (F.array_contains(split, w) for w in own)), places).otherwise(none)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of docs.

    n_base: places of phrases, first_word and last_word the least and the greatest of their starts, null without any.
    base_labels: those of the phrases found; labels: with those of the templates that a block holds. score: 1 with a phrase,
    else the largest share of a template that a block holds, 0 without one.

    A null or empty text has no words and no labels. Rows count one by one whatever their ids, so null ids and repeated rows
    all stay; other columns are neither read nor returned, whatever their names. An empty table gives no rows. No templates, or no phrases, find nothing.
    """
    known = compiled(tuple(templates), percent)
    asked = with_places(docs, "__place").select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"), "__place")
    split = asked.select("doc_id", "__place", words(F.col("__text")).alias("w"))

    each = {label: _phrase_places(F.col("w"), phrase) for phrase, label in phrases}
    places = F.concat(*each.values()) if each else F.array().cast("array<int>")
    of_phrases = F.array_compact(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for label, p in each.items()))) if each else F.array().cast("array<string>")
    base = split.select("doc_id", "__place", F.size("w").cast("long").alias("n_words"), places.alias("p"), of_phrases.alias("b"))
    found = held_templates(split, "__place", known, global_order(split, {w for t in known for w in t.words})) if known else None
    if found is None:
        joined = base.withColumns({"l": F.array().cast("array<string>"), "share": F.lit(0.0)})
    else:
        of_document = found.groupBy("__place").agg(F.collect_set("label").alias("l"), F.max("share").alias("share"))
        joined = base.join(of_document, "__place", "left")
    text = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", F.size("p").cast("long").alias("n_base"), F.array_min("p").cast("long").alias("first_word"), F.array_max("p").cast("long").alias("last_word"),
        text(F.col("b")).alias("base_labels"), text(F.concat("b", F.coalesce("l", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("p") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
