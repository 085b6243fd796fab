"""License scan: an exact set-similarity join of text blocks with templates.

A block is any run of consecutive words of a text, wherever its lines end, that
is as long as the template and a quarter (for comment markers and the like), as
its set of words; a block meets a template when it holds at least ``threshold``
of the template's different words. Words far apart therefore meet none, and a
notice of a few words must stand together.

Texts are cut into pieces of ``PIECE`` words that overlap by the longest block,
so that every block lies in one piece and no row grows with a text. Pieces are
joined first, as sets, since a piece holds whatever its blocks hold: words are
ordered by their count over the whole corpus, rarest first. A template of n
words that needs o of them is indexed under its n - o + 1 rarest words only
(prefix), a piece needs at least o words of the templates' vocabulary (length),
and the first shared word must leave room for o shared words behind it on both
sides (position). What is left is verified exactly, block by block.

All of it is DataFrame work. The vocabulary of the templates is a parameter of
a few hundred words; the driver sees only their counts. Texts without a prefix
word of any template never leave their scan task.

Beside the join, the places where the words of a fixed phrase stand one after
another give base labels.

Defined cases: null text is empty; texts of any length are scanned whole; equal
scores need no order (all labels are returned, sorted); rows that repeat, null
ids and equal texts get the same labels each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.quality import let
from faultline.session import materialize

#: Words: runs of ASCII letters and digits and of everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Share of a template's words that a block must hold.
THRESHOLD = 0.9
#: Words of a piece, without its overlap.
PIECE = 256
#: Label and text of each template: public licence notices (fixed values).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the software without restriction."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with "
               "the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]


def template_words(text: str) -> list[str]:
    """Distinct words of a template, lower-cased A-Z."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)))


def needed(words: int, threshold: float) -> int:
    """Fewest shared words that reach the threshold."""
    return math.ceil(threshold * words - 1e-9)


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def _phrase_places(w: Column, parts: list[str], label: str) -> Column:
    """Where the words ``parts`` stand in the words ``w``; the last one is looked for first."""
    n = len(parts)

    def whole(i: Column) -> Column:
        return reduce(and_, [F.coalesce(F.get(w, i - k) == parts[n - 1 - k], F.lit(False)) for k in range(n)])

    return F.transform(F.filter(F.sequence(F.lit(0), F.size(w) - 1), whole), lambda i: F.struct(
        (i - (n - 1)).cast("long").alias("at"), F.lit(label).alias("label")))


def _places(text: Column) -> Column:
    """Array of (at, label): starts of the base phrases, counted in words."""
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    ends = "|".join(sorted({p.split()[-1] for p in PHRASES}))
    found = let(_words(_lower_ascii(text)), lambda w: F.when(F.size(w) > 0, F.concat(
        *[_phrase_places(w, p.split(), label) for p, label in PHRASES.items()])).otherwise(none))
    return F.when(text.rlike(f"(?i){ends}"), found).otherwise(none)


def word_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The vocabulary by its count over all texts, rarest first (ties by word)."""
    counted = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("word")) \
        .filter(F.col("word").isin(vocabulary)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = {r["word"]: r["n"] for r in counted.collect()}  # a row per word of the templates at most
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def block_words(text: str) -> int:
    """Words of a block that is held against the template ``text``."""
    n = len(re.findall(WORD, text))
    return n + n // 4


def pieces(docs: DataFrame, text_col: str, prefix_words: list[str], overlap: int) -> DataFrame:
    """(other columns, words) of the pieces that hold a prefix word."""
    keys = [c for c in docs.columns if c != text_col]
    # a text without any prefix word meets no template: it is dropped where it was read
    near = docs.filter(F.col(text_col).rlike(r"(?i)(?<![0-9a-z\x{80}-\x{10FFFF}])(?:" + "|".join(map(re.escape, prefix_words))
                                             + r")(?![0-9a-z\x{80}-\x{10FFFF}])"))
    prefix = F.array(*map(F.lit, prefix_words))
    cut = let(_words(_lower_ascii(F.col(text_col))), lambda w: F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(PIECE)),
                    lambda i: F.slice(w, i + 1, PIECE + overlap)),
        lambda piece: F.arrays_overlap(piece, prefix)))
    return near.select(*keys, F.explode(cut).alias("words"))


def _most_shared(words: Column, own: Column, span: Column) -> Column:
    """Most words of ``own`` in any ``span`` consecutive words."""
    at = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(own, x["w"]))
    return let(at, lambda p: F.array_max(F.transform(p, lambda x, k: F.size(F.array_distinct(F.transform(
        F.filter(F.slice(p, k + 1, span), lambda y: y["i"] < x["i"] + span), lambda y: y["w"]))))))


def matching_blocks(docs: DataFrame, text_col: str, templates: list[tuple[str, str]], order: list[str], threshold: float) -> DataFrame:
    """(other columns, label, score) of every text and template that meet."""
    spark = docs.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    sides, index = [], []
    for t, (label, text) in enumerate(templates):
        own = sorted(template_words(text), key=rank.__getitem__)
        need = needed(len(own), threshold)
        sides.append((t, label, own, block_words(text)))
        index += [(rank[own[i]], i, t, len(own), need) for i in range(len(own) - need + 1)]
    keys = [c for c in docs.columns if c != text_col]
    postings = F.broadcast(spark.createDataFrame(index, "r int, i int, template int, n int, need int"))
    sizes = F.broadcast(spark.createDataFrame(sides, "template int, label string, own array<string>, span int"))
    cut = pieces(docs, text_col, sorted({order[r] for r, *_ in index}), max(block_words(text) for _, text in templates) - 1)
    # the piece's words of the vocabulary, rarest first
    vocabulary = F.array(*map(F.lit, order))
    ranks = F.transform(F.array_intersect(vocabulary, F.col("words")), lambda w: (F.array_position(vocabulary, w) - 1).cast("int"))
    probes = cut.withColumn("piece", ranks).select(*keys, "words", "piece", F.posexplode("piece").alias("j", "r"))
    first = probes.join(postings, "r").filter(F.size("piece") >= F.col("need")) \
        .filter(F.least(F.col("n") - F.col("i"), F.size("piece") - F.col("j")) >= F.col("need"))
    pairs = first.join(sizes, "template") \
        .filter(F.size(F.array_intersect("words", "own")) >= F.col("need")) \
        .withColumn("shared", _most_shared(F.col("words"), F.col("own"), F.col("span")))
    return pairs.filter(F.col("shared") >= F.col("need")).select(*keys, "label", (F.col("shared") / F.col("n")).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_words, places (array of (at, label)), labels
    (those of the join, sorted) and score (highest containment, 0 without any)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    # rows with the same id and text get the same labels, so these two identify what is joined back
    key = [F.col("id"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]
    order = word_order(base, "text", sorted({w for _, t in templates for w in template_words(t)}))
    found = matching_blocks(base.select(*key, "text"), "text", templates, order, threshold)
    labels = found.groupBy("id", "h1", "h2").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.max("score").alias("score"))
    counts = base.select(*key, F.size(_words(F.col("text"))).cast("long").alias("n_words"), _places(F.col("text")).alias("places"))
    labels = materialize(labels).withColumnsRenamed({c: f"_{c}" for c in ("id", "h1", "h2")})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    return counts.join(labels, same, "left").select(
        "id", "n_words", "places", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
