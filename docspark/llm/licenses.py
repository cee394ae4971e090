"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words with a containment threshold: a block meets it if it holds at least
``ceil(threshold * words)`` of its words. Phrases are templates with threshold 1, which must then stand
word after word in the block. The words of a document are cut into blocks of twice the longest template's
length, one such length apart, so that every stretch of a template's length lies whole in a block, and
each word starts places in just one.

Words are ordered by the number of documents that hold them, the rarest first, counted over the whole
table. Three filters choose the pairs of block and template to verify, without losing one:

* prefix: of ``n`` words ``r`` are required, so one of the ``n - r + 1`` rarest must stand in the block,
  and of the block's own words one that still has the least ``r`` ahead of it;
* length: the block holds at least ``r`` words of the templates;
* position: from the shared word on, both sides have at least ``r`` words left.

What is left is verified: the common words are counted, and kept at their first, so that a pair comes once.

Only DataFrame functions are used. Blocks stay where their document is read; one narrow row a document and
one a match are shuffled. Templates are configuration: they travel as literals and as a broadcast table, in
passes of at most ``MAX_WORDS`` distinct words, so that their size is bounded however many there are.

Defined cases: null and empty texts have no words, zeros, null places and empty labels. Repeated rows give
a row each; equal ids with unlike texts are kept apart. A null id stays null. Extra columns are ignored.
An empty table gives no rows; without templates no document has labels. A text's words are held whole by
one task.
"""

from __future__ import annotations

import math
import re
import string
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
#: Notices as their publishers word them, shortened to the parts that tell them apart.
NOTICES = [
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("mit-release", "Released under the MIT License"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
CONTAINMENT = 0.85
MAX_WORDS = 5_000
#: What stands between words, once A-Z are lower case; a word is a run of anything else.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(column: str):
    return F.translate(F.coalesce(F.col(column).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words_of(column: str):
    return F.array_remove(F.split(lowered(column), BETWEEN, -1), "")


def template(label: str, text: str, threshold: float, phrase: bool) -> dict:
    low = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    words = [w for w in re.split(BETWEEN, low) if w]
    distinct = sorted(set(words))
    return {"label": label, "words": words, "distinct": distinct, "r": max(1, math.ceil(threshold * len(distinct) - 1e-9)), "phrase": phrase}


def templates(phrases=PHRASES, notices=NOTICES, containment: float = CONTAINMENT) -> list[dict]:
    """Templates with at least one word; an empty one can stand nowhere."""
    out = [template(label, text, 1.0, True) for label, text in phrases] + [template(label, text, containment, False) for label, text in notices]
    return [t for t in out if t["words"]]


def passes(found: list[dict], most: int) -> list[list[dict]]:
    """The templates in groups of at most ``most`` distinct words (a longer one is alone)."""
    out: list[list[dict]] = []
    held: set[str] = set()
    for t in found:
        if not out or len(held | set(t["distinct"])) > most:
            out.append([])
            held = set()
        out[-1].append(t)
        held |= set(t["distinct"])
    return out


def literals(words: list[str]):
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def by_frequency(documents: DataFrame, words: list[str], text_col: str) -> list[str]:
    """``words``, those in the fewest documents first; ties in their own order."""
    held = documents.select(F.explode(F.array_intersect(literals(words), words_of(text_col))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def matches(documents: DataFrame, group: list[dict], length: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text_hash, n_words, block, label, phrase, containment, places): the blocks that meet a template,
    with the places of a phrase, and for each row of ``documents`` one row without a label (block -1)."""
    vocabulary = by_frequency(documents, sorted({w for t in group for w in t["distinct"]}), text_col)
    rank, least = {w: k for k, w in enumerate(vocabulary)}, min((t["r"] for t in group), default=1)
    rows = []
    for t in group:
        ordered = sorted(t["distinct"], key=rank.get)
        same = [F.lit(len(ordered)).alias("n"), F.lit(t["r"]).alias("r"), literals(ordered).alias("own"), literals(t["words"]).alias("whole"), F.lit(t["label"]).alias("label"), F.lit(t["phrase"]).alias("phrase")]
        rows += [F.struct(F.lit(w).alias("word"), F.lit(k).alias("t_at"), *same) for k, w in enumerate(ordered[: len(ordered) - t["r"] + 1])]
    none = F.array().cast("array<struct<word:string,t_at:int,n:int,r:int,own:array<string>,whole:array<string>,label:string,phrase:boolean>>")
    prefix = documents.sparkSession.range(1).select(F.inline(F.array(*rows) if rows else none))

    words = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), words_of(text_col).alias("words")).withColumn("n_words", F.size("words"))
    starts = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(length))).otherwise(F.array().cast("array<int>"))
    none = F.array(F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("words")))
    cut = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, 2 * length).alias("words")))
    blocks = words.select("id", "text_hash", "n_words", F.explode(F.concat(none, cut)).alias("b")).select("id", "text_hash", "n_words", F.col("b.at").alias("block"), F.col("b.words").alias("words"))

    held = blocks.withColumn("held", F.array_intersect(literals(vocabulary), "words")).withColumn("n_held", F.size("held"))
    held = held.where((F.col("block") < 0) | (F.col("n_held") >= least))
    probes = held.select("*", F.posexplode_outer(F.slice("held", 1, F.greatest(F.col("n_held") - (least - 1), F.lit(0)))).alias("b_at", "word"))
    pairs = probes.join(F.broadcast(prefix), "word", "left")
    enough = (F.col("n_held") >= F.col("r")) & (F.least(F.col("n") - F.col("t_at"), F.col("n_held") - F.col("b_at")) >= F.col("r"))
    pairs = pairs.where((F.col("block") < 0) | enough).withColumn("common", F.array_intersect("held", "own"))
    pairs = pairs.where((F.col("block") < 0) | ((F.col("common")[0] == F.col("word")) & (F.size("common") >= F.col("r"))))
    at = F.sequence(F.lit(0), F.least(F.size("words"), F.lit(length)) - 1)
    places = F.when(F.col("phrase"), F.filter(at, lambda k: F.slice("words", k + 1, F.size("whole")) == F.col("whole")))
    found = pairs.select("id", "text_hash", "n_words", "block", "label", "phrase", (F.size("common") / F.col("n")).alias("containment"), F.transform(places, lambda k: k + F.col("block")).alias("places"))
    return found.where((F.col("block") < 0) | ~F.col("phrase") | (F.size("places") > 0))


def license_scan(documents: DataFrame, found: list[dict] | None = None, most_words: int = MAX_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (the largest share of a matching template's words that one block holds; 0 without a match)."""
    found = templates() if found is None else found
    length = max((len(t["words"]) for t in found), default=100)
    groups = passes(found, most_words) or [[]]
    parts = [matches(documents, g, length, text_col, id_col).where(F.lit(k == 0) | (F.col("block") >= 0)) for k, g in enumerate(groups)]
    rows = reduce(DataFrame.unionByName, parts)
    own = rows.groupBy("id", "text_hash", "n_words").agg(
        F.count_if(F.col("block") < 0).alias("copies"),
        F.coalesce(F.sum(F.when(F.col("phrase"), F.size("places"))), F.lit(0)).alias("n_all"),
        F.min(F.array_min("places")).cast("long").alias("first_word"),
        F.max(F.array_max("places")).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"),
        F.coalesce(F.max(F.when(F.col("block") >= 0, F.col("containment"))), F.lit(0.0)).alias("score"),
    )
    each = own.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.expr("n_all div copies").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort("all"), ",").alias("labels"), "score",
    )


def op12(documents: DataFrame) -> DataFrame:
    return license_scan(documents)


def op12_sql() -> str:
    """The scan in plain SQL: every block against every template, every word as the start of every phrase."""
    found = templates()
    length = max(len(t["words"]) for t in found)
    rows = ", ".join(f"('{t['label']}', {t['phrase']}, {t['words']}, {t['r']})" for t in found)
    return rf"""WITH t(label, phrase, whole, r) AS (VALUES {rows}), tt AS (SELECT *, list_distinct(whole) AS own FROM t),
  d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  p AS (SELECT i, label, unnest(list_filter(range(len(w)), lambda k: w[k + 1:k + len(whole)] = whole)) AS pos FROM d, tt WHERE phrase),
  b AS (SELECT i, w[k * {length} + 1:(k + 2) * {length}] AS block FROM (SELECT i, w, unnest(range((len(w) + {length - 1}) // {length})) AS k FROM d)),
  m AS (SELECT i, label, len(list_intersect(list_distinct(block), own)) AS c, r, len(own) AS n FROM b, tt WHERE NOT phrase),
  h AS (SELECT i, label, 1.0::DOUBLE AS share, pos FROM p UNION ALL SELECT i, label, c / n::DOUBLE, NULL FROM m WHERE c >= r)
SELECT doc_id, len(w)::BIGINT AS n_words, count(pos) AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (pos IS NOT NULL)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels, coalesce(max(share), 0) AS score
FROM d LEFT JOIN h USING (i) GROUP BY i, doc_id, w"""
