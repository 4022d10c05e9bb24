"""License scans: an exact set-similarity join of text blocks with license templates.

A template of n words meets the blocks of 2 n words that start at every n-th word of a text, whatever its line ends, so as many
words in a row as it has lie whole in one of them. A block meets a template if it holds at least THRESHOLD of the template's
distinct words. Words of the templates are ordered by their document frequency in the corpus, rarest first; a block can only
meet a template if it holds one of the template's first |T| - need + 1 words (prefix filter), so these words' places say which
blocks are looked at. A document can only hold such a block if it has need words of the template at all (length filter), counted
from the first that it has in the order on (positional filter).

Texts are read and cut into words once: the pass that counts the template words keeps the words of the few documents that pass
the length filter. Templates are a short fixed list, so their side of the join is a literal and no text leaves its task.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, read, written

#: Phrases of the contract, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# The notices and grants of common licenses, as their owners publish them; (label, text).
TEMPLATES = (
    ("mit", "under the MIT license"),
    ("apache-2", "Apache License Version 2"),
    ("cc-by-nc", "CC BY NC"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("gpl-3", "licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
#: Containment as a fraction (numerator, denominator), so that comparisons stay exact.
THRESHOLD = (4, 5)
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def tokens(low: Column) -> Column:
    return F.filter(F.split(low, NO_WORD), lambda w: w != "")


def need(size: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    return -(-size * threshold[0] // threshold[1])


def template_words(text: str) -> list[str]:
    """As ``tokens`` has them."""
    return [w for w in re.split(NO_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def _strings(items) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def word_order(seen: DataFrame, templates=TEMPLATES) -> list[str]:
    """All template words, rarest in the corpus first (ties by word), of documents' sets of them (known). Counts over all documents; the
    result is as long as the templates' vocabulary."""
    counts = {r.w: r["count"] for r in seen.select(F.explode("known").alias("w")).groupBy("w").count().collect()}
    return sorted({w for _, text in templates for w in template_words(text)}, key=lambda w: (counts.get(w, 0), w))


def anchors(templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> list[str]:
    """Words of which a text must hold one to hold need words of any template: any |T| - need + 1 of each will do, so the long ones."""
    out: set[str] = set()
    for _, text in templates:
        words = sorted(set(template_words(text)), key=lambda w: (-len(w), w))
        out |= set(words[: len(words) - need(len(words), threshold) + 1])
    return sorted(out)


def matches(w: Column, known: Column, order: list[str], templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> Column:
    """array<struct<label, start, containment>>: of every template that a block meets the first best block, by its first word."""
    rank = {x: i for i, x in enumerate(order)}
    sets = []
    for label, text in templates:
        words = template_words(text)
        distinct = sorted(set(words), key=rank.__getitem__)
        least = need(len(distinct), threshold)
        sets.append(F.struct(
            F.lit(label).alias("label"), F.lit(len(words)).alias("length"), _strings(distinct).alias("words"), _strings(distinct[: len(distinct) - least + 1]).alias("prefix"), F.lit(least).alias("need"),
        ))
    shelf = F.array(*sets)

    def may_meet(t: Column) -> Column:
        held = F.array_intersect(t["words"], known)  # in the global order
        first = F.array_position(t["words"], F.get(held, F.lit(0)))
        return (F.size(held) >= t["need"]) & (F.size(t["words"]) - first + 1 >= t["need"])

    def best(t: Column) -> Column:
        spots = F.array_compact(F.transform(w, lambda x, i: F.when(F.array_contains(t["prefix"], x), F.floor(i / t["length"]).cast("int"))))
        blocks = F.filter(F.array_sort(F.array_distinct(F.concat(spots, F.transform(spots, lambda b: b - 1)))), lambda b: b >= 0)
        found = F.transform(blocks, lambda b: F.struct(F.size(F.array_intersect(t["words"], F.slice(w, b * t["length"] + 1, 2 * t["length"]))).alias("n"), (-b).alias("b")))
        return let(F.array_max(found), lambda m: F.struct(t["label"].alias("label"), (-m["b"] * t["length"]).alias("start"), (m["n"] / F.size(t["words"])).alias("containment"), (m["n"] >= t["need"]).alias("met")))

    return F.filter(F.transform(F.filter(shelf, may_meet), best), lambda m: m["met"])


def phrase_places(words: Column) -> tuple[Column, Column, Column, Column]:
    """Count, first and last start, and labels of the phrases, for an array of words."""
    line = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    total, firsts, lasts, labels = F.lit(0), [], [], []

    def length(part: Column) -> Column:
        return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")

    for phrase, label in PHRASES.items():
        parts = F.split(line, " " + phrase.replace(" ", "  ") + " ")
        there = F.size(parts) > 1
        total = total + F.size(parts) - 1
        firsts.append(F.when(there, length(F.get(parts, F.lit(0)))))
        lasts.append(F.when(there, F.size(words) - len(phrase.split()) - length(F.element_at(parts, -1))))
        labels.append(F.when(there, F.lit(label)))
    return total, F.least(*firsts), F.greatest(*lasts), F.array_compact(F.array(*labels))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found per row of ``docs``.

    ``found`` has the label, first word and containment of the best block of every template that is met. Null and empty texts
    have no words, labels "" and score 0. ``score`` is the highest containment found, 1 where a phrase stands. Equal rows are
    kept; texts of any length are looked at whole. Nothing but the counts of the templates' words is shuffled.
    """
    vocabulary = sorted({w for _, text in templates for w in template_words(text)} | {w for phrase in PHRASES for w in phrase.split()})
    shelf = _strings(sorted(set(anchors(templates, threshold)) | {max(phrase.split(), key=len) for phrase in PHRASES}))

    def of(w: Column) -> Column:
        count, first, last, base = phrase_places(w)
        hit = let(F.array_intersect(_strings(vocabulary), w), lambda v: F.struct(v.alias("known"), F.arrays_overlap(v, shelf).alias("hit")))
        places = F.struct(count.cast("long").alias("n_base"), first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), base.alias("base"))
        return let(hit, lambda k: F.struct(F.size(w).cast("long").alias("n_words"), k["known"].alias("known"), F.when(k["hit"], w).alias("w"), F.when(k["hit"], places).alias("p")))

    seen = docs.select("doc_id", let(lowered(F.col("text")), lambda low: let(tokens(low), of)).alias("s")).select("doc_id", "s.n_words", "s.known", "s.w", "s.p.*")
    seen = written(seen, "license-words")
    order = word_order(seen, templates)
    none = F.array().cast("array<struct<label:string,start:int,containment:double,met:boolean>>")
    out = seen.withColumn("found", F.coalesce(F.when(F.col("w").isNotNull(), matches(F.col("w"), F.col("known"), order, templates, threshold)), none))
    base = F.array_sort(F.coalesce("base", F.array().cast("array<string>")))
    n_base = F.coalesce(F.col("n_base"), F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("found", lambda m: m["label"]))), ",").alias("labels"),
        F.greatest(F.when(n_base > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda m: m["containment"])), F.lit(0.0))).alias("score"),
        F.transform("found", lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"), m["containment"].alias("containment"))).alias("found"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("found")


def _sql() -> str:
    """The same by brute force: every block against every template."""
    cases = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split()))
        cases.append((f"list_filter(range(len(w)), lambda i: {test})", label))
    shelf = ", ".join(f"('{label}', {len(template_words(text))}, {sorted(set(template_words(text)))!r})" for label, text in TEMPLATES)
    places = " || ".join(c for c, _ in cases)
    base = ", ".join(f"CASE WHEN len({c}) > 0 THEN '{label}' END" for c, label in cases)
    return rf"""
WITH l AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM l),
p AS (SELECT rid, doc_id, len(w) AS n_words, {places} AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM w),
b AS (SELECT rid, w, label, n, words, unnest(range(0, len(w), n)) AS s FROM w, (VALUES {shelf}) v(label, n, words)),
t AS (SELECT rid, label, len(list_intersect(list_distinct(w[s + 1:s + 2 * n]), words)) AS common, len(words) AS n FROM b),
m AS (SELECT rid, max(common / n) AS top, list(DISTINCT label) AS more FROM t WHERE {THRESHOLD[1]} * common >= {THRESHOLD[0]} * n GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(more, []))), ',') AS labels,
  greatest(CASE WHEN len(places) > 0 THEN 1.0 ELSE 0.0 END, coalesce(top, 0.0))::DOUBLE AS score
FROM p LEFT JOIN m USING (rid)
"""


QUERIES = {"op2_license_scan": query}
ORACLE_SQL = {"op2_license_scan": _sql()}
