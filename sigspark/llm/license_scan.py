"""License scan as an exact set-similarity join between text blocks and license templates, in native expressions only.

Blocks are windows of words, one every half window, over the whole text; the window follows from the longest template, so that every
template that stands in a text is whole in some block. Tokens are ordered by their frequency in the corpus, rarest first. A block B and
a template T can only reach |B and T| >= need if they share a token among the first |B| - need + 1 and |T| - need + 1 (prefix filter),
if |B| >= need (length filter), and if enough tokens follow the shared one on both sides (positional filter); pairs that pass are
counted in full, so the join is exact. Blocks keep known tokens only: others cannot be shared.

Templates of up to SHORT tokens have to be there in full and in their order, longer ones by THRESHOLD of their tokens, within a span of the block that is
little longer than the template; of a license's name the words `having` have to be in that span, and those of a like license, `lacking`, must not. Every template that is
met gives its label: a text under two licenses has both, even side by side.

Defined results: null and empty texts have no words, null places, empty labels and score 0; equal texts have equal results; very long
texts are scanned whole; an empty table gives an empty result; extra columns are ignored. The vocabulary, its frequencies and the template
index are bounded by the templates.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a template's tokens that a block must hold, unless the template has no more than SHORT tokens.
THRESHOLD, SHORT = Fraction(4, 5), 9


class Template(NamedTuple):
    label: str
    text: str
    having: str = ""
    lacking: str = ""


#: Phrases that the scan counts place by place, and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Sentences of public license notices, their labels, and the words that tell them from other licenses.
TEMPLATES = (
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public", "lesser affero"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public", "lesser affero"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gnu lesser general public"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License"),
    Template("agpl", "under the terms of the GNU Affero General Public License"),
    Template("apache", "Licensed under the Apache License, Version 2.0."),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("mit", "Released under the MIT License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Licensed under the BSD License."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution", "sharealike noncommercial noderivatives"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike", "noncommercial"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial", "sharealike noderivatives"),
    Template("cc-by", "Licensed under CC BY 4.0."),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    Template("apache", "SPDX-License-Identifier: Apache"),
    Template("mit", "SPDX-License-Identifier: MIT"),
    Template("gpl", "SPDX-License-Identifier: GPL"),
    Template("lgpl", "SPDX-License-Identifier: LGPL"),
    Template("agpl", "SPDX-License-Identifier: AGPL"),
    Template("bsd", "SPDX-License-Identifier: BSD"),
    Template("isc", "SPDX-License-Identifier: ISC"),
    Template("mpl", "SPDX-License-Identifier: MPL"),
    Template("unlicense", "SPDX-License-Identifier: Unlicense"),
    Template("cc-by", "SPDX-License-Identifier: CC-BY", "", "sa nc nd"),
    Template("cc-by-sa", "SPDX-License-Identifier: CC-BY-SA"),
    Template("cc-by-nc", "SPDX-License-Identifier: CC-BY-NC", "", "sa nd"),
    Template("proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "reserved"),
)
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def tokens(text: str) -> list[str]:
    """Distinct words of a template, which is ASCII."""
    return list(dict.fromkeys(re.findall("[0-9a-z]+", text.lower())))


def need(n: int) -> int:
    """Tokens of n that have to be shared."""
    return n if n <= SHORT else -(-n * THRESHOLD.numerator // THRESHOLD.denominator)


def span(t: Template) -> int:
    """Words of a text among which the template has to be found: its own number and an eighth more, 2 at least."""
    n = len(re.findall("[0-9a-z]+", t.text.lower()))
    return n + max(2, n // 8)


def block_step(templates: Sequence[Template]) -> int:
    """Words from block to block, half of a block: the power of 2 that holds the longest span. A span is looked for in the block in whose first half it begins."""
    return 1 << (max(map(span, templates)) - 1).bit_length()


def _lowered(text: Column) -> Column:
    """A-Z lower-cased. lower() also touches other letters, which no phrase and no template has, but makes the Kelvin sign an ASCII k."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")))


def _words(text: Column) -> Column:
    """Words of a lower-cased text; split leaves an empty string before a leading and after a trailing gap."""
    parts = F.split(text, f"{_GAP}+")
    lead, trail = (F.when(F.element_at(parts, i) == "", 1).otherwise(0) for i in (1, -1))
    return F.slice(parts, 1 + lead, F.greatest(F.lit(0), F.size(parts) - lead - trail))


def _literal(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _base(text: Column) -> dict[str, Column]:
    """Places of the phrases, by splitting the text at them. No phrase begins as another one ends, so they never overlap."""
    spelt = "|".join(p.replace(" ", f"{_GAP}+") for p, _ in PHRASES)
    pattern = f"(?<!{_WORD})(?:{spelt})(?!{_WORD})"
    parts = F.when(F.contains(text, F.lit("license")) | F.contains(text, F.lit("cc")), F.split(text, pattern)).otherwise(F.array(text))
    found = F.size(parts) > 1
    places = F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    n_words = F.size(_words(text)).cast("long")
    label = F.create_map(*(F.lit(x) for p, name in PHRASES for x in (p.split()[0], name)))
    return {
        "n_words": n_words,
        "n_base": (F.size(parts) - 1).cast("long"),
        "first_word": F.when(found, F.size(_words(F.element_at(parts, 1))).cast("long")),
        "last_word": F.when(found, n_words - F.size(_words(F.element_at(parts, -1))) - F.size(_words(F.element_at(places, -1)))),
        "base": F.coalesce(F.array_distinct(F.transform(places, lambda p: F.element_at(label, F.element_at(_words(p), 1)))), F.array().cast("array<string>")),
    }


def token_order(docs: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The vocabulary by frequency over all words of docs, rarest first; at most len(vocabulary) rows reach the driver."""
    words = docs.select(F.explode(F.split(_lowered(F.col("text")), f"{_GAP}+")).alias("word"))
    seen = {r["word"]: r["n"] for r in words.where(F.col("word").isin(*vocabulary)).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def template_matches(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per distinct text (key, check: two hashes of it) the labels of all templates that it meets, and the best containment."""
    spark, step = docs.sparkSession, block_step(templates)
    sets = [tokens(t.text) for t in templates]
    lacking = [t.lacking.split() for t in templates]
    order = token_order(docs, sorted({w for s in [*sets, *lacking] for w in s}))
    at = {w: i for i, w in enumerate(order)}
    index = []
    for k, (t, words) in enumerate(zip(templates, sets, strict=True)):
        ranked = sorted(words, key=at.__getitem__)
        index += [(w, i, len(ranked), need(len(ranked)), k, t.label, ranked, words, span(t), t.having.split(), lacking[k]) for i, w in enumerate(ranked[: len(ranked) - need(len(ranked)) + 1])]
    index = F.broadcast(spark.createDataFrame(index, "token string, i int, t int, need int, template int, label string, words array<string>, ordered array<string>, span int, having array<string>, lacking array<string>"))  # at most the templates' tokens
    least = min(need(len(s)) for s in sets)
    words = docs.select(F.xxhash64("text").alias("key"), F.hash("text").alias("check"), _words(_lowered(F.col("text"))).alias("words")).where("size(words) > 0")
    # words that no template has count for spans, so a block that may meet one keeps them all
    part = F.expr(f"transform(sequence(0, size(words) - 1, {step}), s -> named_struct('raw', slice(words, s + 1, {2 * step}), 'block', array_intersect(array({_literal(order)}), slice(words, s + 1, {2 * step}))))")
    blocks = words.select("key", "check", F.posexplode(F.filter(part, lambda x: F.size(x["block"]) >= least)).alias("place", "x")).select("key", "check", "place", "x.raw", "x.block")
    prefix = blocks.select("key", "check", "place", "raw", "block", F.posexplode(F.expr(f"slice(block, 1, size(block) - {least} + 1)")).alias("j", "token"))
    pairs = prefix.join(index, "token").where("size(block) >= need and j <= size(block) - need and 1 + least(t - i - 1, size(block) - j - 1) >= need")
    pairs = pairs.where("size(array_intersect(words, block)) >= need and size(array_except(having, block)) = 0")
    met = f"""size(array_intersect(words, x)) >= need and size(array_except(having, x)) = 0 and not arrays_overlap(lacking, x)
        and (t > {SHORT} or transform(ordered, w -> array_position(x, w)) = array_sort(transform(ordered, w -> array_position(x, w))))"""
    spans = f"transform(filter(sequence(0, least({step}, size(raw)) - 1), i -> array_contains(words, raw[i])), i -> slice(raw, i + 1, span))"
    shared = F.expr(f"array_max(transform(filter({spans}, x -> {met}), x -> size(array_intersect(words, x))))")
    pairs = pairs.withColumn("shared", shared).where("shared is not null")
    return pairs.groupBy("key", "check").agg(F.collect_set("label").alias("found"), F.max(F.col("shared") / F.col("t")).alias("best"))


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the best containment of a template that a block meets, 1 where a phrase stands, else 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = _base(F.col("lowered"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.hash("text").alias("check"), _lowered(F.col("text")).alias("lowered")).select("doc_id", "key", "check", *(c.alias(n) for n, c in base.items()))
    rows = rows.join(template_matches(docs), ["key", "check"], "left")
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>"))))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def sql() -> str:
    """The same in DuckDB SQL, without the filters: every span of the blocks that hold enough tokens of a template."""
    step = block_step(TEMPLATES)
    strings = lambda words: f"[{_literal(words)}]::VARCHAR[]"
    values = ", ".join(f"({k}, '{t.label}', {strings(tokens(t.text))}, {need(len(tokens(t.text)))}, {span(t)}, {strings(t.having.split())}, {strings(t.lacking.split())})" for k, t in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', [{_literal(p.split())}])" for p, label in PHRASES)
    return f"""
        WITH templates(k, label, words, need, span, having_, lacking) AS (VALUES {values}), phrases(label, words) AS (VALUES {phrases}),
        d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}+') AS words FROM documents),
        places AS (SELECT rid, label, len(p.words) AS size, unnest(list_filter(range(len(d.words)), lambda i: d.words[i + 1 : i + len(p.words)] = p.words)) AS pos FROM d, phrases p),
        base AS (SELECT rid, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS found FROM places GROUP BY rid),
        tok AS (SELECT k, need, unnest(words) AS w FROM templates), places_of AS (SELECT rid, generate_subscripts(words, 1) - 1 AS pos, unnest(words) AS w FROM d),
        near AS (SELECT rid, k, need, w, unnest([pos // {step}, pos // {step} - 1]) AS b FROM places_of JOIN tok USING (w)),
        blocks AS (SELECT rid, k, b FROM near WHERE b >= 0 GROUP BY rid, k, need, b HAVING count(DISTINCT w) >= need),
        starts AS (SELECT rid, label, t.words, need, span, having_, lacking, d.words AS all_, unnest(range(b * {step} + 1, least((b + 1) * {step}, len(d.words)) + 1)) AS i FROM blocks JOIN templates t USING (k) JOIN d USING (rid)),
        spans AS (SELECT rid, label, words, need, having_, lacking, all_[i : i + span - 1] AS x FROM starts WHERE list_contains(words, all_[i])),
        met AS (SELECT rid, label, len(list_intersect(words, x)) / len(words) AS part FROM spans WHERE len(list_intersect(words, x)) >= need AND list_has_all(x, having_) AND NOT list_has_any(x, lacking)
                AND (len(words) > {SHORT} OR list_transform(words, lambda w: list_position(x, w)) = list_sort(list_transform(words, lambda w: list_position(x, w))))),
        found AS (SELECT rid, list(DISTINCT label) AS found, max(part) AS best FROM met GROUP BY rid)
        SELECT doc_id, len(words) AS n_words, coalesce(b.n, 0) AS n_base, first_word, last_word, coalesce(list_aggregate(b.found, 'string_agg', ','), '') AS base_labels,
               coalesce(list_aggregate(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(f.found, [])))), 'string_agg', ','), '') AS labels,
               greatest(coalesce(best, 0.0), CASE WHEN b.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
        FROM d LEFT JOIN base b USING (rid) LEFT JOIN found f USING (rid)"""
