"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

Texts are cut into overlapping blocks of words, at a scale for each size of template, so that any run of words as long
as a template lies within one block. A block meets a template if it holds at least THRESHOLD of the template's distinct
words. Words are ordered by their frequency over all blocks, rare ones first: only a block that shares a word of both
prefixes can reach the threshold (prefix filter), blocks with too few of the templates' words cannot (length filter),
nor can pairs with too few words behind the shared one (positional filter). What is left is verified. DataFrame
operations only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, small

#: Phrases and the labels that their places give (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Public license notices and the labels of the method.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
#: Share of a template's distinct words that a block must hold, in tenths.
TENTHS = 9
#: Words that blocks of the shortest templates overlap by; blocks are twice as long.
LEAST_STEP = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters from U+0080, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAP), "")


def template_words(text: str) -> list[str]:
    """The distinct words of a template, as words_of reads them, in the order of their first places."""
    return list(dict.fromkeys(w for w in re.split(_GAP, text.translate(str.maketrans(UPPER, LOWER))) if w))


def step_of(text: str) -> int:
    """The step of the blocks that a template is compared with: the power of two from LEAST_STEP that holds its words."""
    n = len([w for w in re.split(_GAP, text) if w])
    return max(LEAST_STEP, 1 << max(0, n - 1).bit_length())


def needed(n: int, tenths: int = TENTHS) -> int:
    """How many of n distinct words a block must hold."""
    return -(-tenths * n // 10)


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the phrase's words in a column of words, ascending; looked for only where all of its words occur."""
    *head, last = phrase.split(" ")
    k = len(head)

    def start(w: Column, i: Column) -> Column:
        fits = w == last
        for j, x in enumerate(head):
            fits = fits & F.coalesce(F.get(words, i - (k - j)) == x, F.lit(False))
        return F.when(fits, i - k)

    there = F.lit(True)
    for x in {*head, last}:
        there = there & F.array_contains(words, x)
    return F.when(there, F.array_compact(F.transform(words, start))).otherwise(F.array().cast("array<int>"))


def _blocks(words: Column, step: int, vocabulary: list[str], least: int) -> Column:
    """Blocks of 2 * step words at every step that hold `least` of the vocabulary or more, with these words; none where the whole text has fewer."""
    known, n = F.array(*map(F.lit, vocabulary)), F.size(words)
    last = F.greatest(F.lit(0), F.ceil(n / step).cast("int") - 2)

    def block(k: Column) -> Column:
        held = F.array_intersect(known, F.slice(words, k * step + 1, F.lit(2 * step)))
        return F.struct(F.lit(step).alias("step"), k.alias("block"), held.alias("held"))

    found = F.filter(F.transform(F.sequence(F.lit(0), last), block), lambda b: F.size(b["held"]) >= least)
    none = F.array().cast("array<struct<step:int,block:int,held:array<string>>>")
    return F.when(F.size(F.array_intersect(known, words)) >= least, found).otherwise(none)


def measured(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, tenths: int = TENTHS) -> DataFrame:
    """(row, doc_id, n_words, places, blocks) of each row of documents(doc_id, text), written to the shared folder; one pass over the texts.

    places: an array of starts for each phrase. blocks: see _blocks, of all steps that templates have.
    """
    rows = documents.select("doc_id", words_of(F.col("text")).alias("words"))
    kinds: dict[int, list[list[str]]] = {}
    for _, text in templates:
        if own := template_words(text):
            kinds.setdefault(step_of(text), []).append(own)
    blocks = [_blocks(F.col("words"), step, sorted({w for t in own for w in t}), min(needed(len(t), tenths) for t in own)) for step, own in sorted(kinds.items())]
    places = [phrase_places(F.col("words"), p) for p, _ in phrases]
    none = F.array().cast("array<struct<step:int,block:int,held:array<string>>>")
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
        F.array(*places).cast("array<array<int>>").alias("places"), (F.concat(*blocks) if blocks else none).alias("blocks"),
    )
    return materialize(rows, "license-blocks")


def frequencies(rows: DataFrame) -> list[str]:
    """The templates' words by their number of blocks among all blocks, rare ones first, ties by code point; a row a word reaches the driver."""
    held = rows.select(F.explode("blocks").alias("b")).select(F.explode("b.held").alias("word"))
    return [r.word for r in sorted(held.groupBy("word").count().collect(), key=lambda r: (r["count"], r.word))]


def matches(rows: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, tenths: int = TENTHS) -> DataFrame:
    """(row, step, block, template, label, containment) of each block of rows(row, blocks) and template that meet the threshold, as often as they share a word of both prefixes."""
    seen = frequencies(rows)
    unseen = sorted({w for _, t in templates for w in template_words(t)} - set(seen))
    order = {w: i + 1 for i, w in enumerate([*unseen, *seen])}
    listed = []
    for number, (label, text) in enumerate(templates):
        own = sorted(order[w] for w in template_words(text))
        t = needed(len(own), tenths)
        listed += [(step_of(text), code, i, len(own), t, own, number, label) for i, code in enumerate(own[: len(own) - t + 1], 1)]
    prefixes = rows.sparkSession.createDataFrame(listed, "t_step int, code int, i int, t_size int, needed int, t_codes array<int>, template int, label string")
    least: dict[int, int] = {}
    for x in listed:
        least[x[0]] = min(x[4], least.get(x[0], x[4]))

    ranks = F.array(*map(F.lit, sorted(order, key=order.get)))
    blocks = rows.select("row", F.explode("blocks").alias("b"))
    blocks = blocks.select("row", "b.step", "b.block", F.sort_array(F.transform("b.held", lambda w: F.array_position(ranks, w).cast("int"))).alias("codes"))
    at_least = F.coalesce(*[F.when(F.col("step") == s, n) for s, n in least.items()], F.lit(1)) if least else F.lit(1)
    first = F.slice("codes", F.lit(1), F.size("codes") - at_least + 1)
    probes = blocks.select("row", "step", "block", "codes", F.posexplode(first).alias("j", "b_code")).withColumn("j", F.col("j") + 1)

    size = F.size("codes")
    length = size >= F.col("needed")
    prefix = F.col("j") <= size - F.col("needed") + 1
    positional = 1 + F.least(F.col("t_size") - F.col("i"), size - F.col("j")) >= F.col("needed")
    met = probes.join(small(prefixes), (F.col("step") == F.col("t_step")) & (F.col("b_code") == F.col("code")) & length & prefix & positional)
    met = met.withColumn("shared", F.size(F.array_intersect("codes", "t_codes"))).filter("shared >= needed")
    return met.select("row", "step", "block", "template", "label", (F.col("shared") / F.col("t_size")).alias("containment"))


def scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, tenths: int = TENTHS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of documents(doc_id, text).

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest starts. labels
    are those of the phrases and of the templates that a block meets. score is the largest containment of a template
    that is met, 1 where a phrase stands, else 0. Defined cases: a null, empty or wordless text has no words, no
    places (starts are null), empty labels and score 0; texts of any length are read whole; rows that repeat, also in
    doc_id, are scanned each on its own; a null doc_id stays null; other columns are ignored, whatever their names; an
    empty table gives no rows; without templates or phrases there are only the others' labels.
    """
    rows = measured(documents, templates, phrases, tenths)
    found = matches(rows, templates, tenths).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))  # a label a template at most
    labels = F.array(*[F.lit(label) for _, label in phrases]).cast("array<string>")
    base = F.array_sort(F.array_distinct(F.filter(labels, lambda x, k: F.size(F.get(F.col("places"), k)) > 0)))
    starts = F.flatten("places")
    out = rows.select("row", "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), base.alias("base"))
    out = out.join(found, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.alias("score"))


def blocks_found(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, tenths: int = TENTHS) -> DataFrame:
    """(doc_id, first_word, last_word, template, label, containment) of each block of words that meets a template; see scan for the defined cases."""
    rows = measured(documents, templates, (), tenths)
    found = matches(rows, templates, tenths).distinct()
    first = (F.col("block") * F.col("step")).cast("long")
    last = F.least(first + 2 * F.col("step"), F.col("n_words")) - 1
    return found.join(rows.select("row", "doc_id", "n_words"), "row").select("doc_id", first.alias("first_word"), last.alias("last_word"), "template", "label", "containment")


def _sql() -> str:
    quoted = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
    known = ", ".join(f"({k}, '{label}', {step_of(text)}, {quoted(template_words(text))}, {needed(len(template_words(text)))})" for k, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({quoted(p.split(' '))}, '{label}')" for p, label in PHRASES)
    return rf"""
WITH templates(template, label, step, own, needed) AS (VALUES {known}), phrases(phrase, label) AS (VALUES {phrases}),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), places AS (
  SELECT row, label, pos FROM (SELECT row, words, unnest(range(len(words))) AS pos FROM texts WHERE list_contains(words, 'license')), phrases WHERE words[pos + 1 : pos + len(phrase)] = phrase
), base AS (
  SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY row
), blocks AS (
  SELECT row, step, list_distinct(words[block * step + 1 : block * step + 2 * step]) AS held
  FROM (SELECT row, words, step, unnest(range(greatest(0, ceil(len(words) / step)::BIGINT - 2) + 1)) AS block FROM texts, (SELECT DISTINCT step FROM templates))
), met AS (
  SELECT row, label, len(list_intersect(held, own)) AS shared, len(own) AS size FROM blocks JOIN templates USING (step) WHERE len(list_intersect(held, own)) >= needed
), found AS (
  SELECT row, list(DISTINCT label) AS labels, max(shared / size) AS best FROM met GROUP BY row
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM texts LEFT JOIN base AS b USING (row) LEFT JOIN found AS f USING (row)"""


SQL = _sql()
