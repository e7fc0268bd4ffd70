"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A text's words are cut into overlapping blocks of ``BLOCK`` words. A block meets a template if it holds at least ``share``
of the template's distinct words. Words are ordered by their frequency in the whole corpus, rarest first. A block that
meets a template of n words with need = ceil(share * n) must hold one of the template's first n - need + 1 words
(prefix filter), at least ``need`` of all template words (length filter), and, from the place of the first shared word on,
both sides must still have ``need`` words left (positional filter). What passes is checked in full. ``BLOCK`` is at least
the stride and the longest template together, so a template that stands in a text always lies in one block.

Defined cases: a null text counts as empty; repeated rows each give a row; no rows give no rows. Templates are a bounded
parameter (``MOST_TEMPLATES``), so their words may be broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import stored

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
PHRASES = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))
TEMPLATES = {
    "mit": ("released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "apache-2.0": ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "either version 3 of the license or at your option any later version"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license", "licensed under cc by 4 0"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "proprietary": ("confidential and proprietary unauthorized copying of this file is strictly prohibited",),
}
SHARE, BLOCK, STRIDE, MOST_TEMPLATES = 0.8, 48, 24, 10000
KELVIN, OTHER = "\u212a", "\u00df"  # the one other character whose lower case is an ASCII letter, and one that stays outside ASCII


def words(text: Column) -> Column:
    """Words in lower case; only A-Z matter for what is compared here."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.filter(F.split(plain, SEPARATORS), lambda w: w != "")


def phrase_starts(tokens: Column, phrase: tuple[str, ...]) -> Column:
    """Word numbers, from 0, where the phrase stands."""
    count = F.size(tokens) - len(phrase)

    def here(i: Column) -> Column:
        test = F.get(tokens, i) == phrase[-1]
        for k, word in enumerate(phrase[:-1]):
            test = test & (F.get(tokens, i + k - (len(phrase) - 1)) == word)
        return test

    # the last word of each phrase is looked for first, in one pass without positions
    spread = F.filter(F.sequence(F.lit(len(phrase) - 1), count + len(phrase) - 1), here)
    found = F.when((count >= 0) & F.array_contains(tokens, phrase[-1]) & F.array_contains(tokens, phrase[0]), spread)
    return F.transform(F.coalesce(found, F.array().cast("array<int>")), lambda i: i - (len(phrase) - 1))


def template_table(templates: dict[str, tuple[str, ...]], frequency: dict[str, int], share: float) -> list[tuple]:
    """(template, label, words rarest first, need)."""
    rows = []
    for label, texts in templates.items():
        for text in texts:
            tokens = sorted(set(text.split()), key=lambda w: (frequency.get(w, 0), w))
            rows.append((len(rows), label, tokens, max(1, math.ceil(share * len(tokens) - 1e-9))))
    return rows


def word_frequency(tokens: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Corpus counts of the template words; as many rows as there are such words reach the driver."""
    rows = tokens.select(F.explode("words").alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count().collect()
    return {r["w"]: r["count"] for r in rows}


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: dict[str, tuple[str, ...]] | None = None,
         share: float = SHARE, block: int = BLOCK, stride: int = STRIDE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    templates = TEMPLATES if templates is None else templates
    count = sum(map(len, templates.values()))
    longest = max((len(t.split()) for texts in templates.values() for t in texts), default=0)
    if count > MOST_TEMPLATES:
        raise ValueError(f"{count} templates, at most {MOST_TEMPLATES} are broadcast")
    if block < stride + longest:
        raise ValueError(f"blocks of {block} words do not hold a stride of {stride} and a template of {longest} words")
    spark = docs.sparkSession
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in t.split()})
    frequency = word_frequency(docs.select(words(F.col(text_column)).alias("words")), vocabulary)
    ordered = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    table = template_table(templates, frequency, share)
    prefixes = sorted({w for _, _, tokens, need in table for w in tokens[:len(tokens) - need + 1]})
    least = min((need for *_, need in table), default=1)

    rows = docs.select(F.col(id_column).alias("id"), words(F.col(text_column)).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    for label, phrase in PHRASES:
        rows = rows.withColumn(f"at_{label}", phrase_starts(F.col("words"), phrase))
    starts = F.concat(*[F.col(f"`at_{label}`") for label, _ in PHRASES])
    base = F.array_compact(F.array(*[F.when(F.size(F.col(f"`at_{label}`")) > 0, F.lit(label)) for label, _ in PHRASES]))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n_words") - block) / stride)).cast("int")), lambda k: F.slice("words", k * stride + 1, block))
    hits = F.filter(blocks, lambda b: F.arrays_overlap(b, F.lit(prefixes)))
    shared = F.filter(F.transform(hits, lambda b: F.array_intersect(F.lit(ordered), b)), lambda b: F.size(b) >= least)
    found = F.when(F.arrays_overlap("words", F.lit(prefixes)), F.array_distinct(shared)) if table else F.lit(None).cast("array<array<string>>")
    scanned = stored(rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), base.alias("base"), found.alias("blocks")))

    sides = spark.createDataFrame(table, "template int, label string, tokens array<string>, need int")
    heads = sides.select("template", "label", "tokens", "need", F.posexplode(F.expr("slice(tokens, 1, size(tokens) - need + 1)")).alias("p", "word"))
    candidates = scanned.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("block")).select(
        "row", "block", F.posexplode("block").alias("q", "word"))
    joined = candidates.join(F.broadcast(heads), "word").where(
        (F.size("block") >= F.col("need")) & (F.least(F.size("tokens") - F.col("p"), F.size("block") - F.col("q")) >= F.col("need")))
    overlap = F.size(F.array_intersect("block", "tokens"))
    met = joined.where(overlap >= F.col("need")).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max(overlap / F.size("tokens")).alias("best"))
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return scanned.join(met, "row", "left").select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
