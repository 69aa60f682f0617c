"""Licence scans (method: diagonal voting).

All rolling k-grams of a text's words meet the template positions with the same k-gram in a Spark join. A match votes
for its diagonal, the text position minus the template position; votes are counted per (document, template, diagonal),
neighbouring diagonals (words put in or left out) are merged, and a span is accepted if the template words it covers
are a large enough share and its length fits the template. Base phrases are templates too, that must be covered whole
on one diagonal.

A k-gram's hash is a polynomial over codes of the templates' words, so equal hashes are equal words and the join needs
no second look at the text; k-grams that occur in no template are dropped before they leave the task, as the join
would drop them. After the join one shuffle by document serves all groupings.

Words: A-Z lower-cased, then runs of digits, letters and all characters beyond ASCII. Null texts count as empty, an
empty text has no words and no labels. Repeated rows each get a row. An empty table gives an empty table. Columns other
than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.llm.common import spread_small
from lumenbib.session import shuffle_width

# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Wordings of public licences and notices, in lower case without punctuation, and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "mit",
    ),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        "gpl",
    ),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "bsd",
    ),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "public-domain"),
]

GRAM, BASE_GRAM = 3, 2
SHARE = 0.75
SHIFT = 3  # words put in or left out between neighbouring diagonals
STRETCH = 1.5  # longest span against its template

ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ASCII).split()


class Position(NamedTuple):
    key: int
    template: int
    at: int


class Templates:
    """Codes of the templates' words, and the k-grams of all templates by position."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.texts = [(words_of(t), label, True) for t, label in base] + [(words_of(t), label, False) for t, label in templates]
        vocabulary = sorted({w for t, _, _ in self.texts for w in t})
        self.code = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.radix = len(vocabulary) + 1
        self.positions = []
        for i, (t, _, is_base) in enumerate(self.texts):
            k, codes = self.gram(is_base), np.array([self.code[w] for w in t], np.int64)
            self.positions += [Position(int(key), i, at) for at, key in enumerate(self.keys(codes, k))]
        self.wanted = {k: np.unique([p.key for p in self.positions if self.texts[p.template][2] == (k == BASE_GRAM)]) for k in (BASE_GRAM, GRAM)}

    @staticmethod
    def gram(is_base: bool) -> int:
        return BASE_GRAM if is_base else GRAM

    def keys(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Hash of each k-gram; negative where a word is in no template."""
        n = len(codes) - k + 1
        if n < 1:
            return np.empty(0, np.int64)
        key, known = np.full(n, k, np.int64), np.ones(n, bool)
        for j in range(k):
            key = key * self.radix + codes[j : j + n]
            known &= codes[j : j + n] > 0
        return np.where(known, key, -1)

    def matches(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        words = words_of(text)
        get = self.code.get
        codes = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        found = []
        for k, wanted in self.wanted.items():
            keys = self.keys(codes, k)
            at = np.flatnonzero(keys >= 0)
            at = at[np.isin(keys[at], wanted)]
            found += zip(at.tolist(), keys[at].tolist(), strict=True)
        return len(words), found


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES) -> DataFrame:
    """Per document: ``n_words``, ``places`` of base phrases and accepted ``spans`` (label, start, length, share)."""
    known = Templates(base, templates)

    @F.pandas_udf("n_words long, hits array<struct<pos: long, key: long>>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([known.matches(t) for t in batch.fillna("")], columns=["n_words", "hits"])

    spark = docs.sparkSession
    positions = spark.createDataFrame(known.positions, "key long, template int, at long")
    facts = [(i, label, is_base, len(t)) for i, (t, label, is_base) in enumerate(known.texts)]
    about = spark.createDataFrame(facts, "template int, label string, is_base boolean, size long")
    positions = F.broadcast(positions.join(about, "template"))  # fixed: the positions of the template list

    rows = spread_small(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), grams("text").alias("g"))
    hits = rows.select("row", "doc_id", "g.n_words", F.explode_outer("g.hits").alias("hit"))
    hits = hits.select("row", "doc_id", "n_words", "hit.pos", "hit.key")
    voted = hits.join(positions, "key", "left").repartition(shuffle_width(spark), "row")
    doc, what = ["row", "doc_id", "n_words"], ["template", "label", "is_base", "size"]
    diagonals = voted.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*doc, *what, "diagonal")
    diagonals = diagonals.agg(F.collect_list("at").alias("at"), F.min("pos").alias("low"), F.max("pos").alias("high"))

    along = Window.partitionBy("row", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.when(F.col("is_base") | step.isNull() | (step > SHIFT), 1).otherwise(0)
    merged = diagonals.withColumn("apart", apart).withColumn("run", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    gram = F.when(F.col("is_base"), BASE_GRAM).otherwise(GRAM).cast("long")
    spans = merged.groupBy(*doc, *what, "run").agg(
        F.flatten(F.collect_list("at")).alias("at"), F.min("low").alias("start"), (F.max("high") - F.min("low")).alias("width")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + gram - 1)))))
    spans = spans.withColumns({"share": covered / F.col("size"), "length": F.col("width") + gram})
    place = F.col("is_base") & (F.col("share") == 1)
    fits = ~F.col("is_base") & (F.col("share") >= SHARE) & (F.col("length") <= STRETCH * F.col("size"))
    span = F.struct("label", "start", "length", "share")
    found = spans.groupBy(*doc).agg(
        F.sort_array(F.collect_list(F.when(place, span))).alias("places"), F.sort_array(F.collect_list(F.when(fits, span))).alias("spans")
    )
    return found.select("doc_id", "n_words", "places", "spans")


def _joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and a score per document."""
    starts, base, own = F.col("places.start"), F.col("places.label"), F.col("spans.label")
    best = F.array_max(F.concat(F.array(F.lit(0.0)), F.col("spans.share")))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
        "spans",
    )
