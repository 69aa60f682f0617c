"""Quality scores (method: Naive Bayes support vectors).

Features are indicators of n-grams: words and pairs of words, and runs of up to three token shapes (case, marks, digits,
a repeat of the token before). Each indicator is scaled by its log-count ratio between the classes, rows get length
one, and a linear hinge-loss model is fitted by dual coordinate descent and scaled to probabilities on unseen folds.

The model is fitted in the driver on the features of at most ``bound`` labelled documents outside the held-out quarter;
scoring is one pass over whole texts without a shuffle. Null texts count as empty and get the score of the bias, as do
texts of white space; a label table without both classes gives every text the share of the positive class (0.5 if there
is no label). Repeated rows each get a row, an empty table gives an empty table, other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbib.llm.common import held_out, labelled_sample, spread_small
from lumenbib.llm.linear import Model, Scale, fit_scaled, rows_of
from lumenbib.llm.words import Memo

BOUND = 6000  # labelled documents that the model is fitted on, at most
BITS, LEAST_DOCS, SHAPES = 20, 5, 128
MIX = np.uint64(0x9E3779B97F4A7C15)
TAIL = re.compile(r"[^\w]+$")
LETTER = re.compile(r"[^\W\d_]")


def shape(token: str) -> int:
    """Case (5) x trailing marks (5) x digits (2)."""
    letters = LETTER.findall(token)
    if not letters:
        case = 0
    elif token.islower():
        case = 1
    elif token.isupper() and len(letters) > 1:
        case = 3
    else:
        case = 2 if letters[0].isupper() and sum(map(str.isupper, letters)) == 1 else 4
    marks = TAIL.search(token)
    tail = marks[0] if marks else ""
    kind = 0 if not tail else 1 if len(tail) == 1 and tail in ".,;:" else 2 if set(tail) <= set("!?.,") else 3 if len(tail) > 1 else 4
    return case * 10 + kind * 2 + any(map(str.isdigit, token))


def _describe(tokens: list[str]) -> list[int]:
    """Hash of the lower-cased token and its shape, in one number."""
    return [(xxhash.xxh64_intdigest(t.lower().encode("utf-8", "surrogatepass")) >> 8 << 7) | shape(t) for t in tokens]


class Featurizer:
    def __init__(self):
        self.memo = Memo(_describe)

    def __call__(self, text: str, wanted: np.ndarray | None = None) -> np.ndarray:
        """Distinct features of a text; with ``wanted`` only those whose entry is true."""
        tokens = text.split()
        if not tokens:
            return np.empty(0, np.int64)
        code = np.array(self.memo(tokens), np.uint64)
        word, form = code >> np.uint64(7), code & np.uint64(127)
        form[1:] += np.uint64(64) * (word[1:] == word[:-1]).astype(np.uint64)
        grams = [word, word[1:] * MIX + word[:-1], form, form[1:] * np.uint64(SHAPES) + form[:-1]]
        grams.append(grams[3][1:] * np.uint64(SHAPES) + form[:-2])
        hashed = [(g ^ np.uint64(0x5851F42D4C957F2D + k)) * MIX >> np.uint64(64 - BITS) for k, g in enumerate(grams)]
        flat = np.concatenate(hashed).astype(np.int64)
        return np.unique(flat if wanted is None else flat[wanted[flat]])


class QualityModel(NamedTuple):
    ratio: np.ndarray
    model: Model
    scale: Scale

    def score(self, features: np.ndarray) -> float:
        r = self.ratio[features]
        norm = np.sqrt(r @ r) or 1.0
        return float(self.scale(self.model.weights[features] @ r / norm + self.model.bias))


def fit(features: list[np.ndarray], positive: np.ndarray) -> QualityModel:
    size = 1 << BITS
    counts = [np.zeros(size), np.zeros(size)]
    for own, y in zip(features, positive, strict=True):
        counts[int(y)][own] += 1
    totals = [max(1, int((positive == y).sum())) for y in (False, True)]
    ratio = np.log((counts[1] + 1) / (totals[1] + 1)) - np.log((counts[0] + 1) / (totals[0] + 1))
    ratio[counts[0] + counts[1] < LEAST_DOCS] = 0
    if positive.all() or not positive.any():
        share = (positive.sum() + 1) / (len(positive) + 2) if len(positive) else 0.5
        return QualityModel(np.zeros(size), Model(np.zeros(size), 0.0), Scale(1.0, float(np.log(share / (1 - share)))))
    kept = [own[ratio[own] != 0] for own in features]
    values = [ratio[own] / (np.linalg.norm(ratio[own]) or 1.0) for own in kept]
    model, scale = fit_scaled(rows_of(kept, values), positive, size)
    return QualityModel(ratio, model, scale)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> QualityModel:
    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Featurizer()
        for batch in batches:
            yield pd.Series([of(t).astype("<i4").tobytes() for t in batch.fillna("")])

    sample = labelled_sample(docs, labels, "quality", bound, features)
    rows = sorted(sample.collect(), key=lambda r: (r["doc_id"], bytes(r["f"])))
    positive = np.array([r["label"] == 1 for r in rows], bool)
    return fit([np.frombuffer(r["f"], "<i4").astype(np.int64) for r in rows], positive)


def scored(docs: DataFrame, model: QualityModel, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of high quality."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio.astype(np.float32), model.model.weights.astype(np.float32)))
    bias, scale = model.model.bias, model.scale

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio, weights = shared.value
        of, own, wanted = Featurizer(), QualityModel(ratio, Model(weights, bias), scale), ratio != 0
        for batch in batches:
            yield pd.Series([own.score(of(t, wanted)) for t in batch.fillna("")])

    return docs.withColumn(into, run(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, bound: int = BOUND, threshold: float = 0.7) -> DataFrame:
    """Per document: ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, bound)
    rows = scored(spread_small(docs.select("doc_id", "text")), model)
    hit = (F.col("score") >= threshold).cast("int").alias("predicted")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", hit)
