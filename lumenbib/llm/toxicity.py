"""Toxicity scores (method: weak supervision).

Many voters look at a document: lexicon voters (a seed list, and terms that a part of the labelled sample shows to be
typical of toxic documents, by kind of term and strength) and pattern voters. A generative label model estimates how
each voter votes in each class and which voters agree beyond that (their correlations, which discount their weight), and
gives every document of the sample a posterior label. A linear hinge-loss classifier is trained on the posterior labels
and scaled to probabilities.

Everything is fitted in the driver on the features of at most ``bound`` labelled documents outside the held-out quarter;
scoring is one pass over whole texts without a shuffle. Null texts count as empty; a text without features gets the
score of the bias. If the sample lacks a class, every text gets the share of toxic documents in it (0.5 without labels).
Repeated rows each get a row, an empty table gives an empty table, columns other than those named are not looked at.
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

from lumenbib.llm.common import give_back, held_out, labelled_sample, spread_small
from lumenbib.llm.linear import Scale, fit_hinge, fit_scale, rows_of
from lumenbib.llm.words import Memo

BOUND = 10000  # labelled documents that voters, label model and classifier are fitted on, at most
BITS = 20
PREFIXES = (4, 5, 6)
KINDS = 1 + len(PREFIXES)  # whole words, and prefixes by length
PATTERN_BASE = KINDS << BITS
WORD = re.compile(r"[^\W\d_]+")

# Seed words of insult.
SEEDS = """bastard bitch clown crap creep damn disgusting dumb fool garbage hate idiot imbecile jerk kill loser moron
pathetic pig racist scum shit shut stupid trash ugly vermin worthless idiota estupido imbecil basura asqueroso idiote
stupide imbécile ordure connard dégoûtant dummkopf blöd abschaum ekelhaft müll""".split()

# Patterns of a text that vote for toxicity.
PATTERNS = [
    re.compile(r"!{2,}"),
    re.compile(r"\b[A-Z]{3,}(?:\W+[A-Z]{3,}){3}"),
    re.compile(r"\b(?i:you(?:'re| are)?) (?:an? )?\w+!"),
    re.compile(r"\w\*+\w"),
    re.compile(r"(\w)\1{3,}"),
    re.compile(r"\b(?i:shut up|go away|get lost|hate you)\b"),
]
STRENGTHS = (0.8, 1.6, 2.6)  # least log-odds, less 2.5 standard errors, of a lexicon voter's terms
LEAST_DOCS = 4
SKETCH = 4


def _features(words: list[str]) -> list[tuple[int, ...]]:
    """Hashed features of a lower-cased word: itself, and its openings if it is longer."""
    out = []
    for w in words:
        own = [w] + [w[:k] if len(w) > k else None for k in PREFIXES]
        out.append(
            tuple(
                (k << BITS) | (xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> (64 - BITS))
                for k, x in enumerate(own)
                if x
            )
        )
    return out


class Featurizer:
    """Distinct features of a text; with ``wanted`` only those, found per word and kept with it."""

    def __init__(self, wanted: set[int] | None = None):
        if wanted is None:
            self.memo = Memo(_features)
        else:
            self.memo = Memo(lambda words: [tuple(f for f in own if f in wanted) for own in _features(words)])
        self.wanted = wanted

    def __call__(self, text: str) -> list[int]:
        own = {f for known in self.memo(list(set(WORD.findall(text.lower())))) for f in known}
        for k, pattern in enumerate(PATTERNS):
            if (self.wanted is None or PATTERN_BASE + k in self.wanted) and pattern.search(text):
                own.add(PATTERN_BASE + k)
        return sorted(own)


SIZE = PATTERN_BASE + len(PATTERNS)


def first_copies(rows: list[np.ndarray]) -> np.ndarray:
    """Rows without near copies of earlier ones: copies share their smallest hashed features."""
    seen: set[bytes] = set()
    kept = []
    for i, own in enumerate(rows):
        mixed = np.sort(own.astype(np.uint32) * np.uint32(0x9E3779B1))[:SKETCH].tobytes()
        if mixed not in seen:
            seen.add(mixed)
            kept.append(i)
    return np.array(kept, np.int64)


def numbered(rows: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The features that can vote or be chosen, in order, and ``rows`` of their places there.

    Those are the seeds, the patterns and what ``LEAST_DOCS`` rows hold. The steps after it hold vectors of these, not of
    all ``SIZE`` features, of which a driver would need several at once.
    """
    place = np.zeros(SIZE, np.int32)
    for own in rows:
        place[own] += 1
    place[[f for own in _features(SEEDS) for f in own[:1]]] = LEAST_DOCS
    place[PATTERN_BASE:] = LEAST_DOCS
    used = np.flatnonzero(place >= LEAST_DOCS)
    place.fill(-1)
    place[used] = np.arange(len(used))
    held = (place[own] for own in rows)
    return used, [own[own >= 0] for own in held]


def strength(rows: list[np.ndarray], positive: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of each of ``size`` features between the classes less 2.5 standard errors; copies count once."""
    counts = [np.zeros(size, np.float32), np.zeros(size, np.float32)]
    for own, y in zip(rows, positive, strict=True):
        counts[int(y)][own] += 1
    up, down = int(positive.sum()), int((~positive).sum())
    odds = np.log((counts[1] + 0.5) / (up + 1)) - np.log((counts[0] + 0.5) / (down + 1))
    low = odds - 2.5 * np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    return np.where(counts[1] < LEAST_DOCS, -np.inf, low)


def votes(rows: list[np.ndarray], odds: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Documents by voters: 1 toxic, -1 clean, 0 no vote. Columns: lexicons by kind and strength, several hits of a
    kind, no hit of a kind, the seeds, the patterns. ``rows`` and ``odds`` follow the features ``used``."""
    level = np.digitize(odds, STRENGTHS)
    level[used >= PATTERN_BASE] = 0
    seeds = {f for own in _features(SEEDS) for f in own[:1]}
    tiers = len(STRENGTHS)
    out = np.zeros((len(rows), KINDS * (tiers + 2) + 1 + len(PATTERNS)), np.int8)
    for i, places in enumerate(rows):
        own = used[places]
        tier, kind = level[places], own >> BITS
        for k in range(KINDS):
            hits = tier[(kind == k) & (tier > 0)]
            at = k * (tiers + 2)
            out[i, at + hits - 1] = 1
            out[i, at + tiers] = len(hits) > 1
            out[i, at + tiers + 1] = 0 if len(hits) else -1
        out[i, KINDS * (tiers + 2)] = any(f in seeds for f in own.tolist())
        for f in own[own >= PATTERN_BASE]:
            out[i, KINDS * (tiers + 2) + 1 + f - PATTERN_BASE] = 1
    return out


class LabelModel(NamedTuple):
    """Log-likelihood ratios of each voter's votes (-1, 0, 1), their discounts for correlation, and the prior."""

    ratios: np.ndarray
    discount: np.ndarray
    prior: float

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        each = self.ratios[np.arange(cast.shape[1])[None, :], cast + 1]
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + each @ self.discount, -30, 30)))


def fit_label_model(cast: np.ndarray, share: float, rounds: int = 30) -> LabelModel:
    """Expectation maximisation over the votes, without labels: per class and voter, how often each vote is cast.

    After each round, voters that agree more than the classes explain (correlation of their votes' residuals) share one
    vote's weight: a voter counts 1 / (sum of its squared residual correlations).
    """
    cast = np.vstack([cast, np.zeros((0, cast.shape[1]), np.int8)])
    score = cast.sum(axis=1, dtype=np.float64)
    first = np.zeros(len(cast))
    first[np.argsort(-score, kind="stable")[: max(1, round(share * len(cast)))]] = 1
    p = np.clip(first, 0.05, 0.95)
    model = LabelModel(np.zeros((cast.shape[1], 3)), np.ones(cast.shape[1]), share)
    onehot = np.stack([cast == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    for _ in range(rounds):
        up = (np.einsum("i,ijv->jv", p, onehot) + 0.5) / (p.sum() + 1.5)
        down = (np.einsum("i,ijv->jv", 1 - p, onehot) + 0.5) / ((1 - p).sum() + 1.5)
        value = np.array([-1.0, 0.0, 1.0])
        rest = cast - (p[:, None] * (up @ value) + (1 - p)[:, None] * (down @ value))
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        together = (rest.T @ rest) / len(rest) / np.outer(spread, spread)
        discount = 1 / np.maximum(1.0, (np.clip(together, -1, 1) ** 2).sum(axis=0))
        model = LabelModel(np.log(up) - np.log(down), discount, share)
        new = model.posterior(cast)
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model


class ToxicityModel(NamedTuple):
    weights: dict[int, float]
    bias: float
    scale: Scale

    def score(self, features: list[int]) -> float:
        return float(self.scale(sum(self.weights[f] for f in features) + self.bias))


def fit(rows: list[np.ndarray], positive: np.ndarray) -> ToxicityModel:
    if not len(rows) or positive.all() or not positive.any():
        share = (positive.sum() + 1) / (len(positive) + 2) if len(positive) else 0.5
        return ToxicityModel({}, 0.0, Scale(1.0, float(np.log(share / (1 - share)))))
    share = float(np.clip(positive.mean(), 0.01, 0.5))
    alone = first_copies(rows)
    used, rows = numbered([rows[i] for i in alone])
    positive = positive[alone]
    # Lexicons come from one half and vote in the other, and the other way round, so that no vote knows its own label.
    half = np.arange(len(rows)) % 2 == 0
    cast = None
    for part in (half, ~half):
        odds = strength([r for r, h in zip(rows, part, strict=True) if h], positive[part], len(used))
        own = votes([r for r, h in zip(rows, part, strict=True) if not h], odds, used)
        if cast is None:
            cast = np.zeros((len(rows), own.shape[1]), np.int8)
        cast[~part] = own
    posterior = fit_label_model(cast, share).posterior(cast)
    labels = posterior >= 0.5
    if labels.all() or not labels.any():
        labels = positive
    # The classifier sees features that the posterior labels call typical, in either direction.
    chosen = np.flatnonzero((strength(rows, labels, len(used)) > STRENGTHS[0]) | (used >= PATTERN_BASE))
    kept = [np.searchsorted(chosen, r[np.isin(r, chosen)]) for r in rows]
    data = rows_of(kept)
    signs, cost = np.where(labels, 1.0, -1.0), np.abs(2 * posterior - 1) + 0.05
    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % 3
    for k in range(3):
        seen_rows, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = fit_hinge(data.take(seen_rows), signs[seen_rows], len(chosen), cost=cost[seen_rows])
        margins[rest] = part.margins(data.take(rest))
    model = fit_hinge(data, signs, len(chosen), cost=cost)
    own = np.flatnonzero(model.weights)
    weights = dict(zip(used[chosen[own]].tolist(), model.weights[own].tolist(), strict=True))
    return ToxicityModel(weights, model.bias, fit_scale(margins, positive))


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> ToxicityModel:
    @F.pandas_udf("binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Featurizer()
        for batch in batches:
            yield pd.Series([np.array(of(t), "<i4").tobytes() for t in batch.fillna("")])

    sample = labelled_sample(docs, labels, "toxic", bound, features)
    found = sample.orderBy("doc_id", "f").select("label", "f").toArrow()  # the features stay in Arrow's buffers
    positive = np.array([y == 1 for y in found.column("label").to_pylist()], bool)
    model = fit([np.frombuffer(x.as_buffer(), "<i4") for x in found.column("f")], positive)
    del found
    give_back()
    return model


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        of = Featurizer(set(own.weights))
        for batch in batches:
            yield pd.Series([own.score(of(t)) for t in batch.fillna("")])

    return docs.withColumn(into, run(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, bound: int = BOUND, threshold: float = 0.3) -> DataFrame:
    """Per document: ``held_out``, ``score``, ``predicted``."""
    model = train(docs, labels, bound)
    rows = scored(spread_small(docs.select("doc_id", "text")), model)
    hit = (F.col("score") >= threshold).cast("int").alias("predicted")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", hit)
