"""Language identification (method: hierarchical discrimination).

Byte n-grams of the lower-cased text, hashed, feed linear support vector machines: first the family is predicted, then
one-versus-one machines separate the languages within it. Margins are scaled to probabilities; a language's score is
the probability of its family times its own among its siblings.

The machines are fitted in the driver on the features of at most ``per_language`` labelled rows of each language
outside the held-out quarter; scoring is one pass over whole texts without a shuffle. A text that is null or has no
letter is ``und`` with score 0, as is every text if no language could be learned; a single learned language is predicted
with score 1. Ties go to the language first in order. Scores shrink with the number of languages, so whether a text is of
a learned language at all is told by another quantity: the share of its letters' n-grams that documents of the predicted
language hold, against what that language's own documents reach on unseen folds. Repeated rows each get a row, an empty table gives an empty
table, columns other than those named are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.llm.common import give_back, held_out, spread_small
from lumenbib.llm.linear import Rows, Scale, fit_scaled, rows_of
from lumenbib.session import cut_lineage

PER_LANGUAGE = 1200  # labelled documents of a language that the machines are fitted on, at most
BITS = 16
SPREAD = 64.0
SALTS = 64
PIECE = 1 << 20  # bytes that are hashed at once
UNKNOWN = "und"

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he",
}
LETTER = re.compile(r"[^\W\d_]")
NO_LETTERS = re.compile(r"[\W\d_]+")
LOW, SLACK = 0.01, 0.9  # a text fits from SLACK times the quantile LOW of its language's unseen documents
FOLDS = 3


def family_of(language: str) -> str:
    code = re.split(r"[-_]", language.lower())[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"own:{language}")


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed pairs and triples of bytes."""
    a = data.astype(np.uint32)
    two = a[:-1] << 8 | a[1:]
    three = (two[:-1] << 8 | a[2:]) * np.uint32(0x9E3779B1)
    return np.concatenate([two, (three >> np.uint32(32 - BITS)) + np.uint32(1 << 16)])


SIZE = (1 << 16) + (1 << BITS)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)


def all_grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """``grams`` of long data by pieces that share two bytes, so no n-gram is lost or read twice."""
    for k in range(0, len(data), PIECE):
        last = k + PIECE + 1 >= len(data)
        own = grams(data[k : k + PIECE + (1 if last else 2)])
        yield own if last else np.concatenate([own[: PIECE], own[PIECE + 1 :]])  # pairs and triples that start here


def letters_of(text: str) -> np.ndarray:
    """Bytes of a text whose runs of anything but letters are blanks."""
    return as_bytes(NO_LETTERS.sub(" ", text))


class Duel(NamedTuple):
    """Column of a machine, the classes it separates, and the scale of its margin for the first."""

    column: int
    first: str
    second: str
    scale: Scale


def coupled(names: list[str], duels: list[Duel], margins: np.ndarray) -> dict[str, float]:
    """A probability for each class: the mean over its duels, made to sum to one."""
    if len(names) == 1:
        return {names[0]: 1.0}
    total = dict.fromkeys(names, 0.0)
    for d in duels:
        p = float(d.scale(margins[d.column]))
        total[d.first] += p
        total[d.second] += 1 - p
    whole = sum(total.values())
    return {n: v / whole for n, v in total.items()}


class Known(NamedTuple):
    """N-grams that documents of a language hold, and the least share of them in a text of it."""

    held: np.ndarray
    least: float


class LanguageModel(NamedTuple):
    languages: dict[str, list[str]]  # by family
    family_duels: list[Duel]
    duels: dict[str, list[Duel]]
    weights: np.ndarray
    biases: np.ndarray
    known: dict[str, Known] = {}  # noqa: RUF012

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.biases)), 0
        for own in all_grams(as_bytes(text)):
            total += self.weights[own].sum(axis=0, dtype=np.float64)
            n += len(own)
        return total * (SPREAD / max(n, 1)) + self.biases

    def fits(self, text: str | None, language: str) -> bool:
        """Whether enough of the text's n-grams are known from documents of a language, however many others there are."""
        if not text or language not in self.known:
            return False
        own, n = self.known[language], 0
        held = 0
        for at in all_grams(letters_of(text)):
            held += int(own.held[at].sum())
            n += len(at)
        return held >= own.least * n

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        margins = self.margins(text)
        families = coupled(list(self.languages), self.family_duels, margins)
        family = max(families, key=families.get)
        own = coupled(self.languages[family], self.duels[family], margins)
        best = max(own, key=own.get)
        return best, families[family] * own[best]


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, lang, text, n): at most ``per_language`` rows of each language, numbered from 1.

    The smallest hashed ids are taken, and of their rows (an id may repeat) the smallest hashes of id and text.
    """

    def cut(rows: DataFrame, *mark: str) -> DataFrame:
        rows = rows.withColumn("mark", F.xxhash64(*mark)).withColumn("salt", F.pmod(F.hash("mark"), F.lit(SALTS)))
        for parts in (["lang", "salt"], ["lang"]):  # a language that holds most rows is first cut in many tasks
            order = Window.partitionBy(*parts).orderBy("mark", "doc_id")
            rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
        return rows.drop("mark", "salt")

    known = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = cut(known.distinct(), "doc_id").select("doc_id", "lang")
    return cut(spread_small(docs.select("doc_id", "lang", "text")).join(F.broadcast(chosen), ["doc_id", "lang"]), "doc_id", "text")


def known_grams(chosen: DataFrame) -> dict[str, Known]:
    """From the letters' n-grams of a language's documents in a ``sample``, learned where the documents are.

    A fold's documents are measured against those of the other folds; where there are none, nothing is asked for.
    """
    rows = chosen.select("lang", (F.col("n") % FOLDS).alias("fold"), "text").repartition("lang", "fold")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, fold, text in zip(batch["lang"], batch["fold"], batch["text"], strict=True):
                own = held.setdefault((lang, fold), np.zeros(SIZE, bool))
                if text and LETTER.search(text):
                    for at in all_grams(letters_of(text)):
                        own[at] = True
        for (lang, fold), own in held.items():
            yield pd.DataFrame({"lang": [lang], "fold": [fold], "held": [np.packbits(own).tobytes()]})

    maps: dict[str, dict[int, np.ndarray]] = {}
    for r in rows.mapInPandas(gather, "lang string, fold int, held binary").collect():
        maps.setdefault(r["lang"], {})[r["fold"]] = np.frombuffer(r["held"], np.uint8)
    shared = chosen.sparkSession.sparkContext.broadcast(maps)

    @F.pandas_udf("double")
    def share(langs: pd.Series, folds: pd.Series, texts: pd.Series) -> pd.Series:
        out, ready = [], {}
        for lang, fold, text in zip(langs, folds, texts, strict=True):
            if not text or not LETTER.search(text):
                out.append(None)
                continue
            if (lang, fold) not in ready:
                ready[lang, fold] = union([m for k, m in shared.value[lang].items() if k != fold])
            n = held = 0
            for at in all_grams(letters_of(text)):
                held += int(ready[lang, fold][at].sum())
                n += len(at)
            out.append(held / n)
        return pd.Series(out, dtype="float64")

    shares = rows.select("lang", share("lang", "fold", "text").alias("share")).filter("share = share")
    least = {r["lang"]: r["least"] for r in shares.groupBy("lang").agg(F.percentile("share", F.lit(LOW)).alias("least")).collect()}
    return {lang: Known(union(list(own.values())), SLACK * least[lang]) for lang, own in maps.items() if lang in least}


def union(maps: list[np.ndarray]) -> np.ndarray:
    return np.unpackbits(np.bitwise_or.reduce(maps)).astype(bool) if maps else np.zeros(SIZE, bool)


def fit(names: list[str], rows: Rows) -> LanguageModel:
    """Machines from rows and their languages."""
    labels = np.array(names)
    families: dict[str, list[str]] = {}
    for name in sorted(set(names)):
        families.setdefault(family_of(name), []).append(name)
    own_family = np.array([family_of(n) for n in names])
    columns, biases = [], []

    def duels(classes: list[str], of: np.ndarray) -> list[Duel]:
        made = []
        for a, b in combinations(classes, 2):
            at = np.flatnonzero((of == a) | (of == b))
            model, scale = fit_scaled(rows, of[at] == a, SIZE, at=at, cost=10.0)
            made.append(Duel(len(columns), a, b, scale))
            columns.append(model.weights.astype(np.float32))
            biases.append(model.bias)
        return made

    between = duels(list(families), own_family)
    within = {f: duels(own, labels) for f, own in families.items()}
    weights = np.stack(columns, axis=1) if columns else np.zeros((SIZE, 0), np.float32)
    return LanguageModel(families, between, within, np.ascontiguousarray(weights), np.array(biases))


def counted(data: np.ndarray) -> tuple[bytes, bytes]:
    at, n = np.unique(grams(data), return_counts=True)
    return at.astype("<i4").tobytes(), (n * (SPREAD / n.sum())).astype("<f4").tobytes()


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, fits: bool = False) -> LanguageModel:
    """``fits``: also learns what ``LanguageModel.fits`` needs."""

    @F.pandas_udf("at binary, n binary")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [counted(as_bytes(t)) if t and LETTER.search(t) else (None, None) for t in batch]
            yield pd.DataFrame(rows, columns=["at", "n"])

    chosen = cut_lineage(sample(docs, per_language)) if fits else sample(docs, per_language)
    rows = chosen.select("doc_id", "lang", features("text").alias("f")).select("doc_id", "lang", "f.*").filter("at IS NOT NULL")
    found = rows.orderBy("doc_id", "lang", "at").toArrow()  # the features stay in Arrow's buffers until they are put together
    names = found.column("lang").to_pylist()
    at = [np.frombuffer(x.as_buffer(), "<i4") for x in found.column("at")]
    n = [np.frombuffer(x.as_buffer(), "<f4") for x in found.column("n")]
    held = rows_of(at, n)
    del found, at, n
    model = fit(names, held)
    del held
    give_back()
    return model._replace(known=known_grams(chosen)) if fits else model


def identified(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct of ``lang_pred`` and ``score``, and ``fits`` if the model has learned it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = ["lang_pred", "score", *(["fits"] if model.known else [])]

    @F.pandas_udf("lang_pred string, score double" + (", fits boolean" if model.known else ""))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = [(t, own.predict(t)) for t in batch]
            yield pd.DataFrame([(*p, own.fits(t, p[0])) if own.known else p for t, p in rows], columns=columns)

    return docs.withColumn(into, run(F.col(text).cast("string")))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per document: ``held_out``, ``lang_pred``, ``score``."""
    rows = identified(spread_small(docs.select("doc_id", "text")), train(docs, per_language))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")
