"""Classifiers: held-out accuracy, edge cases, and the fitted parts against plain versions."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbib.llm import langid, linear, quality, toxicity
from lumenbib.llm.common import free_name, held_out, labelled_sample

WIDE = "/root/testdata/sf0.01"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_rows(edge_docs):
    assert all(r["h"] == held(r["doc_id"]) for r in edge_docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect())


def test_sample_is_bounded_and_skips_contradictions(docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (3, 1), (4, None), (7, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, labels, "toxic", 10).collect()
    assert {(r["doc_id"], r["label"]) for r in rows} == {(i, y) for i, y in [(3, 1), (7, 0), (9, 1)] if not held(i)}
    assert labelled_sample(docs, labels, "toxic", 1).count() == 1


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 5))
    signs = np.sign(x @ np.array([1.0, -2, 0.5, 0, 0]) + 0.3 * rng.standard_normal(80))
    rows = linear.rows_of([np.arange(5)] * 80, list(x))
    model = linear.fit_hinge(rows, signs, 5, epochs=400)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - signs * (x @ w + b)).sum()

    best = loss(model.weights, model.bias)
    for _ in range(300):
        step = rng.standard_normal(6) * 0.05
        assert best <= loss(model.weights + step[:5], model.bias + step[5]) + 1e-2
    scale = linear.fit_scale(model.margins(rows), signs > 0)
    assert (scale(model.margins(rows)) > 0.5).mean() > 0.4


def check(result, table, values):
    rows = result.collect()
    assert len(rows) == table.count()
    for r in rows:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and values(r)
    return rows


@pytest.mark.parametrize(("run", "label", "threshold", "least"), [(quality.classify, "quality", 0.7, 0.95), (toxicity.classify, "toxic", 0.3, 0.85)])
def test_scores(spark, edge_docs, no_docs, run, label, threshold, least):
    docs, labels = (spark.read.parquet(f"{WIDE}/{t}.parquet") for t in ("documents", "labels"))
    whole = docs.select("doc_id", "text").union(edge_docs.select(F.col("doc_id") + 10**6, "text"))
    rows = check(run(whole, labels), whole, lambda r: r["predicted"] == (r["score"] >= threshold))
    known = {r["doc_id"]: r[label] for r in labels.collect()}
    right = [r["predicted"] == known[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean(right) >= least
    check(run(edge_docs, labels), edge_docs, lambda r: True)
    check(run(edge_docs, labels.filter("false")), edge_docs, lambda r: r["score"] == 0.5)
    assert run(no_docs, labels).count() == 0
    assert {r["doc_id"]: r["score"] for r in run(whole, labels).collect()} == {r["doc_id"]: r["score"] for r in rows}


def test_no_score_looks_at_other_columns(docs, labels):
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s")})
    for run in (quality.classify, toxicity.classify):
        assert sorted(map(tuple, run(docs, labels).collect())) == sorted(map(tuple, run(other, labels).collect()))


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.2
    good = [np.where(rng.random(3000) < 0.85, truth, ~truth) * 2 - 1 for _ in range(4)]
    copy = good[0].copy()
    noise = (rng.random(3000) < 0.5) * 2 - 1
    cast = np.stack([*good, copy, noise], axis=1).astype(np.int8)
    model = toxicity.fit_label_model(cast, 0.2)
    assert ((model.posterior(cast) >= 0.5) == truth).mean() > 0.93
    assert model.discount[0] < 0.7 < model.discount[1]  # a voter and its copy share a vote
    assert abs(model.ratios[5, 2]) < 0.3 < model.ratios[1, 2]


def toxic_rows(n=400):
    """Feature rows and labels, with words that are typical of toxic rows, and one seed word in a single row."""
    rng = np.random.default_rng(3)
    positive = rng.random(n) < 0.4
    seed = toxicity._features(["idiot"])[0][0]
    rows = []
    for i in range(n):
        own = {*rng.integers(0, 5000, 40).tolist(), *rng.integers(0, toxicity.PATTERN_BASE, 40).tolist()}
        own |= {*rng.choice(np.arange(9000, 9040), 6).tolist()} if positive[i] else set()
        own |= {seed, toxicity.PATTERN_BASE + 2} if i == 7 else set()
        rows.append(np.array(sorted(own), np.int32))
    return rows, positive, seed


def test_toxicity_fit_holds_no_vectors_of_all_features():
    rows, positive, _ = toxic_rows()
    toxicity.fit(rows, positive)
    tracemalloc.start()
    model = toxicity.fit(rows, positive)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert any(9000 <= f < 9040 for f in model.weights)
    assert peak < 50


def test_numbered_features_give_the_odds_of_all():
    rows, positive, seed = toxic_rows()
    used, places = toxicity.numbered(rows)
    assert seed in used and toxicity.PATTERN_BASE + 2 in used
    assert all(used[own].tolist() == row[np.isin(row, used)].tolist() for own, row in zip(places, rows, strict=True))
    whole = toxicity.strength(rows, positive, toxicity.SIZE)
    assert np.array_equal(toxicity.strength(places, positive, len(used)), whole[used])
    assert np.isin(np.flatnonzero(np.isfinite(whole)), used).all()


def test_languages(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{WIDE}/documents.parquet")
    rows = {r["doc_id"]: r for r in check(langid.identify(docs), docs, lambda r: True)}
    right = [rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in docs.filter("lang IS NOT NULL").collect() if held(r["doc_id"])]
    assert np.mean(right) > 0.98
    found = check(langid.identify(edge_docs), edge_docs, lambda r: r["lang_pred"] in ("en", "und"))
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} >= {0, 1, 2, 5}
    nothing = langid.identify(edge_docs.withColumn("lang", F.lit(None).cast("string")))
    assert all((r["lang_pred"], r["score"]) == ("und", 0) for r in nothing.collect())
    assert langid.identify(no_docs).count() == 0


def test_long_texts_are_hashed_whole(monkeypatch):
    rng = np.random.default_rng(0)
    weights, text = rng.standard_normal((langid.SIZE, 2)).astype(np.float32), "".join(map(chr, rng.integers(97, 122, 500)))
    model = langid.LanguageModel({}, [], {}, weights, np.zeros(2))
    whole = model.margins(text)
    for size in (1, 7, 64, 499, 501, 502):
        monkeypatch.setattr(langid, "PIECE", size)
        np.testing.assert_allclose(model.margins(text), whole, atol=1e-6)


def test_free_names(edge_docs):
    assert free_name(edge_docs, "SCORE") == "_SCORE" and free_name(edge_docs, "else") == "else"
