"""Stages of the pipeline against planted documents."""

import random

import pytest

import corpus_pipeline
from lumenbib.llm import langid, simhash
from lumenbib.llm.common import labelled_sample

CODES = "en zh ja ko th fr de el ka hy vi id sw eu tl mt cy sq km lo".split()  # most are a family of their own
COLUMNS = "doc_id long, text string, lang string"


def language_texts(seed, n, words=60):
    """Texts of an invented language: its own syllables of Latin letters."""
    draw = random.Random(seed)
    syllables = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.choice([2, 3]))) for _ in range(24)]
    return [" ".join("".join(draw.choices(syllables, k=draw.choice([1, 2, 3]))) for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 2, 4, 20])
def test_language_stage_keeps_learned_and_rejects_unlearned(spark, n):
    rows = [(t, code) for k, code in enumerate(CODES[:n]) for t in language_texts(k, 40)]
    rows += [(t, None) for t in [*language_texts(999, 10), "Это предложение написано по-русски", "12 34 !!", "", None]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS).repartition(4)
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    known = {r["doc_id"] for r in kept.collect()}
    assert not {i for i in known if rows[i][1] is None}
    assert len(known) >= 0.98 * 40 * n
    assert all(sum(rows[i][1] == code for i in known) >= 36 for code in CODES[:n])


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], COLUMNS)
    assert corpus_pipeline.language(spark, docs, "").count() == 0


def test_rows_that_go_do_not_follow_the_splits(spark, tmp_path):
    """Other splits at the second read than at the first (cores that come or go) name no other rows."""
    rows = [(i, " ".join(language_texts(i, 1, 40)), "en") for i in range(300)]
    rows += [(1000 + i, t, "en") for i, t, _ in rows[:150]]
    random.Random(0).shuffle(rows)
    spark.createDataFrame(rows, COLUMNS).repartition(6).write.parquet(str(tmp_path / "d"))
    kept = simhash.one_of_each(spark.read.parquet(str(tmp_path / "d")))
    key = "spark.sql.files.openCostInBytes"
    spark.conf.set(key, "0")
    try:
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    finally:
        spark.conf.unset(key)


def plain_shingles(text, words=5):
    parts = text.lower().split()
    k = min(words, len(parts))
    return {tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)}


def near_copy(text, draw, share):
    """A text of which about ``share`` of the shingles of both are left, by changed words far apart."""
    parts = text.split()
    changes = round(len(parts) * (1 - share) / (1 + share) / 5)
    for at in draw.sample(range(5, len(parts) - 5, 6), changes):
        parts[at] = f"changed{draw.random()}"
    return " ".join(parts)


@pytest.mark.parametrize("tile", [1 << 19, 2000])
def test_near_duplicate_stage_equals_brute_force(spark, tile):
    draw = random.Random(1)
    texts = [t for k in range(40) for t in language_texts(k, 1, 200 + 7 * k)]
    for share in (0.6, 0.75, 0.8, 0.82, 0.85, 0.9, 0.95):
        texts += [near_copy(t, draw, share) for t in texts[:40]]
    texts += [texts[0].upper(), texts[1] + "  ", "two words", "Two  words", "two other words", "", " "]
    texts += [near_copy(texts[2], draw, 0.97) for _ in range(60)]  # a large group
    draw.shuffle(texts)
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                a, b = root[i], root[j]
                if a != b:
                    root = [min(a, b) if r in (a, b) else r for r in root]
    assert links > 200
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], COLUMNS).repartition(3)
    kept = simhash.one_of_each(docs, tile=tile)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_bounds_are_of_rows_not_of_ids(spark):
    rows = [(1, "one text of many", "en")] * 300 + [(3, "une autre", "fr"), (4, "autre encore", "fr")]
    docs = spark.createDataFrame(rows, COLUMNS)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", 2, lambda c: docs[c])
    assert sample.count() == 2
    got = langid.sample(docs, 2).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 2, "fr": 2}


def planted(n=400):
    """Documents in two learned languages, some toxic, with copies, an unlearned language and odd rows."""
    draw = random.Random(4)
    rude = ["you stupid idiot", "worthless disgusting trash", "shut up moron", "i hate you pathetic loser"]
    docs, labels = [], []
    for code in ("en", "fr"):
        for t in language_texts(code == "fr", n, 80):
            toxic = draw.random() < 0.3
            words = t.split()
            if toxic:
                for _ in range(6):
                    words.insert(draw.randrange(len(words)), draw.choice(rude))
            docs.append((len(docs), " ".join(words), code, toxic))
    labels = [(i, 0, int(toxic)) for i, _, _, toxic in docs]
    clean = [d for d in docs if not d[3]]
    docs += [(1000 + i, t, code, x) for i, t, code, x in clean[:5]]  # copies of larger id
    docs += [(2000 + k, t, None, False) for k, t in enumerate(language_texts(77, 6, 80))]
    docs += [(3000, None, None, False), (3001, "", None, False), (3002, "12 34 !!", None, False), (None, None, None, False)]
    return docs, labels


def test_whole_pipeline_with_planted_documents(spark, tmp_path):
    docs, labels = planted()
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang, _ in docs], COLUMNS + ", source string, n_chars long")
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == table.columns
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
    toxic = {i for i, _, _, x in docs if x and i in kept["language"]}
    assert not {i for i in kept["language"] if i is None or i >= 2000}
    assert len(kept["language"]) >= 0.95 * 800
    assert len(toxic - kept["toxicity"]) >= 0.9 * len(toxic)
    assert len(kept["toxicity"]) >= 0.95 * (len(kept["language"]) - len(toxic))
    copies = {i for i in kept["toxicity"] if i >= 1000}
    assert kept["near_duplicates"] == {i for i in kept["toxicity"] if not (i in copies and any(
        d[0] in kept["toxicity"] and d[0] < 1000 and d[1] == next(x[1] for x in docs if x[0] == i) for d in docs if d[0] is not None))}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == kept["near_duplicates"]
    from tokenizers import Tokenizer

    from lumenbib.llm.queries import vocabulary

    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {d[0]: len(model.encode(d[1], add_special_tokens=False).ids) + 1 for d in docs if d[0] in kept["near_duplicates"]}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096
