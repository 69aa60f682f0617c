import random

import pytest
from pyspark.sql import functions as F

from lumenbib.config import load_scoring_config, scoring_config
from lumenbib.operators import evidence, feedback as fb, report, score, select
from lumenbib.plans.search import typed_nulls


def test_config_merges():
    merged = scoring_config({"weights": {"year": 0.5}, "new": 1})
    assert merged["weights"]["year"] == 0.5 and merged["weights"]["relevance"] == 0.40 and merged["new"] == 1
    assert load_scoring_config("/nonexistent.yaml") == scoring_config()


def test_year_citation_access_type(spark):
    config = scoring_config()
    rows = spark.createDataFrame([(2026, 0), (2021, 0), (2016, 0), (2000, 0), (None, 0), (2024, 100)], "year int, citation_count int")
    got = rows.select(score.year_score(2026, config).alias("y"), score.citation_score(2026).alias("c")).collect()
    assert [r["y"] for r in got[:5]] == [100, 85, 65, 35, 35] and got[5]["c"] == 76.62
    links = spark.createDataFrame(
        [("u", None, None, None), ("", "l", "unknown", None), (None, None, None, "d"), (None, "l", "", None)],
        "pdf_url string, landing_page_url string, open_access_status string, doi string",
    )
    assert [r[0] for r in links.select(score.access_score(config)).collect()] == [100, 70, 40, 0]
    kinds = spark.createDataFrame([("Journal-Article",), ("conference",), ("preprint",), ("book-chapter",), ("article",), (None,)], "paper_type string")
    assert [r[0] for r in kinds.select(score.type_score(config)).collect()] == [100, 80, 75, 60, 50, 50]


def final(spark, **parts):
    row = {"rule_score": 60.0, "llm_final_score": None, "llm_confidence": None, "llm_decision": None, "embedding_score": None, "human_feedback_score": None, **parts}
    schema = ", ".join(f"{k} {'string' if k == 'llm_decision' else 'double'}" for k in row)
    return score.final_scores(spark.createDataFrame([tuple(row.values())], schema)).first()


def test_final_score_cases(spark):
    r = final(spark, llm_final_score=80.0, llm_confidence=40.0)
    assert (r["final_score"], r["final_decision"], r["final_confidence"]) == (68.06, "background", 40.0)
    assert final(spark, llm_final_score=80.0, llm_confidence=40.0, embedding_score=70.0)["final_score"] == 68.31
    r = final(spark, llm_final_score=80.0, llm_confidence=40.0, embedding_score=70.0, human_feedback_score=95.0)
    assert r["final_score"] == 69.94
    assert final(spark, llm_final_score=74.0, llm_confidence=70.0, llm_decision="core")["final_decision"] == "core"
    assert final(spark, llm_final_score=74.0, llm_confidence=69.0, llm_decision="core")["final_decision"] == "background"
    assert final(spark)["final_confidence"] == 76.0


def test_bins(spark):
    rows = spark.createDataFrame([(x,) for x in (39.99, 40.0, 59.99, 60.0, 75.0, 85.0, 100.0)], "s double")
    assert [r["papers"] for r in report.score_bins(rows, "s").collect()] == [1, 2, 1, 1, 2]


def test_evidence(spark):
    rows = spark.createDataFrame(
        [("Energy now", "energy a. energy b. energy c. energy d.", ["energy k"]), ("none", "nothing", ["x"]), ("x", "Uses ENERGY here", ["Energy", "y"])],
        "title string, abstract string, keywords array<string>",
    )
    got = [r["evidence_items"] for r in evidence.with_evidence(rows, ["energy"]).collect()]
    assert [i["source"] for i in got[0]] == ["title", "abstract", "abstract"]
    assert [i["source"] for i in got[1]] == ["metadata"] and [i["source"] for i in got[2]] == ["abstract", "keywords"]
    by_column = evidence.with_evidence(rows.withColumn("t", F.array(F.lit("energy"))), F.col("t"))
    assert [r["evidence_items"] for r in by_column.collect()] == got


def test_feedback_scores(spark):
    rows = spark.createDataFrame([("150", "core"), ("", "Background"), ("abc", "unsure"), ("", "")], "feedback_score string, human_label string")
    assert [r[0] for r in rows.select(fb.feedback_score()).collect()] == [100, 70, 50, None]


def test_similar_titles_are_complete(spark):
    rng = random.Random(11)

    def spoil(t):
        chars = list(t)
        for _ in range(rng.randint(0, 6)):
            if not chars:  # a short title can lose all its characters
                break
            i = rng.randrange(len(chars))
            chars[i : i + 1] = rng.choice([[], ["x"], [chars[i], "q"]])
        return "".join(chars)

    left = list({" ".join("".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 8))) for _ in range(60)})
    right = list({spoil(t) for t in left for _ in range(3)} - {""})
    a = spark.createDataFrame([(t,) for t in left], "title string")
    b = spark.createDataFrame([(t,) for t in right], "feedback_title string")
    got = {(r["title"], r["feedback_title"]) for r in fb.similar_titles(a, b).collect()}
    pairs = [(x, y) for x in left for y in right]
    ratios = fb_ratios(pairs)
    assert got == {p for p, r in zip(pairs, ratios) if r >= 92} and len(got) > 50


def fb_ratios(pairs):
    from lumenbib.functions.similarity import indel_ratio_values

    return indel_ratio_values([a for a, _ in pairs], [b for _, b in pairs])


def test_feedback_by_title_takes_first_best(spark):
    papers = spark.createDataFrame([(1, "10.1/A", "x"), (2, None, "Energy policy in China"), (3, None, "other")], "seq long, doi string, title string")
    rows = [(0, "10.1/a", "x", "core", ""), (1, "", "energy policy in chine", "data", ""), (2, "", "Energy: policy in China", "method", ""), (3, "", "energy policy in china", "core", ""), (4, "10.1/a", "", "relevant", "")]
    feedback = spark.createDataFrame(rows, "pos long, doi string, title string, human_label string, feedback_score string")
    got = {r["seq"]: (r["human_label"], r["human_feedback_score"]) for r in fb.apply_feedback(papers, feedback).collect()}
    assert got == {1: ("relevant", 80.0), 2: ("method", 76.0), 3: (None, None)}


def loop_hybrid(scores, threshold, minimum, top_k):
    ordered = sorted(range(len(scores)), key=lambda i: -scores[i])
    chosen = [i for i in ordered if scores[i] >= threshold]
    for i in ordered[: max(top_k, minimum)]:
        if len(chosen) >= min(len(ordered), minimum):
            break
        if i not in chosen:
            chosen.append(i)
    return set(chosen[: max(top_k, minimum)])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hybrid_selection_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    topics = {t: [float(rng.randint(0, 100)) for _ in range(rng.randint(1, 40))] for t in range(12)}
    rows = [(t, i, s, 0) for t, scores in topics.items() for i, s in enumerate(scores)]
    scored = spark.createDataFrame(rows, "topic_id int, seq long, final_score double, citation_count int")
    config = scoring_config({"fallback": {"selection_top_k": 12, "min_selected": 5}})
    got = {}
    for r in select.select_papers(scored, "hybrid", 75.0, 0, ["topic_id"], config).collect():
        got.setdefault(r["topic_id"], set()).add(r["seq"])
    assert got == {t: loop_hybrid(s, 75.0, 5, 12) for t, s in topics.items()}


def test_rubric_candidates(spark):
    scored = spark.createDataFrame([(i, s) for i, s in enumerate([90.0, 80.0, 50.0, 40.0, 30.0])], "seq long, rule_score double")
    config = scoring_config({"fallback": {"min_llm_candidates": 3}})
    assert sorted(r["seq"] for r in select.rubric_candidates(scored, "hybrid", 70.0, config=config).collect()) == [0, 1, 2]


def test_typed_nulls_and_scores_with_lists(spark):
    rows = spark.createDataFrame([(1.0,)], "rule_score double")
    assert "embedding_score" in typed_nulls(rows).columns


def test_scoring_config_overrides_one_level():
    from lumenbib.config import DEFAULTS, scoring_config

    assert scoring_config() == scoring_config({}) == DEFAULTS
    own = scoring_config({"weights": {"relevance": 0.5}, "extra": [1]})
    assert own["weights"] == {**DEFAULTS["weights"], "relevance": 0.5} and own["extra"] == [1]
    own["weights"]["relevance"] = 9
    assert DEFAULTS["weights"]["relevance"] == 0.40
    with pytest.raises(TypeError, match="weights"):
        scoring_config({"weights": 3})
