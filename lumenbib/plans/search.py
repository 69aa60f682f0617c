"""The whole search as one plan: expand, retrieve, merge, enrich, score, select."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbib.config import scoring_config
from lumenbib.operators.dedup import merge_papers
from lumenbib.operators.enrich import overlay_unpaywall, with_quartile
from lumenbib.operators.evidence import with_evidence
from lumenbib.operators.expand import expand_topics, scoring_lists
from lumenbib.operators.feedback import apply_feedback
from lumenbib.operators.retrieve import retrieve
from lumenbib.operators.rubric import apply_rubric, ask_model, parse_rubric, prompt_keywords, rubric_prompt, split_budget
from lumenbib.operators.score import final_scores, rule_scores
from lumenbib.operators.select import head, rubric_candidates, select_papers
from lumenbib.session import cut_lineage

EMPTY_PARTS = {
    "llm_final_score": "double",
    "llm_confidence": "double",
    "llm_decision": "string",
    "embedding_score": "double",
    "human_label": "string",
    "human_feedback_score": "double",
}


def typed_nulls(scored: DataFrame) -> DataFrame:
    """Add the optional score parts that a run did not produce."""
    missing = {c: F.lit(None).cast(t) for c, t in EMPTY_PARTS.items() if c not in scored.columns}
    return scored.withColumns(missing) if missing else scored


def score_topics(
    pairs: DataFrame, expanded: DataFrame, as_of_year: int, config: dict[str, Any] | None = None, fuzzy: bool = True
) -> DataFrame:
    """Rule scores and evidence of topic-paper pairs (paper columns plus ``topic_id`` and ``quartile``)."""
    lists = scoring_lists(expanded).select("topic_id", "topic", "terms", "evidence_terms", "phrases", "loose")
    joined = pairs.drop("topic").join(lists, "topic_id")
    scored = rule_scores(
        joined,
        F.col("terms"),
        F.col("phrases"),
        F.col("topic"),
        F.col("loose") if fuzzy else None,
        as_of_year,
        config,
    )
    return with_evidence(scored, F.col("evidence_terms")).drop("terms", "evidence_terms", "phrases", "loose")


def search_topics(
    topics: DataFrame,
    papers: DataFrame,
    journals: DataFrame,
    as_of_year: int,
    snapshot: DataFrame | None = None,
    feedback: DataFrame | None = None,
    load_model=None,
    limit: int = 500,
    multiplier: int = 3,
    mode: str = "hybrid",
    threshold: float = 75.0,
    config: dict[str, Any] | None = None,
    merge: bool = True,
) -> dict[str, DataFrame]:
    """Run all stages for many topics; returns the tables of the main stages.

    Records are merged once for the whole corpus, not per topic. Lineage is cut where several later
    tables read a stage: after the merge, after scoring and after the rubric.
    """
    config = config or scoring_config()
    total = max(limit, limit * multiplier)
    merged = cut_lineage(merge_papers(papers)) if merge else papers
    expanded = expand_topics(topics)
    hits = retrieve(expanded, merged, total)
    found = merged.drop("matched_queries").join(hits, "seq")
    found = head(found, total, [F.col("seq").asc()], ["topic_id"]).drop("rank")
    if snapshot is not None:
        found = overlay_unpaywall(found, snapshot)
    scored = cut_lineage(score_topics(with_quartile(found, journals), expanded, as_of_year, config))
    by = ["topic_id"]
    if load_model is not None:
        chosen = rubric_candidates(scored, by=by, config=config)
        order = [F.col("rule_score").desc(), F.col("seq").asc()]
        asked = split_budget(chosen, config["llm_rubric"]["max_papers"], order, by).filter("outcome_hint = 'ask'")
        keywords = expanded.select("topic_id", prompt_keywords().alias("keyword_list"))
        prompts = asked.join(keywords, "topic_id").select(
            "topic_id", "seq", rubric_prompt(F.col("topic"), F.col("keyword_list")).alias("prompt")
        )
        answers = ask_model(prompts, load_model).select("topic_id", "seq", parse_rubric("response").alias("rubric"))
        scored = cut_lineage(apply_rubric(scored.join(answers, ["topic_id", "seq"], "left")))
    if feedback is not None:
        # Labels belong to papers, not to topics.
        labelled = apply_feedback(scored.select("seq", "doi", "title").dropDuplicates(["seq"]), feedback)
        scored = scored.join(labelled.select("seq", "human_label", "human_feedback_score"), "seq", "left")
    final = final_scores(typed_nulls(scored), config)
    selected = select_papers(final, mode, threshold, limit, by, config)
    return {"papers": merged, "expanded": expanded, "scored": final, "selected": selected}


def flagship(papers: DataFrame, journals: DataFrame, terms: list[str], phrases: list[str], loose: list[str], topic: str, as_of_year: int) -> DataFrame:
    """Merge by DOI, look up the journal, score for one topic, keep the twenty best."""
    from lumenbib.operators.dedup import dedup_by_doi
    from lumenbib.operators.select import top_papers

    merged = with_quartile(dedup_by_doi(papers), journals)
    queries = F.array(*[F.lit(q) for q in loose])
    scored = rule_scores(merged, terms, phrases, F.lit(topic), queries, as_of_year)
    top = top_papers(scored.withColumn("final_score", F.col("rule_score")), 20)
    return top.select("rank", "seq", "id", "title", "year", "doi", "quartile", "relevance_score", "rule_score", "final_score")
