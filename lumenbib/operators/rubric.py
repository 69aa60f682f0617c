"""Rubric scoring by an outside model: prompt column, batched call, tolerant parse, field coercion."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.functions.text import col, missing_if_blank, no_nulls, round2, strip
from lumenbib.operators.evidence import ITEM

DIMENSIONS = [
    "topic_relevance",
    "object_relevance",
    "method_relevance",
    "data_relevance",
    "novelty",
    "citation_value",
    "writing_value",
    "policy_relevance",
    "confidence",
    "final_llm_score",
]
TEXTS = ["decision", "reason"]
LISTS = ["evidence", "usable_for", "labels"]

RUBRIC_TEMPLATE = """Rate the paper for the research topic and answer with one JSON object.
Topic: {topic}
Keywords of the topic: {expanded_keywords}
Title: {title}
Year: {year}
Journal: {journal}
Citations: {citation_count}
Paper keywords: {keywords}
Abstract: {abstract}
Fields 0-100: topic_relevance, object_relevance, method_relevance, data_relevance, novelty,
citation_value, writing_value, policy_relevance, confidence, final_llm_score.
Other fields: decision (core, important, background, method, data, peripheral or irrelevant),
usable_for (list), labels (list), evidence (at most three quotes), reason.
"""
RELEVANCE_TEMPLATE = """Rate how relevant the paper is for the topic and answer with one JSON object
with llm_score, paper_type, reason and labels.
Topic: {topic}
Title: {title}
Year: {year}
Journal: {journal}
Citations: {citation_count}
Keywords: {keywords}
Abstract: {abstract}
"""


def _render(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def _paper_values() -> dict[str, Column]:
    return {
        "title": F.col("title"),
        "year": F.nullif("year", F.lit(0)).cast("string"),
        "journal": F.col("journal"),
        "citation_count": F.coalesce("citation_count", F.lit(0)).cast("string"),
        "keywords": F.array_join(no_nulls("keywords"), ", "),
        "abstract": F.col("abstract"),
    }


def rubric_prompt(topic: Column, keywords: Column, template: str = RUBRIC_TEMPLATE) -> Column:
    """Prompt text; ``keywords`` is the list of expanded keywords."""
    return _render(template, {"topic": topic, "expanded_keywords": F.array_join(keywords, ", "), **_paper_values()})


def relevance_prompt(topic: Column, template: str = RELEVANCE_TEMPLATE) -> Column:
    return _render(template, {"topic": topic, **_paper_values()})


def prompt_keywords() -> Column:
    return F.concat(F.slice("english_keywords", 1, 10), F.slice("chinese_keywords", 1, 10))


# ---------------------------------------------------------------- answers


def json_body(c: Column | str) -> Column:
    """The JSON object in an answer: fences off, then the widest braces; null for a JSON list."""
    text = strip(c)
    bare = strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    cleaned = F.when(text.startswith("```"), bare).otherwise(text)
    widest = missing_if_blank(F.regexp_extract(cleaned, r"(?s)\{.*\}", 0))
    return F.when(~(cleaned.startswith("[") & cleaned.endswith("]")), widest)


def _score(raw: Column) -> Column:
    number = F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double"))
    # greatest and least skip nulls, so the null case is kept apart
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)))


def parse_rubric(answer: Column | str) -> Column:
    """Rubric struct of an answer text; null where no JSON object is found."""
    shape = ", ".join(
        [f"{n} string" for n in DIMENSIONS + TEXTS] + [f"{n} array<string>" for n in LISTS] + ["broken string"]
    )
    body = json_body(answer)
    raw = F.from_json(body, shape, {"columnNameOfCorruptRecord": "broken"})
    fields = [_score(raw[n]).alias(n) for n in DIMENSIONS]
    fields += [missing_if_blank(strip(raw[n])).alias(n) for n in TEXTS]
    fields += [
        F.filter(F.transform(no_nulls(raw[n]), lambda v: strip(v)), lambda v: v.isNotNull() & (v != "")).alias(n)
        for n in LISTS
    ]
    usable = body.isNotNull() & raw.isNotNull() & raw["broken"].isNull()
    return F.when(usable, F.struct(*fields))


def apply_rubric(scored: DataFrame) -> DataFrame:
    """Overlay a ``rubric`` column: score, reason, labels, decision, confidence and up to three quotes."""
    rubric = F.col("rubric")
    quotes = F.transform(
        F.slice(F.coalesce(rubric["evidence"], F.array().cast("array<string>")), 1, 3),
        lambda e: F.struct(
            F.lit("llm_rubric").alias("source"),
            e.alias("text"),
            F.lit("llm").alias("relevance"),
            rubric["confidence"].alias("confidence"),
        ).cast(ITEM),
    )
    return scored.withColumns(
        {
            "llm_score": rubric["final_llm_score"],
            "llm_final_score": rubric["final_llm_score"],
            "llm_confidence": rubric["confidence"],
            "llm_decision": rubric["decision"],
            "llm_reason": rubric["reason"],
            "labels": F.array_distinct(F.concat(no_nulls("labels"), no_nulls(rubric["labels"]))),
            "evidence_items": F.concat("evidence_items", quotes),
        }
    )


def parse_relevance(answer: Column | str) -> Column:
    """Simple relevance answer: only a JSON object that has ``llm_score`` counts."""
    text = strip(answer)
    bare = strip(F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    shape = "llm_score string, paper_type string, reason string, labels array<string>"
    raw = F.from_json(F.when(text.startswith("```"), bare).otherwise(text), shape)
    return F.when(raw["llm_score"].isNotNull(), raw)


def apply_relevance(scored: DataFrame) -> DataFrame:
    """Blend a simple relevance answer (``relevance``): 60 % rule score, 40 % model score."""
    answer = F.col("relevance")
    score = _score(answer["llm_score"])
    blend = round2(0.6 * F.col("rule_score") + 0.4 * score)
    return scored.withColumns(
        {
            "llm_score": round2(score),
            "llm_reason": F.when(score.isNotNull(), answer["reason"]),
            "final_score": F.when(answer.isNull(), F.col("final_score")).otherwise(F.coalesce(blend, F.col("rule_score"))),
            "labels": F.when(
                score.isNotNull(), F.array_distinct(F.concat(no_nulls("labels"), no_nulls(answer["labels"])))
            ).otherwise(F.col("labels")),
            "paper_type": F.when(
                score.isNotNull() & missing_if_blank(answer["paper_type"]).isNotNull(), answer["paper_type"]
            ).otherwise(F.col("paper_type")),
        }
    )


# ---------------------------------------------------------------- model call


def _readable(text: str | None) -> bool:
    left, right = (text or "").find("{"), (text or "").rfind("}")
    if left < 0 or right <= left:
        return False
    try:
        return isinstance(json.loads(text[left : right + 1]), dict)
    except ValueError:
        return False


def ask_model(
    prompts: DataFrame,
    load_model: Callable[[], Callable[[list[str]], list[str | None]]],
    parallelism: int | None = None,
    prompt: str = "prompt",
) -> DataFrame:
    """Add ``response`` and ``outcome`` (``scored`` / ``failed``) by a user-supplied model.

    ``load_model()`` runs once per task and returns a callable over a batch of prompts. An answer
    without a JSON object is asked for once more; a failed row stays a row.
    """
    schema = T.StructType(
        [
            *prompts.schema.fields,
            T.StructField("response", T.StringType()),
            T.StructField("outcome", T.StringType()),
        ]
    )
    source = prompts.repartition(parallelism) if parallelism else prompts

    def run(batches):
        model = load_model()
        for batch in batches:
            answers = pd.Series(model(batch[prompt].tolist()), index=batch.index, dtype="object")
            again = [i for i in batch.index if not _readable(answers[i])]
            if again:
                retried = model(batch.loc[again, prompt].tolist())
                for i, answer in zip(again, retried):
                    answers[i] = answer
            batch["response"] = answers
            batch["outcome"] = ["scored" if _readable(a) else "failed" for a in answers]
            yield batch

    return source.mapInPandas(run, schema)


def split_budget(candidates: DataFrame, budget: int, order: list, by: list[str] | None = None) -> DataFrame:
    """Mark the first ``budget`` candidates ``ask`` and the rest ``skipped``.

    The ranked head is cut inside each task, and everybody else gets his mark by an anti-join, so no
    task ranks all candidates.
    """
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    head = candidates.withColumn("budget_rank", F.row_number().over(w)).filter(F.col("budget_rank") <= budget)
    keys = [*(by or []), "seq"]
    rest = candidates.join(head.select(*keys), keys, "left_anti").withColumn("budget_rank", F.lit(None).cast("int"))
    return head.withColumn("outcome_hint", F.lit("ask")).unionByName(rest.withColumn("outcome_hint", F.lit("skipped")))


def rubric_stats(outcomes: DataFrame) -> DataFrame:
    """Run counters over ``outcome``: scored, failed, skipped, cache_hit."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("llm_candidates"),
        F.count_if(F.col("outcome") == "scored").alias("llm_rubric_scored"),
        F.count_if(F.col("outcome") == "failed").alias("llm_rubric_failed"),
        F.count_if(F.col("outcome") == "skipped").alias("llm_skipped"),
        F.count_if(F.col("outcome") == "cache_hit").alias("llm_cache_hit"),
        F.count_if(F.col("outcome").isin("scored", "failed")).alias("llm_cache_miss"),
    )
