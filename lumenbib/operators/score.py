"""Rule scores, similarity scores, final score and decision as column arithmetic.

Term lists are either Python lists (one topic: unrolled into generated code) or array columns
(many topics: the lists travel with the topic-paper pairs).
"""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.config import scoring_config
from lumenbib.functions.similarity import best_set_ratio, token_set_ratio
from lumenbib.functions.text import CJK, has_cjk, missing_if_blank, no_nulls, ordered_distinct, round2, term_in_text

Terms = list[str] | Column
# Weight of a CJK term, length of the abstract head and number of queries in the fuzzy part.
CJK_WEIGHT = 1.2
FUZZY_HEAD = 1200
FUZZY_QUERIES = 10


def _one(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def _total(values: list[Column]) -> Column:
    """Balanced sum: keeps the expression tree shallow for long term lists."""
    if not values:
        return F.lit(0.0)
    while len(values) > 1:
        values = [sum(values[i : i + 2][1:], values[i]) for i in range(0, len(values), 2)]
    return values[0]


def field_match(text: Column, terms: Terms) -> Column:
    """Weighted share of the terms found in a lower-cased field, in percent; 0 for a blank field."""
    if isinstance(terms, list):
        weights = [CJK_WEIGHT if re.search(CJK, t) else 1.0 for t in terms]
        hits = _total([_one(term_in_text(t, text)) * w for t, w in zip(terms, weights)])
        score = 100.0 * (hits / sum(weights)) if terms else F.lit(0.0)
    else:
        def weight(t: Column) -> Column:
            return F.when(has_cjk(t), CJK_WEIGHT).otherwise(1.0)

        hits = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + _one(term_in_text(t, text)) * weight(t))
        whole = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + weight(t))
        score = F.when(whole > 0, 100.0 * (hits / whole)).otherwise(0.0)
    return F.when(missing_if_blank(text).isNull(), 0.0).otherwise(score)


def share_found(text: Column, terms: Terms) -> Column:
    """Unweighted share of the terms found, in percent."""
    if isinstance(terms, list):
        hits = _total([_one(term_in_text(t, text)) for t in terms])
        return 100.0 * hits / max(1, len(terms))
    hits = F.size(F.filter(terms, lambda t: term_in_text(t, text))).cast("double")
    return 100.0 * hits / F.greatest(F.lit(1), F.size(terms))


def paper_keywords() -> Column:
    """Keywords, concepts, topics, subjects and primary topic, each once."""
    extra = F.when(missing_if_blank("primary_topic").isNotNull(), F.array("primary_topic")).otherwise(
        F.array().cast("array<string>")
    )
    parts = [no_nulls(c) for c in ("keywords", "concepts", "topics", "subjects")]
    return ordered_distinct(F.concat(*parts, extra))


def with_texts(papers: DataFrame) -> DataFrame:
    low = papers.withColumns(
        {
            "title_text": F.lower(F.coalesce("title", F.lit(""))),
            "abstract_text": F.lower(F.coalesce("abstract", F.lit(""))),
            "keyword_text": F.lower(F.array_join(paper_keywords(), " ")),
        }
    )
    return low.withColumn("whole_text", F.concat_ws(" ", "title_text", "abstract_text", "keyword_text"))


def with_matches(papers: DataFrame, terms: Terms, phrases: Terms) -> DataFrame:
    """Title, abstract, keyword, phrase and coverage scores (unrounded, prefixed ``_``)."""
    texts = with_texts(papers)
    scored = texts.withColumns(
        {
            "_title": field_match(F.col("title_text"), terms),
            "_abstract": field_match(F.col("abstract_text"), terms),
            "_keyword": field_match(F.col("keyword_text"), terms),
            "_phrase": F.least(F.lit(100.0), share_found(F.col("whole_text"), phrases)),
            "_coverage": share_found(F.col("whole_text"), terms),
        }
    )
    return scored.withColumn("_keyword", F.least(F.lit(100.0), 0.7 * F.col("_keyword") + 0.3 * F.col("_coverage")))


def fuzzy_match(topic: Column, loose: Column) -> Column:
    """Set ratio of the title with the topic and of the abstract head with its best query."""
    by_title = token_set_ratio(F.col("title_text"), F.lower(topic))
    queries = F.transform(F.slice(loose, 1, FUZZY_QUERIES), lambda q: F.lower(q))
    by_abstract = best_set_ratio(F.substring(F.col("abstract_text"), 1, FUZZY_HEAD), queries)
    return F.least(F.lit(100.0), 0.6 * by_title + 0.4 * by_abstract)


def year_score(as_of_year: int, config: dict[str, Any]) -> Column:
    table, age = config["year_score"], F.lit(as_of_year) - F.col("year")
    base = (
        F.when(F.coalesce("year", F.lit(0)) == 0, float(table["older"]))
        .when(age <= 3, float(table["recent_3_years"]))
        .when(age <= 5, float(table["recent_5_years"]))
        .when(age <= 10, float(table["recent_10_years"]))
        .otherwise(float(table["older"]))
    )
    cited = F.coalesce("citation_count", F.lit(0))
    bonus = F.when(cited >= 500, 10.0).when(cited >= 100, 5.0).otherwise(0.0)
    return F.least(F.lit(100.0), base + bonus)


def citation_score(as_of_year: int) -> Column:
    cited = F.coalesce("citation_count", F.lit(0)).cast("double")
    span = F.when(
        F.coalesce("year", F.lit(0)) != 0, F.greatest(F.lit(1), F.lit(as_of_year) - F.col("year") + 1).cast("double")
    ).otherwise(1.0)
    score = 100.0 * F.log1p(cited / span) / F.lit(math.log1p(100))
    return F.when(cited <= 0, 0.0).otherwise(round2(F.least(F.lit(100.0), score)))


def journal_score(config: dict[str, Any]) -> Column:
    table = {str(k): float(v) for k, v in config["journal_score"].items()}
    default = table.get("unknown", 50.0)
    score = F.lit(default)
    for name, value in table.items():
        score = F.when(F.col("quartile") == name, value).otherwise(
            F.when(F.upper("quartile") == name, value).otherwise(score)
        )
    return score


def access_score(config: dict[str, Any]) -> Column:
    table = config["access_score"]

    def given(name: str) -> Column:
        return missing_if_blank(name).isNotNull()

    return (
        F.when(given("pdf_url"), float(table["has_pdf"]))
        .when(given("landing_page_url") & given("open_access_status"), float(table["has_oa_landing_page"]))
        .when(given("doi"), float(table["has_doi_only"]))
        .otherwise(float(table["no_access"]))
    )


def type_score(config: dict[str, Any]) -> Column:
    table, kind = config["type_score"], F.lower(F.coalesce("paper_type", F.lit("")))

    def has(piece: str) -> Column:
        return F.contains(kind, F.lit(piece))

    return (
        F.when(has("journal"), float(table["journal_article"]))
        .when(has("proceeding") | has("conference"), float(table["proceedings_article"]))
        .when(has("preprint"), float(table["preprint"]))
        .when(has("book") | has("chapter"), float(table["book_chapter"]))
        .otherwise(float(table["unknown"]))
    )


def rule_labels(as_of_year: int) -> Column:
    tests = {
        "high_relevance": F.col("relevance_score") >= 75,
        "good_query_coverage": F.col("query_coverage_score") >= 60,
        "recent": (F.col("year") != 0) & (F.col("year") >= as_of_year - 3),
        "highly_cited": F.col("citation_count") >= 100,
        "open_access": missing_if_blank("open_access_status").isNotNull(),
    }
    return F.array_compact(F.array(*[F.when(test, label) for label, test in tests.items()]))


def rule_scores(
    papers: DataFrame,
    terms: Terms,
    phrases: Terms,
    topic: Column,
    loose: Column | None,
    as_of_year: int,
    config: dict[str, Any] | None = None,
) -> DataFrame:
    """All rule scores of papers that carry ``quartile``. ``loose=None`` leaves the fuzzy part at 0.

    ``terms``/``phrases``/``topic``/``loose`` are literals or columns of ``papers``.
    """
    config = config or scoring_config()
    matched = with_matches(papers, terms, phrases)
    fuzzy = fuzzy_match(topic, loose) if loose is not None else F.lit(0.0)
    matched = matched.withColumn("_fuzzy", fuzzy)
    relevance = (
        0.30 * F.col("_title")
        + 0.25 * F.col("_abstract")
        + 0.20 * F.col("_keyword")
        + 0.15 * F.col("_phrase")
        + 0.10 * F.col("_fuzzy")
    )
    scored = matched.withColumns(
        {
            "title_match_score": round2(F.col("_title")),
            "abstract_match_score": round2(F.col("_abstract")),
            "keyword_match_score": round2(F.col("_keyword")),
            "phrase_match_score": round2(F.col("_phrase")),
            "fuzzy_match_score": round2(F.col("_fuzzy")),
            "query_coverage_score": round2(F.col("_coverage")),
            "relevance_score": round2(F.least(F.lit(100.0), relevance)),
            "year_score": year_score(as_of_year, config),
            "citation_score": citation_score(as_of_year),
            "journal_score": journal_score(config),
            "access_score": access_score(config),
            "type_score": type_score(config),
        }
    )
    weights = config["weights"]
    parts = ["relevance", "year", "citation", "journal", "access", "type"]
    total = F.lit(0.0)
    for part in parts:
        total = total + float(weights.get(part, 0)) * F.col(f"{part}_score")
    scored = scored.withColumn("rule_score", round2(F.least(F.lit(100.0), total)))
    scored = scored.withColumn("labels", rule_labels(as_of_year))
    texts = ["title_text", "abstract_text", "keyword_text", "whole_text"]
    return scored.drop(*texts, "_title", "_abstract", "_keyword", "_phrase", "_coverage", "_fuzzy")


def rule_stats(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rule_scored"),
        F.count_if(F.col("rule_score") >= threshold).alias("rule_passed"),
        F.coalesce(round2(F.avg("rule_score")), F.lit(0.0)).alias("rule_score_avg"),
        F.coalesce(round2(F.max("rule_score")), F.lit(0.0)).alias("rule_score_max"),
    )


def passed_rules(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("rule_score") >= threshold)


# ---------------------------------------------------------------- vectors


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x) / (vector_norm(a) * vector_norm(b))


def similarity_score(a: Column, b: Column) -> Column:
    """Cosine on 0..100; null where a vector is missing."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (cosine(a, b) + 1.0) * 50.0))
    return F.when(a.isNotNull() & b.isNotNull(), round2(clipped))


def combined_similarity(*parts: Column) -> Column:
    """Mean of the parts that exist."""
    number = sum((F.when(p.isNotNull(), 1.0).otherwise(0.0) for p in parts), F.lit(0.0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(number > 0, total / number)


def similarity_stats(scored: DataFrame, column: str = "embedding_score") -> DataFrame:
    return scored.agg(
        F.count_if(F.col(column).isNotNull()).alias("embedding_scored"),
        F.count_if(F.col(column).isNull()).alias("embedding_failed"),
    )


def encode_texts(texts: DataFrame, column: str, load_encoder) -> DataFrame:
    """Add ``vector`` by a user-supplied encoder: ``load_encoder()`` runs once per task and returns
    a callable from a list of texts to a list of unit vectors. Blank texts get null."""
    from pyspark.sql import types as T

    schema = T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches):
        encoder = load_encoder()
        for batch in batches:
            values = batch[column].fillna("").str.strip()
            given = values[values != ""]
            vectors = dict(zip(given.index, encoder(given.tolist()))) if len(given) else {}
            batch["vector"] = [None if i not in vectors else [float(x) for x in vectors[i]] for i in batch.index]
            yield batch

    return texts.mapInPandas(run, schema)


# ---------------------------------------------------------------- final score


def decision(score: Column, config: dict[str, Any] | None = None) -> Column:
    table = (config or scoring_config())["decision_thresholds"]
    steps = ["core", "important", "background", "peripheral"]
    out = F.when(score >= float(table[steps[0]]), steps[0])
    for step in steps[1:]:
        out = out.when(score >= float(table[step]), step)
    return out.otherwise("irrelevant")


def final_scores(scored: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """Weighted mean of the available parts, decision and confidence.

    Reads ``rule_score, llm_final_score, llm_confidence, llm_decision, embedding_score,
    human_feedback_score``; an unsure rubric counts 60 % of its weight, a sure one decides.
    """
    config = config or scoring_config()
    weights = config["final_score_weights"]
    sure = F.coalesce("llm_confidence", F.lit(60.0))
    rubric_weight = float(weights.get("llm_rubric_score", 0.45))
    parts = {
        "rule_score": F.lit(float(weights.get("rule_score", 0.40))),
        "llm_final_score": F.when(sure < 50, rubric_weight * 0.6).otherwise(rubric_weight),
        "embedding_score": F.lit(float(weights.get("embedding_score", 0.10))),
        "human_feedback_score": F.lit(float(weights.get("human_feedback_score", 0.05))),
    }
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    weighted = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    mean = F.when(weight > 0, weighted / weight).otherwise(F.col("rule_score"))
    out = scored.withColumn("final_score", round2(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean))))
    confident = F.nullif("llm_confidence", F.lit(0.0))
    overruled = missing_if_blank("llm_decision").isNotNull() & F.coalesce(confident >= 70, F.lit(False))
    own = F.greatest(F.lit(35.0), F.least(F.lit(95.0), 40.0 + F.col("final_score") * 0.6))
    return out.withColumns(
        {
            "final_decision": F.when(overruled, F.col("llm_decision")).otherwise(decision(F.col("final_score"), config)),
            "final_confidence": F.coalesce("llm_confidence", round2(own)),
        }
    )
