"""Human feedback: by DOI where possible, else by the closest title at 92 or more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.similarity import bounded_indel_ratio
from lumenbib.functions.text import missing_if_blank, normalize_doi, normalize_title, strip
from lumenbib.operators import title_pairs
from lumenbib.session import cut_lineage

# Scores of the labels.
LABEL_SCORES = {
    "core": 95.0,
    "relevant": 80.0,
    "background": 70.0,
    "method": 76.0,
    "data": 74.0,
    "irrelevant": 20.0,
    "unsure": 50.0,
}


def feedback_label(label: Column | str = "human_label") -> Column:
    return missing_if_blank(F.lower(strip(label)))


def feedback_score(raw: Column | str = "feedback_score", label: Column | str = "human_label") -> Column:
    """An explicit number clipped to 0..100, else the score of the label."""
    number = strip(raw).try_cast("double")
    clipped = F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)))
    name = feedback_label(label)
    by_label = F.coalesce(*[F.when(name == k, v) for k, v in LABEL_SCORES.items()])
    return F.coalesce(clipped, by_label)


def _rows(feedback: DataFrame) -> DataFrame:
    return feedback.select(
        F.col("pos").alias("feedback_pos"),
        normalize_doi("doi").alias("feedback_doi"),
        missing_if_blank(normalize_title("title")).alias("feedback_title"),
        feedback_label().alias("human_label"),
        feedback_score().alias("human_feedback_score"),
    )


def match_by_doi(papers: DataFrame, feedback: DataFrame) -> DataFrame:
    """``(seq, human_label, human_feedback_score)`` for papers whose DOI is in the feedback; last row wins."""
    answer = F.struct("human_label", "human_feedback_score")
    last = (
        _rows(feedback)
        .filter("feedback_doi is not null")
        .groupBy("feedback_doi")
        .agg(F.max_by(answer, "feedback_pos").alias("answer"))
    )
    keyed = papers.select("seq", normalize_doi("doi").alias("feedback_doi"))
    return keyed.join(last, "feedback_doi").select("seq", "answer.*")


def similar_titles(left: DataFrame, right: DataFrame, threshold: float = 92.0) -> DataFrame:
    """Pairs ``(title, feedback_title, ratio)`` of distinct titles with an indel ratio over the threshold."""
    known = right.select(F.col("feedback_title").alias("title"), F.lit(0).alias("rank"))
    pairs = title_pairs.similar_titles(left.select("title"), known, threshold / 100.0, bounded_indel_ratio)
    return pairs.select(F.col("left_title").alias("title"), F.col("right_title").alias("feedback_title"), (F.col("ratio") * 100.0).alias("ratio"))


def match_by_title(papers: DataFrame, feedback: DataFrame, threshold: float = 92.0) -> DataFrame:
    """``(seq, human_label, human_feedback_score)`` by the closest title, the earliest row on ties."""
    rows = _rows(feedback).filter("feedback_title is not null")
    first = cut_lineage(rows.groupBy("feedback_title").agg(
        F.min_by(F.struct("feedback_pos", "human_label", "human_feedback_score"), "feedback_pos").alias("answer")
    ))
    keyed = cut_lineage(papers.select("seq", missing_if_blank(normalize_title("title")).alias("title")).filter("title is not null"))
    known = first.select(F.col("feedback_title").alias("title"), F.col("answer.feedback_pos").alias("rank"))
    asked = keyed.select("title").distinct()
    pairs = title_pairs.similar_titles(asked, known, threshold / 100.0, bounded_indel_ratio, best=True)
    pairs = pairs.withColumnsRenamed({"left_title": "title", "right_title": "feedback_title"})
    best = pairs.join(first, "feedback_title").select("title", "answer")
    return keyed.join(best, "title").select("seq", "answer.human_label", "answer.human_feedback_score")


def apply_feedback(papers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Add ``human_label`` and ``human_feedback_score``: DOI match first, title match for the rest."""
    by_doi = match_by_doi(papers, feedback)
    rest = papers.join(by_doi.select("seq"), "seq", "left_anti")
    matched = by_doi.unionByName(match_by_title(rest, feedback)).withColumn("feedback_applied", F.lit(True))
    joined = papers.join(matched, "seq", "left")
    return joined.withColumn("feedback_applied", F.coalesce("feedback_applied", F.lit(False)))
