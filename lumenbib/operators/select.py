"""Candidate, paper and card selection for any number of topics at once.

The papers are sorted by score, so the ones over a threshold form a prefix and "fill up to a
minimum" extends it. A hybrid choice is therefore: over the threshold, or among the first
``minimum``. No row is counted per topic and only ranked heads are shuffled.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.config import scoring_config


def final_or_rule() -> Column:
    return F.coalesce(F.nullif("final_score", F.lit(0.0)), F.col("rule_score"))


def _score(name: str) -> Column:
    return F.coalesce(name, F.lit(0.0))


def best_first(score: Column | None = None) -> list[Column]:
    """Final score, citations, arrival."""
    score = _score("final_score") if score is None else score
    return [score.desc(), F.coalesce("citation_count", F.lit(0)).desc(), F.col("seq").asc()]


def head(papers: DataFrame, size: int, order: list[Column], by: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """First ``size`` rows per group with their rank; each task forwards at most ``size`` rows per group."""
    if not by:
        top = papers.orderBy(*order).limit(size)
        w = Window.partitionBy(F.lit(1)).orderBy(*order)
        return top.withColumn(rank, F.row_number().over(w))
    w = Window.partitionBy(*by).orderBy(*order)
    return papers.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= size)


def _over_or_first(papers: DataFrame, over: Column, minimum: int, order: list[Column], by: list[str] | None) -> DataFrame:
    first = head(papers, minimum, order, by).drop("rank")
    return papers.filter(over).unionByName(first.filter(~over))


def rubric_candidates(
    scored: DataFrame,
    mode: str = "hybrid",
    rule_threshold: float = 60.0,
    by: list[str] | None = None,
    config: dict[str, Any] | None = None,
) -> DataFrame:
    """Papers worth an outside model call, by rule score."""
    config = config or scoring_config()
    fallback = config["fallback"]
    floor = max(rule_threshold, float(config["llm_rubric"]["min_rule_score"]))
    over = F.col("rule_score") >= floor
    order = [F.col("rule_score").desc(), F.col("seq").asc()]
    if mode == "threshold":
        return scored.filter(over)
    if mode == "topk":
        return head(scored, fallback["llm_candidate_top_k"], order, by).drop("rank")
    return _over_or_first(scored, over, fallback["min_llm_candidates"], order, by)


def select_papers(
    scored: DataFrame,
    mode: str = "hybrid",
    threshold: float = 75.0,
    limit: int = 500,
    by: list[str] | None = None,
    config: dict[str, Any] | None = None,
) -> DataFrame:
    """Final selection by final score; ``limit=0`` keeps all that qualify."""
    fallback = (config or scoring_config())["fallback"]
    over = _score("final_score") >= threshold
    order = best_first()
    if mode == "threshold":
        chosen = scored.filter(over)
        return head(chosen, limit, order, by).drop("rank") if limit > 0 else chosen
    most = fallback["selection_top_k"]
    if mode == "hybrid":
        most = max(most, fallback["min_selected"])
    if limit > 0:
        most = min(most, limit)
    top = head(scored, most, order, by)
    if mode == "hybrid":
        top = top.filter(over | (F.col("rank") <= fallback["min_selected"]))
    return top.drop("rank")


def selection_stats(scored: DataFrame, selected: DataFrame, threshold: float, minimum: int) -> DataFrame:
    passed = scored.agg(F.count_if(_score("final_score") >= threshold).alias("threshold_selected"))
    chosen = selected.agg(F.count(F.lit(1)))
    return passed.withColumn("selected_count", chosen.scalar()).withColumn("fallback_topk_used", F.col("threshold_selected") < minimum)


def card_papers(
    scored: DataFrame,
    selected: DataFrame,
    mode: str = "auto",
    top_k: int = 30,
    threshold: float = 0.0,
    by: list[str] | None = None,
    downloaded: DataFrame | None = None,
) -> DataFrame:
    """Papers that get a card, with ``card_group`` (0 selected, 1 filled up) and ``card_rank``."""
    order = best_first(final_or_rule())
    kept = scored.filter(_score("final_score") >= threshold)
    keys = [*(by or []), "seq"]
    first = head(selected.withColumn("card_group", F.lit(0)), top_k, order, by)
    if mode == "selected":
        return first.withColumnRenamed("rank", "card_rank")
    if mode == "downloaded":
        source = (selected.limit(0) if downloaded is None else downloaded).withColumn("card_group", F.lit(0))
        return head(source, top_k, [F.col("seq").asc()], by, "card_rank")
    fill = head(kept.withColumn("card_group", F.lit(1)), top_k, order, by)
    if mode == "scored":
        return fill.withColumnRenamed("rank", "card_rank")
    # auto: a topic with selected papers fills up from all scored ones, a topic without from the kept ones.
    pool = scored.join(selected.select(*keys), keys, "left_anti").withColumn("card_group", F.lit(1))
    if by:
        pool = pool.join(selected.select(*by).distinct().withColumn("has_selected", F.lit(True)), by, "left")
        some = F.coalesce("has_selected", F.lit(False))
    else:
        some = selected.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    pool = pool.filter(some | (_score("final_score") >= threshold)).drop("has_selected")
    both = first.drop("rank").unionByName(head(pool, top_k, order, by).drop("rank"))
    return head(both, top_k, [F.col("card_group").asc(), *order], by, "card_rank")


def top_papers(scored: DataFrame, size: int = 20, by: list[str] | None = None) -> DataFrame:
    return head(scored, size, best_first(), by)
