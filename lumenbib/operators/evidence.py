"""Evidence snippets: title, matching abstract sentences and keywords, at most a handful per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.text import missing_if_blank, no_nulls, split_sentences, term_in_raw_text

ITEM = "struct<source:string,text:string,relevance:string,confidence:double>"
# Snippet lengths, confidences and the text of the fallback item.
TITLE_CHARS, TEXT_CHARS = 240, 320
WEAK_TEXT = "No strong evidence extracted from metadata."


def _found(text: Column, lowered: Column, terms: list[str] | Column) -> Column:
    if isinstance(terms, list):
        found = F.lit(False)
        for term in terms:
            found = found | term_in_raw_text(term, text, lowered)
        return found
    return F.exists(terms, lambda t: term_in_raw_text(t, text, lowered))


def matches_any(text: Column, terms: list[str] | Column) -> Column:
    return _found(text, F.lower(text), terms)


def matching(texts: Column, terms: list[str] | Column) -> Column:
    """The texts of a list that hold a term; each text is lowered once."""
    paired = F.transform(texts, lambda s: F.struct(s.alias("text"), F.lower(s).alias("low")))
    return F.transform(F.filter(paired, lambda p: _found(p["text"], p["low"], terms)), lambda p: p["text"])


def _item(source: str, text: Column, relevance: str, confidence: float) -> Column:
    return F.struct(
        F.lit(source).alias("source"),
        text.alias("text"),
        F.lit(relevance).alias("relevance"),
        F.lit(confidence).alias("confidence"),
    ).cast(ITEM)


def with_evidence(papers: DataFrame, terms: list[str] | Column) -> DataFrame:
    """Add ``evidence_items``: title and sentences up to three, then keywords if there is room."""
    nothing = F.array().cast(f"array<{ITEM}>")
    title = F.coalesce("title", F.lit(""))
    by_title = F.when(
        (title != "") & matches_any(title, terms),
        F.array(_item("title", F.substring(title, 1, TITLE_CHARS), "matched_topic", 0.9)),
    ).otherwise(nothing)
    sentences = matching(split_sentences("abstract"), terms)
    by_text = F.transform(
        F.slice(sentences, 1, 3), lambda s: _item("abstract", F.substring(s, 1, TEXT_CHARS), "matched_topic", 0.75)
    )
    staged = papers.withColumn("_items", F.slice(F.concat(by_title, by_text), 1, 3))
    keywords = matching(no_nulls("keywords"), terms)
    joined = missing_if_blank(F.substring(F.array_join(F.slice(keywords, 1, 6), "; "), 1, TEXT_CHARS))
    by_keyword = F.when(
        (F.size("_items") < 3) & joined.isNotNull(), F.array(_item("keywords", joined, "matched_topic", 0.7))
    ).otherwise(nothing)
    staged = staged.withColumn("_items", F.concat("_items", by_keyword))
    weak = F.array(_item("metadata", F.lit(WEAK_TEXT), "weak", 0.3))
    return staged.withColumn(
        "evidence_items", F.when(F.size("_items") > 0, F.col("_items")).otherwise(weak)
    ).drop("_items")


def evidence_stats(papers: DataFrame) -> DataFrame:
    first = F.get("evidence_items", F.lit(0))
    return papers.agg(
        F.coalesce(F.sum(F.size("evidence_items")), F.lit(0)).cast("long").alias("evidence_extracted"),
        F.count_if((F.size("evidence_items") == 1) & (first["source"] == "metadata")).alias("evidence_missing_count"),
    )
