"""The typed paper table and arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

# Arrival order of the sources.
SOURCE_ORDER = ["OpenAlex", "Semantic Scholar", "Crossref", "arXiv", "CNKI"]

PAPERS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("keywords", STRINGS),
        T.StructField("authors", STRINGS),
        T.StructField("year", T.IntegerType()),
        T.StructField("doi", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("citation_count", T.IntegerType()),
        T.StructField("source_database", T.StringType()),
        T.StructField("open_access_status", T.StringType()),
        T.StructField("pdf_url", T.StringType()),
        T.StructField("landing_page_url", T.StringType()),
        T.StructField("paper_type", T.StringType()),
        T.StructField("matched_queries", STRINGS),
        T.StructField("concepts", STRINGS),
        T.StructField("topics", STRINGS),
        T.StructField("subjects", STRINGS),
        T.StructField("primary_topic", T.StringType()),
        T.StructField("source_priority", T.StringType()),
        T.StructField("merged_sources", STRINGS),
        T.StructField("source_count", T.IntegerType()),
        T.StructField(
            "cnki",
            T.StructType(
                [
                    T.StructField("download_count", T.IntegerType()),
                    T.StructField("database", T.StringType()),
                    T.StructField("degree_type", T.StringType()),
                    T.StructField("institution", T.StringType()),
                    T.StructField("restricted", T.BooleanType()),
                ]
            ),
        ),
    ]
)

LIST_FIELDS = ["keywords", "authors", "matched_queries", "concepts", "topics", "subjects"]


def source_rank(source: Column | str) -> Column:
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(
        F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), source) - 1, F.lit(len(SOURCE_ORDER))
    ).cast("long")


def assign_seq(papers: DataFrame, position: str = "position") -> DataFrame:
    """Arrival order: fixed source order first, then the landed position inside the source."""
    rank = source_rank("source_database")
    return papers.withColumn("seq", rank * F.lit(1 << 40) + F.col(position).cast("long")).drop(position)


def ordered(papers: DataFrame) -> DataFrame:
    """``papers``, failing on a record without arrival order, which a merge would lose fields of."""
    missing = F.raise_error(F.lit("a record has no arrival order (seq)")).cast("long")
    return papers.withColumn("seq", F.coalesce("seq", missing))


def conform(papers: DataFrame) -> DataFrame:
    """Project to the paper schema; absent columns become typed nulls (empty lists for list columns)."""
    have = set(papers.columns)
    columns = []
    for field in PAPERS.fields:
        empty = F.array() if isinstance(field.dataType, T.ArrayType) else F.lit(None)
        columns.append((F.col(field.name) if field.name in have else empty).cast(field.dataType).alias(field.name))
    return papers.select(columns)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources as one table; order lives in ``seq``, not in the union."""
    whole = conform(sources[0])
    for other in sources[1:]:
        whole = whole.unionByName(conform(other))
    return whole
