"""Open-access overlay and journal quartiles: left equi-joins on normalised keys.

No broadcast hints: Catalyst broadcasts a side by its measured size and falls back to a sort-merge
join beyond the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.text import missing_if_blank, normalize_doi, normalize_journal


def spread_null(key: Column, salt: Column, parts: int = 4096) -> Column:
    """A left join's key whose nulls go to many tasks; the stand-ins hold a blank and so meet no normalised key."""
    return F.coalesce(key, F.concat(F.lit(" none "), F.pmod(F.xxhash64(salt), F.lit(parts)).cast("string")))


def journal_table(journals: DataFrame) -> DataFrame:
    """``(journal_key, quartile)``; the last row of a repeated name wins."""
    named = journals.filter(missing_if_blank("journal_name").isNotNull())
    quartile = F.trim(F.coalesce(missing_if_blank("quartile"), F.lit("unknown")))
    return named.groupBy(normalize_journal("journal_name").alias("journal_key")).agg(
        F.max_by(quartile, "pos").alias("quartile")
    )


def with_quartile(papers: DataFrame, journals: DataFrame) -> DataFrame:
    """Add ``quartile``; ``unknown`` where the journal is missing or not listed."""
    keyed = papers.withColumn("journal_key", missing_if_blank(normalize_journal("journal")))
    joined = keyed.join(journal_table(journals), "journal_key", "left").drop("journal_key")
    return joined.withColumn("quartile", F.coalesce("quartile", F.lit("unknown")))


def overlay_unpaywall(papers: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Replace status and PDF by the open-access record of the DOI, fill a missing landing page.

    Adds ``oa_queried`` and ``oa_hit`` for :func:`unpaywall_stats`, and the record itself as
    ``unpaywall`` for link collection.
    """
    record = snapshot.select(
        normalize_doi("doi").alias("oa_doi"),
        F.struct("is_oa", "oa_status", "best_oa_location", "oa_locations").alias("unpaywall"),
    ).filter("oa_doi IS NOT NULL")
    # Two spellings of a DOI are one record: an open one first, then the one with the larger JSON form.
    order = F.struct(F.coalesce(F.col("unpaywall.is_oa"), F.lit(False)), F.to_json("unpaywall"))
    record = record.groupBy("oa_doi").agg(F.max_by("unpaywall", order).alias("unpaywall"))
    keyed = papers.withColumn("doi_norm", normalize_doi("doi"))
    joined = keyed.join(record, spread_null(F.col("doi_norm"), F.col("seq")) == F.col("oa_doi"), "left")
    is_oa = F.coalesce(F.col("unpaywall.is_oa"), F.lit(False))
    best = F.col("unpaywall.best_oa_location")

    def replaced(name: str, new: Column) -> Column:
        return F.when(is_oa & missing_if_blank(new).isNotNull(), new).otherwise(F.col(name))

    landing = F.coalesce(missing_if_blank(best["url_for_landing_page"]), missing_if_blank(best["url"]))
    return joined.withColumns(
        {
            "open_access_status": replaced("open_access_status", F.col("unpaywall.oa_status")),
            "pdf_url": replaced("pdf_url", best["url_for_pdf"]),
            "landing_page_url": F.when(
                is_oa & missing_if_blank("landing_page_url").isNull(), F.coalesce(landing, F.col("landing_page_url"))
            ).otherwise(F.col("landing_page_url")),
            "oa_queried": F.col("doi_norm").isNotNull(),
            "oa_hit": F.col("unpaywall").isNotNull(),
        }
    ).drop("doi_norm", "oa_doi")


def unpaywall_stats(overlaid: DataFrame) -> DataFrame:
    best_pdf = missing_if_blank(F.col("unpaywall.best_oa_location.url_for_pdf")).isNotNull()
    return overlaid.agg(
        F.count(F.lit(1)).alias("total_papers"),
        F.count_if("oa_queried").alias("doi_count"),
        F.count_if("oa_queried").alias("queried_count"),
        F.count_if(F.coalesce(F.col("unpaywall.is_oa"), F.lit(False))).alias("oa_found"),
        F.count_if(best_pdf).alias("pdf_found"),
    )
