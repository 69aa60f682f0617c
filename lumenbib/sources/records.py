"""Landed provider records to papers: typed reads and one projection per provider.

Readers take any DataFrame with the declared schema, so a dump can come from JSON lines, Parquet or
a stream. ``position`` (place in the landed order) is given by the readers here; see ``assign_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenbib.functions.text import (
    let,
    missing_if_blank,
    no_nulls,
    non_blank,
    normalize_doi,
    ordered_distinct,
    strip,
    strip_html,
)
from lumenbib.schema import conform

NAMED = "array<struct<display_name:string>>"
OPENALEX = f"""
id string, doi string, display_name string, title string, publication_year int, cited_by_count int, type string,
abstract_inverted_index map<string, array<int>>,
authorships array<struct<author: struct<display_name: string>>>,
keywords {NAMED}, concepts {NAMED}, topics {NAMED}, primary_topic struct<display_name: string>,
primary_location struct<pdf_url: string, landing_page_url: string,
  source: struct<display_name: string, host_organization_name: string>>,
best_oa_location struct<url_for_pdf: string, pdf_url: string, landing_page_url: string, url: string>,
open_access struct<oa_status: string, oa_url: string>
"""
SEMANTIC_SCHOLAR = """
paperId string, title string, abstract string, year int, venue string, publicationVenue struct<name: string>,
publicationTypes array<string>, citationCount int, externalIds struct<DOI: string>, url string,
openAccessPdf struct<url: string>, fieldsOfStudy array<string>,
s2FieldsOfStudy array<struct<category: string>>, authors array<struct<name: string>>
"""
DATE = "struct<`date-parts`: array<array<int>>>"
CROSSREF = f"""
DOI string, title array<string>, abstract string, issued {DATE}, `published-print` {DATE}, `published-online` {DATE},
created {DATE}, author array<struct<given: string, family: string>>, `container-title` array<string>, publisher string,
URL string, type string, subject array<string>, `is-referenced-by-count` int,
link array<struct<URL: string, `content-type`: string>>
"""
ARXIV = """
id string, title string, summary string, published string,
author array<struct<name: string>>, category array<struct<_term: string>>,
`arxiv:doi` struct<_VALUE: string>,
link array<struct<_href: string, _title: string, _rel: string>>
"""


def in_landed_order(rows: DataFrame) -> DataFrame:
    """``rows`` of a file scan with ``position``: files by path, rows by their place in the file.

    A file split is read by one task in order, so a row's number in it is its generated id less the split's first one.
    Only (file, split) counts are gathered: a row per split.
    """
    own = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    own = own.withColumn("_id", F.monotonically_increasing_id())
    splits = own.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    placed = own.join(splits, ["_file", "_start"]).withColumn("position", F.col("_offset") + F.col("_id") - F.col("_first"))
    return placed.select(*rows.columns, "position")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return in_landed_order(spark.read.schema(schema).json(path))


def read_arxiv(spark: SparkSession, path: str) -> DataFrame:
    """Atom feed through the built-in XML source; the schema is explicit as single items infer as structs."""
    return in_landed_order(spark.read.format("xml").option("rowTag", "entry").schema(ARXIV).load(path))


def _names(items: Column, field: str) -> Column:
    return non_blank(F.transform(items, lambda x: x[field]))


def restore_abstract(index: Column | str) -> Column:
    """Text from a word-to-positions map; words at one position stand in their own order.

    Numbers are sorted, not structs: a position and the place of its word among the sorted entries.
    """
    index = F.col(index) if isinstance(index, str) else index

    def text(entries: Column) -> Column:
        def number(p: Column, k: Column) -> Column:
            return F.shiftleft(F.coalesce(p, F.lit(-(1 << 31))).cast("long"), 32).bitwiseOR(k.cast("long"))

        placed = F.flatten(F.transform(entries, lambda e, k: F.transform(e["value"], lambda p: number(p, k))))
        own = F.transform(F.sort_array(placed), lambda x: F.get(entries, x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))["key"])
        return F.array_join(own, " ")

    return missing_if_blank(let(F.sort_array(F.map_entries(index)), text))


def _position(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("seq", "position") if c in df.columns]


def openalex_papers(works: DataFrame) -> DataFrame:
    topics = _names(F.slice("topics", 1, 8), "display_name")
    primary = missing_if_blank("primary_topic.display_name")
    topics = F.when(primary.isNull(), topics).otherwise(F.concat(F.array(primary), topics))
    concepts = _names(F.slice("concepts", 1, 12), "display_name")
    first, best = F.col("primary_location"), F.col("best_oa_location")
    doi = normalize_doi("doi")
    given = missing_if_blank
    shaped = works.select(
        *_position(works),
        F.coalesce(given("id"), doi, given("display_name"), F.lit("")).alias("id"),
        F.coalesce(given("display_name"), given("title"), F.lit("Untitled")).alias("title"),
        restore_abstract("abstract_inverted_index").alias("abstract"),
        ordered_distinct(F.concat(_names(F.col("keywords"), "display_name"), concepts, topics)).alias("keywords"),
        non_blank(F.transform("authorships", lambda a: a["author"]["display_name"])).alias("authors"),
        F.col("publication_year").alias("year"),
        doi.alias("doi"),
        first["source"]["display_name"].alias("journal"),
        first["source"]["host_organization_name"].alias("publisher"),
        F.col("cited_by_count").alias("citation_count"),
        F.lit("OpenAlex").alias("source_database"),
        F.col("open_access.oa_status").alias("open_access_status"),
        F.coalesce(given(best["url_for_pdf"]), given(first["pdf_url"])).alias("pdf_url"),
        F.coalesce(given(first["landing_page_url"]), given(best["landing_page_url"]), best["url"]).alias("landing_page_url"),
        F.col("type").alias("paper_type"),
        concepts.alias("concepts"),
        topics.alias("topics"),
        primary.alias("primary_topic"),
        F.lit("high").alias("source_priority"),
    )
    return _finished(shaped)


def semantic_scholar_papers(records: DataFrame) -> DataFrame:
    doi = normalize_doi("externalIds.DOI")
    fields = F.filter(no_nulls("fieldsOfStudy"), lambda v: strip(v) != "")
    keywords = ordered_distinct(F.concat(fields, _names(F.col("s2FieldsOfStudy"), "category")))
    given = missing_if_blank
    pdf = F.col("openAccessPdf.url")
    shaped = records.select(
        *_position(records),
        F.coalesce(given("paperId"), doi, given("url"), given("title"), F.lit("")).alias("id"),
        F.coalesce(given("title"), F.lit("Untitled")).alias("title"),
        "abstract",
        keywords.alias("keywords"),
        _names(F.col("authors"), "name").alias("authors"),
        "year",
        doi.alias("doi"),
        F.coalesce(given("publicationVenue.name"), F.col("venue")).alias("journal"),
        F.col("citationCount").alias("citation_count"),
        F.lit("Semantic Scholar").alias("source_database"),
        F.when(given(pdf).isNotNull(), "open").otherwise("unknown").alias("open_access_status"),
        pdf.alias("pdf_url"),
        F.col("url").alias("landing_page_url"),
        F.get("publicationTypes", F.lit(0)).alias("paper_type"),
        keywords.alias("concepts"),
        keywords.alias("subjects"),
        F.lit("high").alias("source_priority"),
    )
    return _finished(shaped)


def crossref_year() -> Column:
    dates = ("issued", "published-print", "published-online", "created")
    return F.coalesce(*[F.get(F.get(F.col(f"`{d}`")["date-parts"], F.lit(0)), F.lit(0)) for d in dates])


def crossref_papers(works: DataFrame) -> DataFrame:
    given = missing_if_blank
    title = F.coalesce(F.get("title", F.lit(0)), F.lit("Untitled"))
    subjects = F.filter(no_nulls("subject"), lambda s: strip(s) != "")
    full_name = F.transform(
        "author", lambda a: strip(F.concat_ws(" ", given(strip(a["given"])), given(strip(a["family"]))))
    )
    pdf_links = F.filter(
        "link",
        lambda x: F.contains(F.lower(F.coalesce(x["content-type"], F.lit(""))), F.lit("pdf")) & given(x["URL"]).isNotNull(),
    )
    shaped = works.select(
        *_position(works),
        F.coalesce(given("DOI"), given("URL"), title).alias("id"),
        title.alias("title"),
        given(strip_html("abstract")).alias("abstract"),
        subjects.alias("keywords"),
        non_blank(full_name).alias("authors"),
        crossref_year().alias("year"),
        normalize_doi("DOI").alias("doi"),
        F.get("container-title", F.lit(0)).alias("journal"),
        "publisher",
        F.col("is-referenced-by-count").alias("citation_count"),
        F.lit("Crossref").alias("source_database"),
        F.lit("unknown").alias("open_access_status"),
        F.get(pdf_links, F.lit(0))["URL"].alias("pdf_url"),
        F.col("URL").alias("landing_page_url"),
        F.col("type").alias("paper_type"),
        subjects.alias("subjects"),
        F.lit("medium").alias("source_priority"),
    )
    return _finished(shaped)


def arxiv_papers(entries: DataFrame) -> DataFrame:
    given = missing_if_blank
    entry_id = strip(F.coalesce("id", F.lit("")))
    title = F.coalesce(given(strip_html("title")), F.lit("Untitled"))
    categories = F.filter(F.transform(_names(F.col("category"), "_term"), lambda t: strip(t)), lambda t: t != "")
    files = F.filter(
        "link",
        lambda x: F.contains(F.lower(F.coalesce(x["_title"], F.lit(""))), F.lit("pdf")) & given(x["_href"]).isNotNull(),
    )
    pages = F.filter("link", lambda x: (x["_rel"] == "alternate") & given(x["_href"]).isNotNull())
    made = F.when(entry_id != "", F.concat(F.lit("https://arxiv.org/pdf/"), F.substring_index(entry_id, "/", -1), F.lit(".pdf")))
    shaped = entries.select(
        *_position(entries),
        F.coalesce(given(entry_id), title).alias("id"),
        title.alias("title"),
        given(strip_html("summary")).alias("abstract"),
        ordered_distinct(categories, clean=False).alias("keywords"),
        F.filter(F.transform(_names(F.col("author"), "name"), lambda a: strip(a)), lambda a: a != "").alias("authors"),
        F.when(strip("published").try_cast("timestamp").isNotNull(), F.substring(strip("published"), 1, 4).try_cast("int")).alias("year"),
        normalize_doi(F.col("`arxiv:doi`")["_VALUE"]).alias("doi"),
        F.lit("arXiv").alias("journal"),
        F.lit("arXiv").alias("publisher"),
        F.lit("arXiv").alias("source_database"),
        F.lit("open").alias("open_access_status"),
        F.coalesce(F.try_element_at(files, F.lit(-1))["_href"], made).alias("pdf_url"),
        F.coalesce(F.try_element_at(pages, F.lit(-1))["_href"], entry_id).alias("landing_page_url"),
        F.lit("preprint").alias("paper_type"),
        categories.alias("subjects"),
        F.lit("medium").alias("source_priority"),
    )
    return _finished(shaped)


# Marks of the result list pages.
ITEM = r"<div[^>]*class=[\"'](?:item|briefBox)[\"'][^>]*>"
ROW = rf"(?is)(<tr\b[^>]*>.*?</tr>|{ITEM}.*?(?={ITEM}|<tr\b|</body>|\z))"
ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a>"
CITED = r"被引[：:\s]*(\d+)"
DOWNLOADED = r"下载[：:\s]*(\d+)"
ROWS_PER_PAGE = 80


def cnki_papers(pages: DataFrame, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """Result list pages ``(position, html)`` to papers: the first ``rows_per_page`` rows, those whose first link has a text.

    An item in a ``div`` reaches to the next item, whatever other ``div`` it holds.
    """
    rows = pages.select(
        "position", F.posexplode(F.slice(F.regexp_extract_all("html", F.lit(ROW), F.lit(1)), 1, rows_per_page)).alias("i", "row")
    )
    cells = rows.withColumns(
        {
            "title": strip_html(F.regexp_extract("row", ANCHOR, 2)),
            "href": missing_if_blank(F.regexp_extract(F.regexp_extract("row", ANCHOR, 1), r"""(?i)href=["']([^"']*)["']""", 1)),
            "words": strip_html("row"),
        }
    ).filter("title <> ''")

    def number(pattern: str) -> Column:
        return missing_if_blank(F.regexp_extract("words", pattern, 1)).try_cast("int")

    none = F.lit(None).cast("string")
    shaped = cells.select(
        (F.col("position").cast("long") * rows_per_page + F.col("i")).alias("position"),
        F.concat(F.lit("CNKI::"), "title").alias("id"),
        "title",
        number(r"(19\d{2}|20\d{2})").alias("year"),
        number(CITED).alias("citation_count"),
        F.lit("CNKI").alias("source_database"),
        F.lit("restricted").alias("open_access_status"),
        F.col("href").alias("landing_page_url"),
        F.lit("unknown").alias("paper_type"),
        F.lit("optional").alias("source_priority"),
        F.struct(
            number(DOWNLOADED).alias("download_count"),
            none.alias("database"),
            none.alias("degree_type"),
            none.alias("institution"),
            F.lit(True).alias("restricted"),
        ).alias("cnki"),
    )
    return _finished(shaped)


def _finished(shaped: DataFrame) -> DataFrame:
    """Paper schema with the record's own source as its only merged source; keeps ``position``."""
    full = shaped.withColumns({"merged_sources": F.array("source_database"), "source_count": F.lit(1)})
    if "position" not in shaped.columns:
        return conform(full)
    from lumenbib.schema import assign_seq

    return conform(assign_seq(full))


def from_year(papers: DataFrame, year: int, keep_undated: bool) -> DataFrame:
    """Year filter. Undated records (missing or 0) pass for sources that are filtered after the fetch."""
    if keep_undated:
        return papers.filter((F.col("year") >= year) | F.col("year").isNull() | (F.col("year") == 0))
    return papers.filter(F.col("year") >= year)
