"""Registered queries of the readers: documents are dressed as provider payloads and read back."""

from __future__ import annotations

import re
import uuid
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.functions import text as tx
from lumenbib.operators import candidates as ca
from lumenbib.operators import dedup
from lumenbib.plans.queries import joined, papers, query
from lumenbib.schema import union_sources
from lumenbib.session import checkpoint_dir
from lumenbib.sources import payloads as pl
from lumenbib.sources import records as rd


def N() -> Column:  # noqa: N802
    return F.col("seq")


def text_of(n: Column) -> Column:
    return n.cast("string")


def named(values: str) -> Column:
    return F.transform(values, lambda x: F.struct(x.alias("display_name")))


def read_back(rows: DataFrame, payload: Column, schema: str) -> DataFrame:
    """Render a payload as JSON text and read it with a reader schema."""
    text = rows.select(N().alias("seq"), F.to_json(payload).alias("payload"))
    return text.select("seq", F.from_json("payload", schema).alias("r")).select("seq", "r.*")


def shown(found: DataFrame) -> DataFrame:
    columns = ["id", "title", "year", "doi", "journal", "publisher", "citation_count", "open_access_status", "pdf_url", "landing_page_url", "paper_type"]
    lists = [joined(c) for c in ("keywords", "authors", "concepts", "topics", "subjects")]
    return found.select("seq", *columns, F.md5(F.coalesce("abstract", F.lit(""))).alias("abstract_md5"), *lists, "source_database")


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def word_index(texts: pa.Array) -> pa.Array:
    """Word-to-positions map of each text; nothing leaves the row."""
    words, at, word_ends, text_ends = [], array("i"), array("i", [0]), [0]
    for text in texts.to_pylist():
        places: dict[str, list[int]] = {}
        for i, word in enumerate(re.split("[ \t\n\r]+", text.strip(" \t\n\r")) if text is not None else ()):
            places.setdefault(word, []).append(i)
        for word, own in places.items():
            words.append(word)
            at.extend(own)
            word_ends.append(len(at))
        text_ends.append(len(words))
    given = [None if missing else end for end, missing in zip(text_ends, texts.is_null().to_pylist())]
    lists = pa.ListArray.from_arrays(pa.array(word_ends, pa.int32()), pa.array(at, pa.int32()))
    return pa.MapArray.from_arrays(pa.array([*given, text_ends[-1]], pa.int32()), pa.array(words, pa.string()), lists)


@query
def openalex_records(spark, sf):
    p = papers(spark, sf)
    place = F.struct(
        F.col("pdf_url"),
        F.col("landing_page_url"),
        F.struct(F.col("journal").alias("display_name"), F.lit("Host").alias("host_organization_name")).alias("source"),
    )
    best = F.struct(
        F.when(N() % 10 == 0, F.concat(F.lit("https://best.example.org/"), text_of(N()), F.lit(".pdf"))).alias("url_for_pdf"),
        F.when(N() % 3 == 0, F.concat(F.lit("https://best.example.org/"), text_of(N()))).alias("landing_page_url"),
        F.concat(F.lit("https://best.example.org/u/"), text_of(N())).alias("url"),
    )
    payload = F.struct(
        F.when(N() % 7 != 0, F.concat(F.lit("https://openalex.org/W"), text_of(N()))).alias("id"),
        "doi",
        F.when(N() % 17 != 0, F.col("title")).alias("display_name"),
        F.when(N() % 34 != 0, F.col("title")).alias("title"),
        F.col("year").alias("publication_year"),
        F.col("citation_count").alias("cited_by_count"),
        F.col("paper_type").alias("type"),
        word_index("abstract").alias("abstract_inverted_index"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"),
        named("keywords").alias("keywords"),
        named("concepts").alias("concepts"),
        named("topics").alias("topics"),
        F.struct(F.col("primary_topic").alias("display_name")).alias("primary_topic"),
        place.alias("primary_location"),
        best.alias("best_oa_location"),
        F.struct(F.col("open_access_status").alias("oa_status")).alias("open_access"),
    )
    return shown(rd.openalex_papers(read_back(p, payload, rd.OPENALEX)))


@query
def semantic_scholar_records(spark, sf):
    p = papers(spark, sf)
    payload = F.struct(
        F.when(N() % 7 != 0, F.concat(F.lit("S"), text_of(N()))).alias("paperId"),
        F.when(N() % 17 != 0, F.col("title")).alias("title"),
        "abstract",
        "year",
        F.lit("Venue").alias("venue"),
        F.struct(F.col("journal").alias("name")).alias("publicationVenue"),
        F.array("paper_type").alias("publicationTypes"),
        F.col("citation_count").alias("citationCount"),
        F.struct(F.col("doi").alias("DOI")).alias("externalIds"),
        F.col("landing_page_url").alias("url"),
        F.struct(F.col("pdf_url").alias("url")).alias("openAccessPdf"),
        F.col("keywords").alias("fieldsOfStudy"),
        F.transform("concepts", lambda c: F.struct(c.alias("category"))).alias("s2FieldsOfStudy"),
        F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"),
    )
    return shown(rd.semantic_scholar_papers(read_back(p, payload, rd.SEMANTIC_SCHOLAR)))


@query
def crossref_records(spark, sf):
    p = papers(spark, sf)
    date = F.struct(F.array(F.array(F.col("year"), F.lit(5))).alias("date-parts"))
    plain = F.replace("abstract", F.lit("&"), F.lit("and"))
    payload = F.struct(
        F.col("doi").alias("DOI"),
        F.when(N() % 17 != 0, F.array("title")).otherwise(F.array().cast("array<string>")).alias("title"),
        F.concat(F.lit("<jats:p>"), plain, F.lit("</jats:p> &amp; more")).alias("abstract"),
        F.when(N() % 2 == 0, date).alias("issued"),
        F.when(N() % 3 == 0, date).alias("created"),
        F.transform("authors", lambda a: F.struct(F.lit(" G. ").alias("given"), a.alias("family"))).alias("author"),
        F.array("journal").alias("container-title"),
        F.lit("Pub").alias("publisher"),
        F.col("landing_page_url").alias("URL"),
        F.col("paper_type").alias("type"),
        F.col("keywords").alias("subject"),
        F.col("citation_count").alias("is-referenced-by-count"),
        F.array(
            F.struct(F.lit("https://x.example.org/page").alias("URL"), F.lit("text/html").alias("content-type")),
            F.struct(F.col("pdf_url").alias("URL"), F.lit("application/PDF").alias("content-type")),
        ).alias("link"),
    )
    return shown(rd.crossref_papers(read_back(p, payload, rd.CROSSREF)))


def xml_text(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


@query
def arxiv_records(spark, sf):
    p = papers(spark, sf)
    clean = F.regexp_replace("abstract", "[&<>]", " ")

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), xml_text(value), F.lit(f"</{name}>"))

    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), xml_text(a), F.lit("</name></author>"))), "")
    entry = F.concat(
        F.lit("<entry>"),
        tag("id", F.concat(F.lit("http://arxiv.org/abs/2301."), F.lpad(text_of(N()), 5, "0"))),
        tag("title", F.regexp_replace("title", "[&<>]", " ")),
        tag("summary", clean),
        F.when(N() % 5 != 0, tag("published", F.concat(F.col("year").cast("string"), F.lit("-03-04T10:00:00Z")))).otherwise(""),
        people,
        F.lit('<category term="cs.DL"/><category term="CS.dl"/><category term="stat"/>'),
        F.when(F.col("doi").isNotNull(), F.concat(F.lit('<arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">'), "doi", F.lit("</arxiv:doi>"))).otherwise(""),
        F.when(F.col("pdf_url").isNotNull(), F.concat(F.lit('<link href="'), "pdf_url", F.lit('" title="PDF" rel="related"/>'))).otherwise(""),
        F.when(F.col("landing_page_url").isNotNull(), F.concat(F.lit('<link href="'), "landing_page_url", F.lit('" rel="alternate"/>'))).otherwise(""),
        F.lit("</entry>"),
    )
    rows = p.select("seq", F.from_xml(entry, rd.ARXIV, {"rowTag": "entry"}).alias("r")).select("seq", "r.*")
    return shown(rd.arxiv_papers(rows))


@query
def cnki_records(spark, sf):
    title = F.regexp_replace("title", "[&<>0-9]", " ")
    row = F.concat(
        F.lit('<tr><td><a class="fz14" href="/kns/'), text_of(N()), F.lit('">'), title, F.lit('</a> <a href="/home">.</a></td><td>'),
        F.when(N() % 4 != 0, F.col("year").cast("string")).otherwise("-"), F.lit("-05</td><td>被引: "), (N() % 50).cast("string"),
        F.lit("</td><td>下载："), (N() % 90).cast("string"), F.lit("</td></tr>"),
    )
    pages = papers(spark, sf).withColumn("row", row).groupBy(F.floor(N() / 10).alias("position")).agg(
        F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "row"))), lambda r: r["row"]), "\n"), F.lit("</table>")).alias("html")
    )
    found = rd.cnki_papers(pages)
    return found.select("seq", "id", "title", "year", "citation_count", "landing_page_url", F.col("cnki.download_count").alias("downloads"), "open_access_status")


@query
def landed_merge(spark, sf):
    """Documents landed as JSON lines of three providers, read back in landed order, united and merged by DOI."""
    p, turn = papers(spark, sf), F.floor(N() / 3) % 3
    by_provider = [
        (F.struct(F.col("id"), F.col("doi"), F.col("title").alias("display_name"), F.col("year").alias("publication_year")), rd.OPENALEX, rd.openalex_papers),
        (F.struct(F.col("id").alias("paperId"), "title", "year", F.struct(F.col("doi").alias("DOI")).alias("externalIds")), rd.SEMANTIC_SCHOLAR, rd.semantic_scholar_papers),
        (
            F.struct(F.col("doi").alias("DOI"), F.col("id").alias("URL"), F.array("title").alias("title"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued")),
            rd.CROSSREF,
            rd.crossref_papers,
        ),
    ]
    folder, sources = f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}", []
    for i, (payload, schema, parse) in enumerate(by_provider):
        rows = p.filter(turn == i).repartitionByRange(3, "seq").sortWithinPartitions("seq")
        rows.select(F.to_json(payload).alias("value")).write.text(f"{folder}/{i}")
        sources.append(parse(rd.read_json(spark, f"{folder}/{i}", schema)))
    merged = dedup.dedup_by_doi(union_sources(*sources))
    return merged.select("seq", "id", "title", "year", "doi", "source_database", "source_count")


# ---------------------------------------------------------------- open-access payloads


def payload_tables(spark, sf) -> dict[str, DataFrame]:
    """JSON texts of eight providers, keyed by DOI; one object or a list of objects by turns."""
    p = papers(spark, sf).filter(F.col("doi").isNotNull())
    base = F.concat(F.lit('"https://oa.example.org/'), text_of(N()))
    even = N() % 2 == 0

    def table(payload: Column) -> DataFrame:
        return p.select("doi", payload.alias("payload"))

    def wrap(text: Column) -> Column:
        return F.when(even, text).otherwise(F.concat(F.lit("["), text, F.lit("]")))

    def obj(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    child = obj('{"instance": {"url": {"$": ', base, '/air"}, "webresource": {"url": {"$": ', base, '/air/web"}}}}')
    main = obj('{"metadata": {"oaf:entity": {"oaf:result": {"children": {"result": ', wrap(child), "}}}}}")
    full = obj('{"url": ', base, '/epmc", "documentStyle": "pdf"}')
    full = F.when(even, full).otherwise(obj("[", full, ', {"url": ', base, '/epmc.pdf", "documentStyle": "html"}]'))
    return {
        "unpaywall": table(obj('{"best_oa_location": {"url_for_pdf": ', base, '/u.pdf", "url": ', base, '/u"}, "oa_locations": [{"url_for_pdf": ', base, '/u2.pdf"}]}')),
        "openalex": table(obj('{"best_oa_location": {"pdf_url": ', base, '/o.pdf"}, "primary_location": {"landing_page_url": ', base, '/o"}, "open_access": {"oa_url": ', base, '/plain"}}')),
        "crossref": table(obj('{"message": {"URL": ', base, '/c", "link": [{"URL": ', base, '/c.pdf", "content-type": "application/pdf"}, {"URL": ', base, '/c.html", "content-type": "text/html"}]}}')),
        "openaire": table(obj('{"response": {"results": {"result": ', wrap(main), "}}}")),
        "doaj": table(obj('{"results": [{"bibjson": {"link": [{"url": ', base, '/d.pdf", "type": "fulltext"}, {"url": ', base, '/d", "type": "fulltext"}, {"url": ', base, '/d", "type": "home"}]}}]}')),
        "europepmc": table(obj('{"resultList": {"result": ', wrap(obj('{"fullTextUrlList": {"fullTextUrl": ', full, "}}")), "}}")),
        "pmc": table(obj('{"records": [{"pmcid": "PMC', text_of(N()), '"}, {"pmcid": ""}]}')),
        "core": table(obj('{"results": [{"downloadUrl": ', base, '/k.pdf", "title": "x", "links": [{"type": "a", "url": ', base, '/landing"}, {"href": "https://core.ac.uk/data-providers/1/k.pdf"}, {"href": ', base, '/download/2"}]}]}')),
    }


@query
def provider_links(spark, sf):
    return pl.all_payload_links(payload_tables(spark, sf)).select(
        tx.normalize_doi("doi").alias("doi"), "provider", F.col("pos").cast("long").alias("pos"), "url", "source", "from_landing"
    )


@query
def discovered_links(spark, sf):
    found = ca.discovered_links(papers(spark, sf), pl.all_payload_links(payload_tables(spark, sf)))
    return found.select("seq", "url", "source")


@query
def discovery_after_title(spark, sf):
    """Links of papers whose DOI is only known by their title."""
    p = papers(spark, sf)
    found = ca.resolve_titles(p, p.filter(tx.normalize_doi("doi").isNotNull()))
    reached = ca.with_found_doi(p, found).join(found.select("seq"), "seq", "left_semi")
    links = ca.discovered_links(reached, pl.all_payload_links(payload_tables(spark, sf)))
    return links.select("seq", "url", "source")


@query
def link_backfill(spark, sf):
    filled = ca.backfill(papers(spark, sf), pl.payload_backfill(payload_tables(spark, sf)))
    return filled.select("seq", "landing_page_url", "pdf_url")
