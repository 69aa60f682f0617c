"""DOI-keyed open-access payloads of eight providers to link rows.

Input is ``(doi, payload)`` with the payload as JSON text, so one reader serves dumps of any layout.
Fields that arrive as one object or as a list of objects are read under both schemas.
Output rows: ``(doi, provider, pos, url, source, from_landing)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.urls import is_plausible_pdf_url, is_repository_pdf_url
from lumenbib.operators.candidates import admissible, crossref_links, link, listed, unpaywall_links

LOCATION = "struct<url_for_pdf: string, url: string, url_for_landing_page: string>"
UNPAYWALL = f"doi string, is_oa boolean, oa_status string, best_oa_location {LOCATION}, oa_locations array<{LOCATION}>"
CORE_LIMIT = 8


def read_unpaywall(spark, path: str) -> DataFrame:
    return spark.read.schema(UNPAYWALL).json(path)


def _rows(payloads: DataFrame, provider: str, links: Column) -> DataFrame:
    rows = payloads.select("doi", F.lit(provider).alias("provider"), F.posexplode(F.array_compact(links)).alias("pos", "item"))
    return admissible(rows.select("doi", "provider", "pos", "item.*"))


def _one_or_many(text: Column, path: str, item: str) -> Column:
    """List at ``path``: a JSON array as it is, a single object as a list of one."""
    raw = F.get_json_object(text, path)
    many = F.from_json(F.when(raw.startswith("["), raw), f"array<{item}>")
    one = F.from_json(F.when(raw.startswith("{"), raw), item)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def _at(i: Column, prefix: str, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix + "["), i.cast("string"), F.lit("]" + suffix))


def unpaywall_payload(payloads: DataFrame) -> DataFrame:
    record = F.from_json("payload", UNPAYWALL)
    return _rows(payloads, "unpaywall", unpaywall_links(record))


def openalex_payload(payloads: DataFrame) -> DataFrame:
    place = "struct<pdf_url: string, url_for_pdf: string, landing_page_url: string, url: string>"
    work = F.from_json(
        "payload", f"best_oa_location {place}, primary_location {place}, open_access struct<oa_url: string>"
    )
    best, first = work["best_oa_location"], work["primary_location"]
    links = F.array(
        link(best["pdf_url"], "openalex.best_oa_location.pdf_url"),
        link(best["url_for_pdf"], "openalex.best_oa_location.url_for_pdf"),
        link(best["landing_page_url"], "openalex.best_oa_location.landing_page_url", True),
        link(best["url"], "openalex.best_oa_location.url", True),
        link(first["pdf_url"], "openalex.primary_location.pdf_url"),
        link(first["landing_page_url"], "openalex.primary_location.landing_page_url", True),
        link(work["open_access"]["oa_url"], "openalex.open_access.oa_url"),
    )
    return _rows(payloads, "openalex", links)


def crossref_payload(payloads: DataFrame) -> DataFrame:
    work = F.coalesce(F.get_json_object("payload", "$.message"), F.col("payload"))
    items = F.from_json(F.get_json_object(work, "$.link"), "array<struct<URL: string, `content-type`: string>>")
    named = F.transform(items, lambda x: F.struct(x["URL"].alias("url"), x["content-type"].alias("content_type")))
    return _rows(payloads, "crossref", crossref_links(named))


def openaire_payload(payloads: DataFrame) -> DataFrame:
    children = F.flatten(
        F.transform(
            _one_or_many(F.col("payload"), "$.response.results.result", "struct<metadata: string>"),
            lambda pub: F.coalesce(
                F.transform(
                    _one_or_many(
                        pub["metadata"], "$['oaf:entity']['oaf:result'].children.result", "struct<instance: string>"
                    ),
                    lambda child, i: F.struct(child["instance"].alias("instance"), i.alias("i")),
                ),
                F.array().cast("array<struct<instance: string, i: int>>"),
            ),
        )
    )

    def urls(child: Column) -> Column:
        def value(path: str) -> Column:
            return F.get_json_object(child["instance"], path)

        return F.array(
            link(value("$.url['$']"), _at(child["i"], "openaire.instance", ".url"), True),
            link(value("$.webresource.url['$']"), _at(child["i"], "openaire.instance", ".webresource"), True),
        )

    return _rows(payloads, "openaire", listed(children, urls))


def doaj_payload(payloads: DataFrame) -> DataFrame:
    items = F.from_json(
        F.get_json_object("payload", "$.results"), "array<struct<bibjson: struct<link: array<struct<url: string, type: string>>>>>"
    )

    def of_item(item: Column, i: Column) -> Column:
        return F.transform(
            item["bibjson"]["link"],
            lambda x, j: link(
                x["url"],
                F.concat(F.lit("doaj.link["), i.cast("string"), F.lit(":"), j.cast("string"), F.lit("]")),
                F.coalesce(x["type"] != "fulltext", F.lit(True)),
            ),
        )

    return _rows(payloads, "doaj", listed(items, lambda item, i: F.coalesce(of_item(item, i), F.array(link(F.lit(""), "")))))


def europepmc_payload(payloads: DataFrame) -> DataFrame:
    results = _one_or_many(F.col("payload"), "$.resultList.result", "struct<fullTextUrlList: string>")

    def of_result(result: Column, i: Column) -> Column:
        entries = _one_or_many(result["fullTextUrlList"], "$.fullTextUrl", "struct<url: string, documentStyle: string>")

        def one(entry: Column, j: Column) -> Column:
            pdf = F.lower(F.coalesce(entry["documentStyle"], F.lit(""))) == "pdf"
            label = F.concat(F.lit("europepmc.fullTextUrl["), i.cast("string"), F.lit(":"), j.cast("string"), F.lit("]"))
            return F.when(pdf | is_plausible_pdf_url(entry["url"]), link(entry["url"], label))

        return F.coalesce(F.transform(entries, one), F.array(link(F.lit(""), "")))

    return _rows(payloads, "europepmc", listed(results, of_result))


def pmc_payload(payloads: DataFrame) -> DataFrame:
    records = F.from_json(F.get_json_object("payload", "$.records"), "array<struct<pmcid: string>>")

    def one(record: Column) -> Column:
        pmcid = F.nullif(F.trim(record["pmcid"]), F.lit(""))
        url = F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), pmcid, F.lit("/pdf/"))
        return F.array(link(url, F.concat(F.lit("pmc."), pmcid, F.lit(".pdf"))))

    return _rows(payloads, "pmc", listed(records, one))


def payload_urls(payload: Column | str) -> Column:
    """URL-like strings anywhere in a JSON text: values under a key with ``url`` or that start with http."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    pairs = F.regexp_extract_all(payload, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(0))
    split = F.transform(
        pairs,
        lambda p: F.struct(
            F.regexp_extract(p, r'^"((?:[^"\\]|\\.)*)"', 1).alias("key"),
            F.replace(F.regexp_extract(p, r':\s*"((?:[^"\\]|\\.)*)"$', 1), F.lit("\\/"), F.lit("/")).alias("value"),
        ),
    )
    wanted = F.filter(split, lambda p: F.contains(F.lower(p["key"]), F.lit("url")) | p["value"].startswith("http"))
    return F.transform(wanted, lambda p: p["value"])


def core_payload(payloads: DataFrame) -> DataFrame:
    """Repository links; labels count all URLs of the payload, eight links at most."""
    numbered = F.transform(payload_urls("payload"), lambda u, i: F.struct(u.alias("u"), i.alias("i")))
    kept = F.slice(F.filter(numbered, lambda x: is_repository_pdf_url(x["u"])), 1, CORE_LIMIT)
    return _rows(payloads, "core", listed(kept, lambda x: F.array(link(x["u"], _at(x["i"], "core.url")))))


READERS = {
    "unpaywall": unpaywall_payload,
    "openalex": openalex_payload,
    "crossref": crossref_payload,
    "openaire": openaire_payload,
    "doaj": doaj_payload,
    "europepmc": europepmc_payload,
    "pmc": pmc_payload,
    "core": core_payload,
}


def all_payload_links(payloads: dict[str, DataFrame]) -> DataFrame:
    whole = None
    for provider, table in payloads.items():
        rows = READERS[provider](table)
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def payload_backfill(payloads: dict[str, DataFrame]) -> DataFrame:
    """``(doi, provider, landing_page_url, pdf_url)`` that may fill gaps of a paper."""
    out = None
    for provider, table in payloads.items():

        def at(path: str) -> Column:
            return F.get_json_object("payload", path)

        if provider == "unpaywall":
            landing = F.coalesce(at("$.best_oa_location.url_for_landing_page"), at("$.best_oa_location.url"))
            pdf = at("$.best_oa_location.url_for_pdf")
        elif provider == "openalex":
            landing, pdf = at("$.primary_location.landing_page_url"), at("$.primary_location.pdf_url")
        elif provider == "crossref":
            landing, pdf = F.coalesce(at("$.message.URL"), at("$.URL")), F.lit(None).cast("string")
        else:
            continue
        rows = table.select("doi", F.lit(provider).alias("provider"), landing.alias("landing_page_url"), pdf.alias("pdf_url"))
        out = rows if out is None else out.unionByName(rows)
    return out
