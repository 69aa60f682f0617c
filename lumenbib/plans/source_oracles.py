"""SQL twins of the reader queries: the expected papers straight from the documents."""

from __future__ import annotations

from lumenbib.plans.oracles import P, dedupe, doi, plausible, squeeze

SOURCE_ORACLES: dict[str, str] = {}


def expected(**parts: str) -> str:
    """A select list with defaults for what a provider does not set."""
    defaults = {
        "id": "NULL", "title": "title", "year": "year", "doi": doi("doi"), "journal": "journal", "publisher": "NULL::VARCHAR",
        "citation_count": "citation_count", "open_access_status": "open_access_status", "pdf_url": "pdf_url",
        "landing_page_url": "landing_page_url", "paper_type": "paper_type", "abstract_md5": "md5(abstract)", "keywords": "''",
        "authors": "coalesce(array_to_string(authors, '|'), '')", "concepts": "''", "topics": "''", "subjects": "''", "source_database": "''",
    }
    return ", ".join(f"{value} AS {name}" for name, value in {**defaults, **parts}.items())


WORDS = r"regexp_split_to_array(trim(abstract, ' ' || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+')"
SOURCE_ORACLES["openalex_records"] = f"""{P} SELECT seq, {expected(
    id=f"coalesce(CASE WHEN seq % 7 <> 0 THEN 'https://openalex.org/W' || seq END, {doi('doi')}, CASE WHEN seq % 17 <> 0 THEN title END, '')",
    title="CASE WHEN seq % 34 <> 0 THEN title ELSE 'Untitled' END", publisher="'Host'",
    pdf_url="CASE WHEN seq % 10 = 0 THEN 'https://best.example.org/' || seq || '.pdf' ELSE pdf_url END",
    landing_page_url="coalesce(landing_page_url, CASE WHEN seq % 3 = 0 THEN 'https://best.example.org/' || seq ELSE 'https://best.example.org/u/' || seq END)",
    abstract_md5=f"md5(array_to_string({WORDS}, ' '))",
    keywords=f"array_to_string({dedupe('list_concat(list_concat(list_concat(keywords, concepts), [primary_topic]), topics)')}, '|')",
    concepts="array_to_string(concepts, '|')", topics="primary_topic || '|' || array_to_string(topics, '|')", source_database="'OpenAlex'")} FROM papers"""
S2_WORDS = f"array_to_string({dedupe('list_concat(keywords, concepts)')}, '|')"
SOURCE_ORACLES["semantic_scholar_records"] = f"""{P} SELECT seq, {expected(
    id=f"coalesce(CASE WHEN seq % 7 <> 0 THEN 'S' || seq END, {doi('doi')}, landing_page_url, CASE WHEN seq % 17 <> 0 THEN title END, '')",
    title="CASE WHEN seq % 17 <> 0 THEN title ELSE 'Untitled' END", journal="coalesce(journal, 'Venue')",
    open_access_status="CASE WHEN pdf_url IS NOT NULL THEN 'open' ELSE 'unknown' END",
    keywords=S2_WORDS, concepts=S2_WORDS, subjects=S2_WORDS, source_database="'Semantic Scholar'")} FROM papers"""
TITLE17 = "CASE WHEN seq % 17 <> 0 THEN title ELSE 'Untitled' END"
CLEAN = squeeze("regexp_replace('<jats:p>' || replace(abstract, '&', 'and') || '</jats:p> & more', '<[^>]+>', ' ', 'g')")
SOURCE_ORACLES["crossref_records"] = f"""{P} SELECT seq, {expected(
    id=f"coalesce(doi, landing_page_url, {TITLE17})", title=TITLE17, year="CASE WHEN seq % 2 = 0 OR seq % 3 = 0 THEN year END",
    publisher="'Pub'", open_access_status="'unknown'", abstract_md5=f"md5({CLEAN})",
    authors="coalesce(array_to_string(list_transform(authors, lambda a: 'G. ' || a), '|'), '')",
    keywords="coalesce(array_to_string(keywords, '|'), '')", subjects="coalesce(array_to_string(keywords, '|'), '')", source_database="'Crossref'")} FROM papers"""
ARXIV_ID = "'http://arxiv.org/abs/2301.' || lpad(seq::VARCHAR, 5, '0')"
SOURCE_ORACLES["arxiv_records"] = f"""{P} SELECT seq, {expected(
    id=ARXIV_ID, title=squeeze("regexp_replace(title, '[&<>]', ' ', 'g')"), year="CASE WHEN seq % 5 <> 0 THEN year END", journal="'arXiv'", publisher="'arXiv'",
    citation_count="NULL::INT", open_access_status="'open'", pdf_url="coalesce(pdf_url, 'https://arxiv.org/pdf/2301.' || lpad(seq::VARCHAR, 5, '0') || '.pdf')",
    landing_page_url=f"coalesce(landing_page_url, {ARXIV_ID})", paper_type="'preprint'", abstract_md5=f"md5({squeeze('''regexp_replace(abstract, '[&<>]', ' ', 'g')''')})",
    keywords="'cs.DL|stat'", subjects="'cs.DL|CS.dl|stat'", source_database="'arXiv'")} FROM papers"""
CNKI_TITLE = squeeze("regexp_replace(title, '[&<>0-9]', ' ', 'g')")
SOURCE_ORACLES["cnki_records"] = f"""{P} SELECT seq // 10 * 80 + seq % 10 + 4398046511104 AS seq, 'CNKI::' || {CNKI_TITLE} AS id, {CNKI_TITLE} AS title,
  CASE WHEN seq % 4 <> 0 THEN year END AS year, (seq % 50)::INT AS citation_count, '/kns/' || seq AS landing_page_url, (seq % 90)::INT AS downloads, 'restricted' AS open_access_status
FROM papers WHERE {CNKI_TITLE} <> ''"""

LANDED = f"""{P}, l AS (SELECT *, seq // 3 % 3 AS src, row_number() OVER (PARTITION BY seq // 3 % 3 ORDER BY seq) - 1 AS position FROM papers),
m AS (SELECT src * 1099511627776 + position AS s, CASE WHEN src = 2 THEN coalesce(doi, id) ELSE id END AS id, title, year, {doi('doi')} AS doi,
  (['OpenAlex', 'Semantic Scholar', 'Crossref'])[src + 1] AS source FROM l)"""
SOURCE_ORACLES["landed_merge"] = f"""{LANDED} SELECT min(s) AS seq, arg_min(id, s) AS id, arg_min(title, [-length(title), s]) AS title, arg_min(year, s) AS year, doi,
  string_agg(DISTINCT source, '+' ORDER BY source) AS source_database, count(DISTINCT source)::INT AS source_count FROM m WHERE doi IS NOT NULL GROUP BY doi
UNION ALL SELECT s + 1125899906842624, id, title, year, doi, source, 1 FROM m WHERE doi IS NULL"""

# ---------------------------------------------------------------- open-access payloads

# provider, place in its list, URL behind the document's base, label, landing page, condition
LINKS = [
    ("unpaywall", 0, "/u.pdf", "unpaywall.best_oa_location.url_for_pdf", False, ""),
    ("unpaywall", 1, "/u", "unpaywall.best_oa_location.url", True, ""),
    ("unpaywall", 2, "/u2.pdf", "unpaywall.oa_locations[0].url_for_pdf", False, ""),
    ("openalex", 0, "/o.pdf", "openalex.best_oa_location.pdf_url", False, ""),
    ("openalex", 1, "/o", "openalex.primary_location.landing_page_url", True, ""),
    ("crossref", 0, "/c.pdf", "crossref.link[0].pdf", False, ""),
    ("crossref", 1, "/c.html", "crossref.link[1]", True, ""),
    ("openaire", 0, "/air", "openaire.instance[0].url", True, ""),
    ("openaire", 1, "/air/web", "openaire.instance[0].webresource", True, ""),
    ("doaj", 0, "/d.pdf", "doaj.link[0:0]", False, ""),
    ("doaj", 2, "/d", "doaj.link[0:2]", True, ""),
    ("europepmc", 1, "/epmc.pdf", "europepmc.fullTextUrl[0:1]", False, "seq % 2 = 1"),
    ("core", 0, "/k.pdf", "core.url[0]", False, ""),
    ("core", 1, "/download/2", "core.url[3]", False, ""),
]
_rows = " UNION ALL ".join(
    f"SELECT seq, d AS doi, '{provider}' AS provider, {pos}::BIGINT AS pos, base || '{tail}' AS url, '{label}' AS source, {str(landing).lower()} AS from_landing FROM k"
    + (f" WHERE {condition}" if condition else "")
    for provider, pos, tail, label, landing, condition in LINKS
)
PAYLOADS = f"""{P}, k AS (SELECT seq, {doi('doi')} AS d, 'https://oa.example.org/' || seq AS base FROM papers WHERE doi IS NOT NULL),
pay AS ({_rows} UNION ALL SELECT seq, d, 'pmc', 0, 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || seq || '/pdf/', 'pmc.PMC' || seq || '.pdf', false FROM k)"""
SOURCE_ORACLES["provider_links"] = f"{PAYLOADS} SELECT doi, provider, pos, url, source, from_landing FROM pay"
SOURCE_ORACLES["discovered_links"] = f"{PAYLOADS} SELECT DISTINCT p.seq, pay.url, pay.source FROM papers p JOIN pay ON pay.doi = {doi('p.doi')}"
SOURCE_ORACLES["link_backfill"] = f"""{PAYLOADS}, b AS (SELECT d, min(base) AS base, count(*) AS n FROM k GROUP BY 1)
SELECT p.seq, coalesce(p.landing_page_url, base || '/u') AS landing_page_url, coalesce(p.pdf_url, base || '/u.pdf') AS pdf_url
FROM papers p LEFT JOIN b ON d = {doi('p.doi')}"""

assert plausible
