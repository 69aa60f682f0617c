"""URL predicates, relative-link resolution and PDF link extraction from landing pages."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.functions.text import col, missing_if_blank, ordered_distinct, strip

# RFC 3986, appendix B. Groups: 2 scheme, 4 authority, 5 path, 7 query.
RFC3986 = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"

# Path or query pieces of listing pages, never direct files.
LISTING_MARKERS = ["/data-providers/", "/data-provider/", "/providers/", "/journals/", "/subjects/"]

# Link patterns of landing pages, in order of trust.
PAGE_PATTERNS = [
    r"""(?i)<meta[^>]+name=["']citation_pdf_url["'][^>]+content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']citation_pdf_url["']""",
    r"""(?i)href=["']([^"']*?\.pdf[^"']*?)["']""",
    r"""(?i)href=["']([^"']*?/pdf[^"']*?)["']""",
    r"""(?i)href=["']([^"']*?/article/file[^"']*?)["']""",
    r"""(?i)href=["']([^"']*?(?:type=printable|format=pdf)[^"']*?)["']""",
    r"""(?i)data-pdf[^=]*=["']([^"']+?)["']""",
    r"""(?i)window\.open\(["']([^"']*?\.pdf[^"']*?)["']""",
    r"""(?i)(?:location|href)\s*=\s*["']([^"']*?\.pdf[^"']*?)["']""",
    r"""(?i)<(?:embed|iframe)[^>]*src=["']([^"']*?\.pdf[^"']*?)["']""",
]

# Tags whose attributes hold links, those attributes (the first present of a group counts), entities of URLs.
LINK_TAG = r"(?i)<(?:a|iframe|embed|link)[ \t\r\n][^>]*>"
LINK_ATTRIBUTES = [
    [r"""(?i)[ \t\r\n]href\s*=\s*["']([^"']+)["']""", r"""(?i)[ \t\r\n]src\s*=\s*["']([^"']+)["']"""],
    [r"""(?i)[ \t\r\n]data-pdf-url\s*=\s*["']([^"']+)["']"""],
    [r"""(?i)[ \t\r\n]data-download-url\s*=\s*["']([^"']+)["']"""],
]
ENTITIES = {"&#38;": "&", "&#x26;": "&", "&amp;": "&"}


def is_http_url(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"(?i)^[\x00-\x20]*https?:"), F.lit(False))


def url_part(c: Column | str, part: str) -> Column:
    """Lower-cased ``path`` (without ``;params``), ``query``, ``netloc`` or ``host``; empty where absent."""
    url = col(c)
    if part == "path":
        return F.lower(F.regexp_replace(F.regexp_extract(url, RFC3986, 5), r";[^/]*$", ""))
    if part == "query":
        return F.lower(F.regexp_extract(url, RFC3986, 7))
    netloc = F.lower(F.regexp_extract(url, RFC3986, 4))
    if part == "netloc":
        return netloc
    return F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", "")


def is_plausible_pdf_url(c: Column | str) -> Column:
    """Looks like a direct file or a download endpoint; listing pages are out whatever else they carry."""
    path, query, host = url_part(c, "path"), url_part(c, "query"), url_part(c, "host")
    both = F.concat(path, F.lit("?"), query)

    def has(text: Column, piece: str) -> Column:
        return F.contains(text, F.lit(piece))

    listing = F.lit(False)
    for marker in LISTING_MARKERS:
        listing = listing | has(both, marker)
    file_path = path.endswith(".pdf") | has(path, "/pdf") | has(path, "/download") | has(path, "/article/file")
    by_query = has(query, "format=pdf") | has(query, "type=pdf") | (has(query, "download=1") & has(both, "pdf"))
    archive = (has(host, "hal.science") | has(host, "archives-ouvertes")) & path.endswith("/document")
    return is_http_url(c) & ~F.coalesce(listing, F.lit(False)) & F.coalesce(file_path | by_query | archive, F.lit(False))


def is_repository_pdf_url(c: Column | str) -> Column:
    """Plausible, and not a provider page of the CORE aggregator."""
    provider = F.contains(url_part(c, "host"), F.lit("core.ac.uk")) & F.contains(
        url_part(c, "path"), F.lit("/data-providers/")
    )
    return is_plausible_pdf_url(c) & ~provider


def url_policy(c: Column | str, blocked: list[str] | None = None) -> Column:
    """Reason why a URL may not be fetched, or null: ``non_http_scheme`` / ``policy_blocked_domain``."""
    place = F.concat(url_part(c, "netloc"), url_part(c, "path"))
    hit = F.lit(False)
    for word in blocked or []:
        hit = hit | F.contains(place, F.lit(word))
    return F.when(~is_http_url(c), "non_http_scheme").when(hit, "policy_blocked_domain")


@F.pandas_udf(T.StringType())
def _join_dotted(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, u: str | None) -> str | None:
        if b is None or u is None:
            return None
        try:
            return urljoin(b, u)
        except ValueError:
            return u

    return pd.Series([one(b, u) for b, u in zip(base, link)], dtype="object")


def resolve_link(base: Column | str, link: Column | str) -> Column:
    """Absolute form of ``link`` on page ``base`` for links without dot segments (native)."""
    base, link = col(base), strip(link)
    scheme = F.regexp_extract(base, RFC3986, 2)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, RFC3986, 4))
    path = F.regexp_extract(base, RFC3986, 5)
    folder = F.coalesce(missing_if_blank(F.regexp_replace(path, r"[^/]*$", "")), F.lit("/"))
    page = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(page, r"\?.*$", ""), link))
        .when(link.startswith("#"), F.concat(page, link))
        .otherwise(F.concat(root, folder, link))
    )


def has_dot_segments(link: Column | str) -> Column:
    return col(link).rlike(r"(^|/)\.{1,2}(/|$|\?|#)")


def join_url(base: Column | str, link: Column | str) -> Column:
    """RFC 3986 join. Only links with ``./`` or ``../`` carry text to Python."""
    dotted = has_dot_segments(link) & ~is_http_url(link)
    by_hand = _join_dotted(F.when(dotted, col(base)), F.when(dotted, strip(link)))
    return F.coalesce(by_hand, resolve_link(base, link))


def tag_links(page: Column) -> Column:
    """Links in attributes of link tags in document order, entities resolved."""

    def found(tag: Column) -> Column:
        return F.array(*[F.coalesce(*[missing_if_blank(F.regexp_extract(tag, a, 1)) for a in group]) for group in LINK_ATTRIBUTES])

    def resolved(link: Column) -> Column:
        for entity, char in ENTITIES.items():
            link = F.replace(link, F.lit(entity), F.lit(char))
        return link

    links = F.flatten(F.transform(F.regexp_extract_all(page, F.lit(LINK_TAG), F.lit(0)), found))
    return F.transform(F.filter(links, lambda u: u.isNotNull()), resolved)


def raw_page_links(page: Column | str) -> Column:
    """Every link on a page: by pattern order, then position, then what the link tags hold."""
    page = F.coalesce(col(page), F.lit(""))
    by_pattern = [F.regexp_extract_all(page, F.lit(p), F.lit(1)) for p in PAGE_PATTERNS]
    return F.flatten(F.array(*by_pattern, tag_links(page)))


def distinct_links(links: Column | str) -> Column:
    return ordered_distinct(F.transform(col(links), lambda u: strip(u)), clean=False)


@F.pandas_udf(T.ArrayType(T.StringType()))
def urljoin_list(base: pd.Series, links: pd.Series) -> pd.Series:
    """List form of the RFC join for pages with dot segments; null rows stay null."""

    def one(b: str | None, values) -> list[str] | None:
        if b is None or values is None:
            return None
        out = []
        for value in values:
            try:
                out.append(urljoin(b, value.strip()))
            except ValueError:
                out.append(value)
        return out

    return pd.Series([one(b, v) for b, v in zip(base, links)], dtype="object")
