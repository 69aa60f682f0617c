"""The registered queries as plain SQL over the sample tables, for a second engine."""

from __future__ import annotations

import math
import re

from lumenbib.config import DEFAULTS
from lumenbib.operators.candidates import ATTEMPTED, SOURCE_PRIORITY
from lumenbib.operators.evidence import WEAK_TEXT
from lumenbib.operators.expand import CHINESE_POOL, COMBINATIONS, RELATED_TERMS
from lumenbib.operators.report import FLAT_COLUMNS
from lumenbib.operators.rubric import RELEVANCE_TEMPLATE, RUBRIC_TEMPLATE
from lumenbib.functions.text import ARXIV_ID, ARXIV_URL
from lumenbib.functions.urls import ENTITIES, LINK_ATTRIBUTES, LINK_TAG, LISTING_MARKERS, PAGE_PATTERNS
from lumenbib.plans.queries import PHRASES, TERMS, TOPIC, YEAR
from lumenbib.plans.views import HAN_LETTERS

ORACLES: dict[str, str] = {}
WS = r"[ \t\n\r\x0b\x0c]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(x: str) -> str:
    inner = rf"regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_ \t\n\r\x0b\x0c]', ' ', 'g')"
    return squeeze(inner)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def doi(x: str) -> str:
    return f"nullif(lower(regexp_replace({x}, '(?i)^https?://(dx\\.)?doi\\.org/', '')), '')"


def round2(x: str) -> str:
    return f"(floor(({x}) * 100e0 + 0.5e0) / 100e0)"


def pick(n: str, *values: str | None) -> str:
    items = ", ".join("NULL" if v is None else lit(v) for v in values)
    return f"([{items}])[({n} % {len(values)} + 1)::INT]"


def short(title: str, k: int) -> str:
    return f"coalesce(nullif(array_to_string(string_split({norm(title)}, ' ')[1:{k}], '_'), ''), 'untitled')"


def clean_name(x: str, size: int) -> str:
    inner = f"""regexp_replace({strip(f"regexp_replace({x}, '[\\\\/*?:\"<>|]+', '_', 'g')")}, '{WS}+', '_', 'g')"""
    return f"left(coalesce(nullif(trim({inner}, '._'), ''), 'paper'), {size})"


def author(list_column: str) -> str:
    lead = strip(f"{list_column}[1]")
    return f"coalesce(nullif(replace({norm(f'''string_split({squeeze(f'''split_part({lead}, ',', 1)''')}, ' ')[-1]''')}, ' ', '_'), ''), 'unknown')"


def total(values: list[str]) -> str:
    """Balanced sum, the order of the scores' own sum."""
    while len(values) > 1:
        values = ["(" + " + ".join(values[i : i + 2]) + ")" for i in range(0, len(values), 2)]
    return values[0]


def is_cjk(term: str) -> bool:
    return bool(re.search("[一-鿿]", term))


def found(term: str, text: str) -> str:
    return f"contains({text}, {lit(term if is_cjk(term) else term.lower())})"


def field_match(text: str) -> str:
    weights = [1.2 if is_cjk(t) else 1.0 for t in TERMS]
    hits = total([f"(CASE WHEN {found(t, text)} THEN {w}e0 ELSE 0e0 END)" for t, w in zip(TERMS, weights)])
    return f"CASE WHEN {text} = '' THEN 0e0 ELSE 100e0 * ({hits} / {sum(weights)}e0) END"


def share(text: str, terms: list[str]) -> str:
    hits = total([f"(CASE WHEN {found(t, text)} THEN 1e0 ELSE 0e0 END)" for t in terms])
    return f"100e0 * {hits} / {len(terms)}e0"


def dedupe(values: str) -> str:
    """Ordered case-insensitive distinct over a list expression."""
    clean = f"list_filter(list_transform({values}, lambda v: {squeeze('v')}), lambda v: v IS NOT NULL AND v <> '')"
    return (
        f"list_filter({clean}, lambda v, i: list_position(list_transform({clean}, lambda w: lower(w)), lower(v)) = i)"
    )


PAPERS = rf"""papers AS (
  SELECT doc_id AS seq, 'P' || doc_id AS id, array_to_string(tokens[1:8], ' ') AS title, text AS abstract,
    tokens[9:13] AS keywords, tokens[14:15] AS authors, (2000 + doc_id % 27)::INT AS year,
    CASE WHEN doc_id % 3 <> 0 THEN 'https://doi.org/10.1000/' || upper(left(md5(text), 8)) END AS doi,
    {pick('doc_id', 'Nature', 'Applied Energy', 'climate  policy', 'Sustainability', 'Unknown Letters', None)} AS journal,
    CASE WHEN doc_id % 11 <> 0 THEN ((doc_id * 37) % 701)::INT END AS citation_count,
    {pick('doc_id', 'OpenAlex', 'Semantic Scholar', 'Crossref', 'arXiv')} AS source_database,
    {pick('doc_id', 'gold', 'open', 'unknown', 'open')} AS open_access_status,
    CASE WHEN doc_id % 5 = 0 THEN 'https://repo.example.org/' || doc_id || '.pdf' END AS pdf_url,
    CASE WHEN doc_id % 2 = 0 THEN 'https://pub.example.org/' || doc_id END AS landing_page_url,
    {pick('doc_id', 'journal-article', 'proceedings-article', 'preprint', 'book-chapter', 'article')} AS paper_type,
    [{pick('doc_id', 'default', 'title', 'title_abstract')} || ':' || lang] AS matched_queries,
    [lang] AS concepts, [source] AS topics, 'topic ' || lang AS primary_topic
  FROM (SELECT *, regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+') AS tokens FROM documents))"""

JOURNALS = """journals(name, quartile) AS (VALUES ('nature', 'Q1'), ('science', 'Q1'), ('energy', 'Q1'),
  ('applied energy', 'Q1'), ('energy policy', 'Q1'), ('journal of cleaner production', 'Q1'),
  ('renewable and sustainable energy reviews', 'Q1'), ('energy economics', 'Q1'), ('climate policy', 'Q2'), ('sustainability', 'Q3'))"""

KEYWORDS = dedupe("list_concat(list_concat(list_concat(keywords, concepts), topics), [primary_topic])")
TEXTS = f"""texts AS (SELECT *, lower(coalesce(title, '')) AS tt, lower(coalesce(abstract, '')) AS abs_t,
    lower(array_to_string({KEYWORDS}, ' ')) AS kt FROM papers),
  whole AS (SELECT *, tt || ' ' || abs_t || ' ' || kt AS wt FROM texts)"""
MATCHES = f"""matches AS (SELECT *, {field_match('tt')} AS m_title, {field_match('abs_t')} AS m_abstract,
    {share('wt', TERMS)} AS m_coverage, least(100e0, {share('wt', PHRASES)}) AS m_phrase,
    least(100e0, 0.7e0 * ({field_match('kt')}) + 0.3e0 * ({share('wt', TERMS)})) AS m_keyword FROM whole)"""
ACCESS = """CASE WHEN pdf_url <> '' THEN 100e0 WHEN landing_page_url <> '' AND open_access_status <> '' THEN 70e0
    WHEN doi <> '' THEN 40e0 ELSE 0e0 END"""
JOURNAL_SCORE = "CASE coalesce(quartile, 'unknown') WHEN 'Q1' THEN 100e0 WHEN 'Q2' THEN 80e0 WHEN 'Q3' THEN 55e0 WHEN 'Q4' THEN 35e0 ELSE 50e0 END"
PARTS = f"""parts AS (SELECT m.*, coalesce(j.quartile, 'unknown') AS q,
    {round2("least(100e0, 0.30e0 * m_title + 0.25e0 * m_abstract + 0.20e0 * m_keyword + 0.15e0 * m_phrase + 0.10e0 * 0e0)")} AS relevance_score,
    least(100e0, CASE WHEN {YEAR} - year <= 3 THEN 100e0 WHEN {YEAR} - year <= 5 THEN 85e0 WHEN {YEAR} - year <= 10 THEN 65e0 ELSE 35e0 END
      + CASE WHEN citation_count >= 500 THEN 10e0 WHEN citation_count >= 100 THEN 5e0 ELSE 0e0 END) AS year_score,
    CASE WHEN coalesce(citation_count, 0) <= 0 THEN 0e0 ELSE
      {round2(f"least(100e0, 100e0 * ln(1e0 + citation_count::DOUBLE / greatest(1, {YEAR} - year + 1)::DOUBLE) / {math.log1p(100)!r}e0)")} END AS citation_score,
    {JOURNAL_SCORE} AS journal_score, {ACCESS} AS access_score,
    CASE WHEN contains(paper_type, 'journal') THEN 100e0 WHEN contains(paper_type, 'proceeding') THEN 80e0
      WHEN contains(paper_type, 'preprint') THEN 75e0 WHEN contains(paper_type, 'book') THEN 60e0 ELSE 50e0 END AS type_score
  FROM matches m LEFT JOIN journals j ON j.name = {norm('m.journal')})"""
SCORED = f"""scored AS (SELECT *, {round2('''least(100e0, 0e0 + 0.40e0 * relevance_score + 0.15e0 * year_score + 0.15e0 * citation_score
    + 0.15e0 * journal_score + 0.10e0 * access_score + 0.05e0 * type_score)''')} AS rule_score,
    array_to_string(list_filter([CASE WHEN relevance_score >= 75 THEN 'high_relevance' END,
      CASE WHEN {round2('m_coverage')} >= 60 THEN 'good_query_coverage' END, CASE WHEN year >= {YEAR} - 3 THEN 'recent' END,
      CASE WHEN citation_count >= 100 THEN 'highly_cited' END, CASE WHEN open_access_status <> '' THEN 'open_access' END],
      lambda l: l IS NOT NULL), '|') AS labels FROM parts)"""
RULES = f"WITH {PAPERS}, {JOURNALS}, {TEXTS}, {MATCHES}, {PARTS}, {SCORED}"
ORDER = "rule_score DESC, coalesce(citation_count, 0) DESC, seq"
P = f"WITH {PAPERS}"

# ---------------------------------------------------------------- keys and text

ORACLES["normalize_keys"] = f"""{P} SELECT seq, {doi('doi')} AS doi_norm, {norm('title')} AS title_norm, {short('title', 6)} AS short_title,
  {author('authors')} AS author, {norm('journal')} AS journal_key, {clean_name('title', 60)} AS file_name,
  coalesce('doi:' || {doi('doi')}, 'title:' || nullif({norm('title')}, ''), 'paper:' || id) AS paper_key,
  CASE WHEN regexp_matches(title, '[A-Za-z]') THEN CASE WHEN regexp_matches(title, '[一-鿿]') THEN 'mixed' ELSE 'en' END
    WHEN regexp_matches(title, '[一-鿿]') THEN 'zh' END AS language,
  concat_ws(', ', nullif(journal, ''), nullif(pdf_url, '')) AS place FROM papers"""

TOKEN = "[a-z0-9][a-z0-9\\-\\+_\\.]*"
# Ordered distinct words by the first place of each word, linear in the text.
ORACLES["topic_tokens"] = f"""{P}, n AS (SELECT seq, string_split({norm('abstract')}, ' ') AS ws FROM papers),
u AS (SELECT seq, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM n),
f AS (SELECT seq, w, min(i) AS i FROM u WHERE w <> '' GROUP BY seq, w),
d AS (SELECT seq, count(*) AS vocabulary, md5(string_agg(w, ' ' ORDER BY i)) AS words_md5 FROM f GROUP BY seq)
SELECT papers.seq,
  array_to_string(list_filter(regexp_extract_all(lower(title), '{TOKEN}'), lambda t: length(t) > 2), '|') AS tokens,
  len(list_filter(regexp_extract_all(lower(abstract), '{TOKEN}'), lambda t: length(t) > 2))::BIGINT AS abstract_tokens,
  coalesce(vocabulary, 0)::BIGINT AS vocabulary, coalesce(words_md5, md5('')) AS words_md5
FROM papers LEFT JOIN d USING (seq)"""

SENTENCES = f"""list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(abstract, ''), '\\.{WS}+', '.' || chr(1), 'g'),
  '[。！？!?;\\n\\x01]'), lambda s: {squeeze('s')}), lambda s: s <> '')"""
ORACLES["sentences"] = f"""{P}, s AS (SELECT seq, {SENTENCES} AS list FROM papers)
SELECT seq, (i - 1)::BIGINT AS pos, list[i] AS sentence FROM s, unnest(range(1, len(list) + 1)) AS u(i)"""
ORACLES["query_sanitize"] = f"{P} SELECT seq, {squeeze("regexp_replace(abstract, '[,:]', ' ', 'g')")} AS clean FROM papers"

WORD = "md5(text)"
URLS = f"""urls AS (SELECT doc_id AS seq, ([
  'https://Repo.example.org/' || {WORD} || '.pdf', 'http://a.example.org/article/' || doc_id || '?format=pdf&x=' || {WORD},
  'https://hal.science/hal-' || doc_id || '/document', 'https://doaj.org/subjects/' || {WORD} || '.pdf',
  'ftp://files.example.org/' || {WORD} || '.pdf', 'https://user@blocked.example.org:8080/download/' || {WORD},
  'https://example.org/' || {WORD} || '?download=1&n=pdf', 'https://core.ac.uk/data-providers/' || doc_id || '/pdf',
  'https://example.org/a.pdf;jsession=' || doc_id])[(doc_id % 9 + 1)::INT] AS url FROM documents)"""
RFC = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"


def part(url: str, name: str) -> str:
    group = {"path": 5, "query": 7, "netloc": 4, "host": 4}[name]
    out = f"lower(regexp_extract({url}, {lit(RFC)}, {group}))"
    if name == "path":
        out = f"regexp_replace({out}, ';[^/]*$', '')"
    if name == "host":
        out = f"regexp_replace(regexp_replace({out}, '^.*@', ''), ':[0-9]*$', '')"
    return out


def plausible(url: str) -> str:
    path, query, host = part(url, "path"), part(url, "query"), part(url, "host")
    both = f"({path} || '?' || {query})"
    listing = " OR ".join(f"contains({both}, {lit(m)})" for m in LISTING_MARKERS)
    return f"""(regexp_matches({url}, '(?i)^https?:') AND NOT ({listing}) AND (
      ends_with({path}, '.pdf') OR contains({path}, '/pdf') OR contains({path}, '/download') OR contains({path}, '/article/file')
      OR contains({query}, 'format=pdf') OR contains({query}, 'type=pdf') OR (contains({query}, 'download=1') AND contains({both}, 'pdf'))
      OR ((contains({host}, 'hal.science') OR contains({host}, 'archives-ouvertes')) AND ends_with({path}, '/document'))))"""


ORACLES["url_checks"] = f"""WITH {URLS} SELECT seq, url, regexp_matches(url, '(?i)^https?:') AS is_http, {plausible('url')} AS plausible,
  {plausible('url')} AND NOT (contains({part('url', 'host')}, 'core.ac.uk') AND contains({part('url', 'path')}, '/data-providers/')) AS repository,
  CASE WHEN NOT regexp_matches(url, '(?i)^https?:') THEN 'non_http_scheme'
    WHEN contains({part('url', 'netloc')} || {part('url', 'path')}, 'blocked.') THEN 'policy_blocked_domain' ELSE '' END AS blocked_reason FROM urls"""
ORACLES["url_join"] = f"""SELECT doc_id AS seq, ([
  'https://pub.example.org/files/' || {WORD}, 'https://cdn.example.org/' || {WORD}, 'https://pub.example.org/a/b/' || {WORD},
  'https://else.example.org/' || {WORD}, 'https://pub.example.org/a/b/' || doc_id || '?q=' || {WORD}, 'https://pub.example.org/a/up/' || {WORD}
  ])[(doc_id % 6 + 1)::INT] AS resolved FROM documents"""
NOTED = """text || chr(10) || ([
  'https://arxiv.org/abs/2301.' || lpad(doc_id::VARCHAR, 5, '0') || 'v2', 'arXiv: hep-th/' || lpad(doc_id::VARCHAR, 7, '0'),
  'see 2301.' || lpad(doc_id::VARCHAR, 5, '0') || ' and more', 'no id here',
  'https://arxiv.org/pdf/hep-th/' || lpad(doc_id::VARCHAR, 7, '0') || 'v1?x=1'])[(doc_id % 5 + 1)::INT]"""
ORACLES["arxiv_ids"] = f"""WITH n AS (SELECT doc_id AS seq, {NOTED} AS t FROM documents),
r AS (SELECT seq, CASE WHEN regexp_matches(t, {lit(ARXIV_URL)}) THEN nullif(trim(regexp_extract(t, {lit(ARXIV_URL)}, 1)), '')
  ELSE nullif(trim(regexp_extract(t, {lit(ARXIV_ID)}, 1)), '') END AS raw FROM n),
b AS (SELECT seq, {strip("regexp_replace(regexp_replace(raw, '(?i)^arxiv[ ]*:[ ]*', ''), '(?i)v[0-9]+$', '')")} AS bare FROM r)
SELECT seq, CASE WHEN regexp_matches(bare, '^(?i:' || {lit(ARXIV_ID.replace("(?i)", ""))} || ')') THEN bare END AS arxiv_id FROM b"""

# ---------------------------------------------------------------- merge

KEYED = f"keyed AS (SELECT *, {doi('doi')} AS gid FROM papers)"
LISTS = ["keywords", "authors", "matched_queries", "concepts", "topics"]


def long_lists(fields: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT gid, seq, '{f}' AS field, (i - 1)::BIGINT AS pos, {f}[i] AS value FROM keyed, unnest(range(1, len({f}) + 1)) AS u(i) WHERE gid IS NOT NULL"
        for f in fields
    )
    sources = "SELECT gid, seq, 'merged_sources' AS field, 0::BIGINT AS pos, source_database AS value FROM keyed WHERE gid IS NOT NULL"
    return f"""long AS ({rows} UNION ALL {sources}),
  firsts AS (SELECT * FROM long WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY gid, field, lower({strip('value')}) ORDER BY seq, pos) = 1)"""


def merged_list(f: str) -> str:
    return f"coalesce(CASE WHEN g.n = 1 THEN g.own_{f} ELSE (SELECT string_agg(value, '|' ORDER BY seq, pos) FROM firsts WHERE firsts.gid = g.gid AND field = '{f}') END, '') AS {f}"


def first_present(c: str) -> str:
    return f"arg_min({c}, seq) FILTER (WHERE {c} IS NOT NULL AND {c}::VARCHAR <> '') AS {c}"


SCALARS = ["year", "journal", "open_access_status", "pdf_url", "landing_page_url", "paper_type", "primary_topic"]
MERGED = f"""{P}, {KEYED}, {long_lists(LISTS)},
g AS (SELECT gid, count(*) AS n, min(seq) AS first_seq, arg_min(id, seq) AS id,
  arg_max(title, length(title)::BIGINT * 1000000000 - seq) AS title, arg_max(abstract, length(abstract)::BIGINT * 1000000000 - seq) AS abstract,
  max(citation_count) AS citation_count, {', '.join(first_present(c) for c in SCALARS)},
  {', '.join(f"arg_min(array_to_string({f}, '|'), seq) AS own_{f}" for f in LISTS)},
  array_to_string(list_sort(list_distinct(list(source_database))), '+') AS source_database, count(DISTINCT source_database)::INT AS source_count
  FROM keyed WHERE gid IS NOT NULL GROUP BY gid),
merged AS (SELECT first_seq AS seq, id, title, md5(abstract) AS abstract_md5, year, gid AS doi, journal, citation_count, source_database, source_count,
    open_access_status, pdf_url, landing_page_url, paper_type, primary_topic, {', '.join(merged_list(f) for f in LISTS)}, replace(source_database, '+', '|') AS merged_sources FROM g
  UNION ALL SELECT seq + 1125899906842624, id, title, md5(abstract), year, doi, journal, citation_count, source_database, 1,
    open_access_status, pdf_url, landing_page_url, paper_type, primary_topic, {', '.join(f"coalesce(array_to_string({f}, '|'), '')" for f in LISTS)}, source_database
  FROM keyed WHERE gid IS NULL)"""
ORACLES["doi_dedup_merge"] = f"{MERGED} SELECT * FROM merged"
ORACLES["doi_merge_lists"] = f"{P}, {KEYED}, {long_lists(LISTS)} SELECT gid, field, seq, pos, value FROM firsts"
ORACLES["doi_dedup_counts"] = f"""{P}, {KEYED}, c AS (SELECT count(*) AS b, count(DISTINCT gid) + count(*) FILTER (WHERE gid IS NULL) AS a FROM keyed)
SELECT b AS before, a AS after, greatest(0, b - a)::BIGINT AS removed FROM c"""
ORACLES["title_dedup_exact"] = f"{P} SELECT {norm('title')} AS title_norm, min(seq) AS first_seq, count(*) AS records, max(citation_count) AS citation_count FROM papers GROUP BY 1"
ORACLES["arrival_order"] = f"""{P} SELECT seq + (list_position(['OpenAlex', 'Semantic Scholar', 'Crossref', 'arXiv'], source_database) - 1)::BIGINT * 1099511627776 AS seq,
  id, source_database FROM papers"""
ORACLES["candidate_cut"] = f"{MERGED} SELECT seq, id FROM merged ORDER BY seq LIMIT 300"

# ---------------------------------------------------------------- enrichment

ORACLES["journal_quartile"] = f"""{P}, {JOURNALS} SELECT seq, journal, coalesce(quartile, 'unknown') AS quartile, {JOURNAL_SCORE} AS journal_score
FROM papers p LEFT JOIN journals j ON j.name = {norm('p.journal')}"""
OA = f"""oa AS (SELECT *, 'https://oa.example.org/' || n AS base FROM (SELECT '10.1000/' || left(md5(text), 8) AS oa_doi, min(doc_id) AS n FROM documents WHERE doc_id % 3 = 1 GROUP BY 1)),
over AS (SELECT p.*, oa.n, base, n % 2 = 0 AS is_oa, CASE WHEN n % 5 <> 0 THEN {pick('n', 'gold', 'green', 'bronze')} END AS oa_status,
  CASE WHEN n % 4 = 0 THEN base || '.pdf' END AS oa_pdf, CASE WHEN n % 3 = 0 THEN base || '/page' END AS oa_page
  FROM papers p LEFT JOIN oa ON oa_doi = {doi('p.doi')}),
laid AS (SELECT * REPLACE (CASE WHEN is_oa AND oa_status IS NOT NULL THEN oa_status ELSE open_access_status END AS open_access_status,
  CASE WHEN is_oa AND oa_pdf IS NOT NULL THEN oa_pdf ELSE pdf_url END AS pdf_url,
  CASE WHEN is_oa AND landing_page_url IS NULL THEN coalesce(oa_page, base) ELSE landing_page_url END AS landing_page_url) FROM over)"""
ORACLES["oa_overlay"] = f"{P}, {OA} SELECT seq, open_access_status, pdf_url, landing_page_url, {ACCESS} AS access_score FROM laid"
OA_STATS = f"""SELECT count(*) AS total_papers, count({doi('doi')}) AS doi_count, count({doi('doi')}) AS queried_count,
  count(*) FILTER (WHERE is_oa) AS oa_found, count(oa_pdf) AS pdf_found FROM laid"""
ORACLES["oa_stats"] = f"{P}, {OA} {OA_STATS}"

# ---------------------------------------------------------------- scores

ORACLES["term_match"] = f"""{P}, {TEXTS}, {MATCHES} SELECT seq, {', '.join(f"{round2(f'm_{c}')} AS {c}" for c in ('title', 'abstract', 'keyword', 'phrase', 'coverage'))} FROM matches"""
ORACLES["term_match_lists"] = ORACLES["term_match"]
ORACLES["rule_score"] = f"{RULES} SELECT seq, relevance_score, year_score, citation_score, journal_score, access_score, type_score, rule_score, labels FROM scored"
ORACLES["rule_stats"] = f"""{RULES} SELECT count(*) AS rule_scored, count(*) FILTER (WHERE rule_score >= 55) AS rule_passed,
  {round2('avg(rule_score)')} AS rule_score_avg, {round2('max(rule_score)')} AS rule_score_max FROM scored"""
ORACLES["rule_passed"] = f"{RULES} SELECT seq, rule_score FROM scored WHERE rule_score >= 55"
ORACLES["year_filters"] = f"""{P}, y AS (SELECT seq, CASE WHEN seq % 13 <> 0 THEN year END AS year FROM papers)
SELECT count(*) AS papers, sum(seq)::BIGINT AS seq_sum, 'undated pass' AS rule FROM y WHERE year >= 2015 OR year IS NULL
UNION ALL SELECT count(*), sum(seq)::BIGINT, 'undated fail' FROM y WHERE year >= 2015"""
DOT = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: t.v[i]::DOUBLE * e.embedding[i]::DOUBLE))"


def norm2(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


SIM = f"""t AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
sim AS (SELECT vec_id, {round2(f"greatest(0e0, least(100e0, ({DOT} / ({norm2('t.v')} * {norm2('e.embedding')}) + 1e0) * 50e0))")} AS embedding_score FROM embeddings e, t)"""
ORACLES["embedding_topk"] = f"WITH {SIM} SELECT vec_id, embedding_score FROM sim ORDER BY embedding_score DESC, vec_id LIMIT 20"
ORACLES["embedding_scores"] = f"""WITH {SIM} SELECT vec_id, {round2('''CASE WHEN vec_id % 2 = 0 THEN (embedding_score + embedding_score + 40e0) / 3e0
  ELSE (0e0 + embedding_score + 40e0) / 2e0 END''')} AS combined FROM sim"""
ORACLES["embedding_stats"] = """SELECT count(vec_id) AS embedding_scored, count(*) - count(vec_id) AS embedding_failed
FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""

# ---------------------------------------------------------------- evidence


def any_term(text: str, low: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(t)})" if is_cjk(t) else f"contains({low}, {lit(t.lower())})" for t in TERMS) + ")"


EVIDENCE = f"""e1 AS (SELECT *, CASE WHEN title <> '' AND {any_term('title', 'lower(title)')} THEN ['title|' || left(title, 240) || '|matched_topic'] ELSE [] END AS by_title,
    list_transform(list_filter({SENTENCES}, lambda s: {any_term('s', 'lower(s)')}), lambda s: 'abstract|' || left(s, 320) || '|matched_topic') AS by_text,
    list_filter(keywords, lambda k: {any_term('k', 'lower(k)')}) AS kw FROM papers),
  e2 AS (SELECT *, list_concat(by_title, by_text)[1:3] AS first_items FROM e1),
  e3 AS (SELECT *, CASE WHEN len(first_items) < 3 AND len(kw) > 0 THEN list_append(first_items, 'keywords|' || left(array_to_string(kw[1:6], '; '), 320) || '|matched_topic')
    ELSE first_items END AS more FROM e2),
  ev AS (SELECT *, CASE WHEN len(more) > 0 THEN more ELSE ['metadata|{WEAK_TEXT}|weak'] END AS items FROM e3)"""
ORACLES["evidence_items"] = f"{P}, {EVIDENCE} SELECT seq, array_to_string(items, '||') AS evidence FROM ev"
ORACLES["evidence_stats"] = f"""{P}, {EVIDENCE} SELECT sum(len(items))::BIGINT AS evidence_extracted,
  count(*) FILTER (WHERE len(items) = 1 AND starts_with(items[1], 'metadata|')) AS evidence_missing_count FROM ev"""

# ---------------------------------------------------------------- selection

ORACLES["select_threshold"] = f"{RULES} SELECT seq, rule_score AS final_score FROM scored WHERE rule_score >= 55"
ORACLES["select_topk"] = f"{RULES} SELECT seq, rule_score AS final_score FROM scored ORDER BY {ORDER} LIMIT 30"
RANKED = f"ranked AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS r FROM scored)"
GROUPED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY source_database ORDER BY {ORDER}) AS r FROM scored)"
HYBRID = "SELECT *, rule_score AS final_score FROM ranked WHERE r <= 30 AND (rule_score >= 80 OR r <= 10)"
ORACLES["select_hybrid"] = f"{RULES}, {RANKED} SELECT seq, final_score FROM ({HYBRID})"
ORACLES["select_hybrid_groups"] = f"{RULES}, {GROUPED} SELECT source_database, seq, rule_score AS final_score FROM ranked WHERE r <= 25 AND (rule_score >= 62 OR r <= 10)"
ORACLES["selection_stats"] = f"""{RULES}, {RANKED} SELECT (SELECT count(*) FROM scored WHERE rule_score >= 80) AS threshold_selected,
  (SELECT count(*) FROM ({HYBRID})) AS selected_count, (SELECT count(*) FROM scored WHERE rule_score >= 80) < 10 AS fallback_topk_used"""
ORACLES["rubric_candidates"] = f"""{RULES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY source_database ORDER BY rule_score DESC, seq) AS r FROM scored)
SELECT source_database, seq, rule_score FROM ranked WHERE rule_score >= 62 OR r <= 20"""
ORACLES["cards_auto"] = f"""{RULES}, {RANKED}, grouped AS (SELECT *, CASE WHEN rule_score >= 64 AND r <= 12 THEN 0 ELSE 1 END AS g FROM ranked),
cards AS (SELECT seq, g::BIGINT AS card_group, row_number() OVER (ORDER BY g, {ORDER}) AS card_rank FROM grouped
  WHERE (EXISTS (SELECT 1 FROM grouped WHERE g = 0) OR rule_score >= 0))
SELECT * FROM cards WHERE card_rank <= 30"""
ORACLES["cards_groups"] = f"""{RULES}, {GROUPED}, grouped AS (SELECT *, CASE WHEN rule_score >= 66 AND r <= 12 THEN 0 ELSE 1 END AS g FROM ranked),
flagged AS (SELECT *, min(g) OVER (PARTITION BY source_database) AS best FROM grouped),
cards AS (SELECT source_database, seq, row_number() OVER (PARTITION BY source_database ORDER BY g, {ORDER}) AS card_rank FROM flagged WHERE best = 0 OR rule_score >= 30)
SELECT * FROM cards WHERE card_rank <= 15"""
ORACLES["top_papers"] = f"{RULES}, {RANKED} SELECT r AS rank, seq, rule_score AS final_score FROM ranked WHERE r <= 20"
ORACLES["source_quota"] = f"""{P}, r AS (SELECT source_database AS source, seq, row_number() OVER (PARTITION BY source_database ORDER BY seq) AS source_rank FROM papers)
SELECT * FROM r WHERE source_rank <= CASE source WHEN 'OpenAlex' THEN 90 WHEN 'Semantic Scholar' THEN 60 WHEN 'Crossref' THEN 30 ELSE 20 END"""

# ---------------------------------------------------------------- rubric

NO_BRACES = "replace(replace(text, '{', ''), '}', '')"
BODY = f"""'{{"topic_relevance": ' || (n % 130) || ', "confidence": "' || (n * 3 % 101) || '", "final_llm_score": ' || (n * 5 % 101) || '.5, "novelty": "n/a", "decision": " '
  || {pick('n', 'core', 'important', 'background', 'method', 'data')} || ' ", "labels": ["a", " ", "b ' || role || '"], "evidence": ["quote ' || n || '"], "reason": ""}}'"""
ANSWERS = f"""raw AS (SELECT *, conv_id * 7 + turn * 13 AS n FROM conversations),
answers AS (SELECT conv_id, turn, n, role, CASE n % 4 WHEN 0 THEN '```json' || chr(10) || {BODY} || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || {BODY} || ' Thanks, ' || {NO_BRACES}
  WHEN 2 THEN {BODY} ELSE {NO_BRACES} END AS answer FROM raw),
js AS (SELECT *, try_cast(nullif(regexp_extract(answer, '(?s)\\{{.*\\}}'), '') AS JSON) AS j FROM answers)"""


def number(path: str) -> str:
    return f"greatest(0e0, least(100e0, try_cast(json_extract_string(j, '$.{path}') AS DOUBLE)))"


def safe_number(path: str) -> str:
    return f"CASE WHEN try_cast(json_extract_string(j, '$.{path}') AS DOUBLE) IS NOT NULL THEN {number(path)} END"


def text_list(path: str) -> str:
    return f"""array_to_string(list_filter(list_transform(CAST(json_extract(j, '$.{path}') AS VARCHAR[]), lambda x: trim(x)), lambda x: x <> ''), '|')"""


ORACLES["rubric_parse"] = f"""WITH {ANSWERS} SELECT conv_id, turn, j IS NOT NULL AS parsed, {safe_number('topic_relevance')} AS topic_relevance, {safe_number('confidence')} AS confidence,
  {safe_number('final_llm_score')} AS final_llm_score, {safe_number('novelty')} AS novelty, nullif(trim(json_extract_string(j, '$.decision')), '') AS decision,
  nullif(trim(json_extract_string(j, '$.reason')), '') AS reason, {text_list('labels')} AS labels, {text_list('evidence')} AS evidence FROM js"""
ORACLES["rubric_stats"] = f"""WITH {ANSWERS}, o AS (SELECT CASE WHEN j IS NULL THEN 'failed' WHEN turn > 3 THEN 'skipped' ELSE 'scored' END AS o FROM js)
SELECT count(*) AS llm_candidates, count(*) FILTER (WHERE o = 'scored') AS llm_rubric_scored, count(*) FILTER (WHERE o = 'failed') AS llm_rubric_failed,
  count(*) FILTER (WHERE o = 'skipped') AS llm_skipped, 0::BIGINT AS llm_cache_hit, count(*) FILTER (WHERE o IN ('scored', 'failed')) AS llm_cache_miss FROM o"""
FIRST_ANSWER = "firsts AS (SELECT * FROM js QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)"
ORACLES["rubric_apply"] = f"""{P}, {EVIDENCE}, {ANSWERS}, {FIRST_ANSWER}
SELECT seq, {safe_number('final_llm_score')} AS llm_score, nullif(trim(json_extract_string(j, '$.decision')), '') AS llm_decision,
  'a|x' || CASE WHEN j IS NOT NULL THEN '|b ' || role ELSE '' END AS labels, (len(items) + CASE WHEN j IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS evidence
FROM ev LEFT JOIN firsts ON conv_id = seq"""
ORACLES["relevance_blend"] = f"""{RULES} SELECT seq, CASE WHEN seq % 3 <> 0 THEN {round2('0.6e0 * rule_score + 0.4e0 * least(100e0, (seq % 120)::DOUBLE)')} ELSE rule_score END AS final_score,
  CASE WHEN seq % 3 <> 0 THEN {round2('least(100e0, (seq % 120)::DOUBLE)')} END AS llm_score, CASE WHEN seq % 3 <> 0 THEN 'review' ELSE paper_type END AS paper_type,
  CASE WHEN seq % 3 <> 0 THEN array_to_string(list_filter(list_concat(string_split(labels, '|'), [CASE WHEN NOT list_contains(string_split(labels, '|'), 'recent') THEN 'recent' END, 'm']),
    lambda l: l IS NOT NULL AND l <> ''), '|') ELSE labels END AS labels FROM scored"""


def rendered(template: str, values: dict[str, str]) -> str:
    out = lit(template)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


PAPER_VALUES = {
    "title": "coalesce(title, '')",
    "year": "coalesce(nullif(year, 0)::VARCHAR, '')",
    "journal": "coalesce(journal, '')",
    "citation_count": "coalesce(citation_count, 0)::VARCHAR",
    "keywords": "coalesce(array_to_string(keywords, ', '), '')",
    "abstract": "coalesce(abstract, '')",
}
ORACLES["rubric_prompts"] = f"""{P} SELECT seq, md5({rendered(RUBRIC_TEMPLATE, {"topic": lit(TOPIC), "expanded_keywords": lit(', '.join(TERMS)), **PAPER_VALUES})}) AS prompt_md5,
  md5({rendered(RELEVANCE_TEMPLATE, {"topic": lit(TOPIC), **PAPER_VALUES})}) AS simple_md5 FROM papers"""

# ---------------------------------------------------------------- feedback, final score

FEEDBACK = f"""feedback AS (SELECT doc_id AS pos, {doi('doi')} AS fdoi, CASE WHEN toxic = 1 THEN 'unsure' WHEN quality = 1 THEN 'relevant' ELSE 'irrelevant' END AS human_label,
  CASE WHEN doc_id % 7 = 0 THEN 100e0 WHEN doc_id % 5 = 0 THEN 64.5e0 END AS explicit FROM labels JOIN papers ON seq = doc_id),
rated AS (SELECT *, coalesce(explicit, CASE human_label WHEN 'unsure' THEN 50e0 WHEN 'relevant' THEN 80e0 ELSE 20e0 END) AS score FROM feedback),
last_row AS (SELECT fdoi, arg_max(human_label, pos) AS human_label, arg_max(score, pos) AS human_feedback_score FROM rated WHERE fdoi IS NOT NULL GROUP BY 1)"""
ORACLES["feedback_scores"] = f"{P}, {FEEDBACK} SELECT pos, human_label AS label, score FROM rated"
ORACLES["feedback_doi"] = f"{P}, {FEEDBACK} SELECT seq, human_label, human_feedback_score FROM papers JOIN last_row ON fdoi = {doi('doi')}"
ORACLES["final_score"] = f"""{RULES}, {SIM}, {FEEDBACK}, p AS (SELECT seq, rule_score, CASE WHEN seq % 4 = 0 THEN ((seq * 13) % 101)::DOUBLE END AS llm,
  CASE WHEN seq % 4 = 0 AND seq % 8 <> 0 THEN ((seq * 7) % 100)::DOUBLE END AS conf, CASE WHEN seq % 4 = 0 THEN {pick('seq', 'core', 'method', '')} END AS dec,
  embedding_score AS emb, human_feedback_score AS human FROM scored LEFT JOIN sim ON vec_id = seq LEFT JOIN last_row ON fdoi = {doi('doi')}),
w AS (SELECT *, CASE WHEN coalesce(conf, 60) < 50 THEN {0.45 * 0.6!r}e0 ELSE 0.45e0 END AS lw FROM p),
s AS (SELECT *, (0e0 + 0.40e0 + CASE WHEN llm IS NOT NULL THEN lw ELSE 0e0 END + CASE WHEN emb IS NOT NULL THEN 0.10e0 ELSE 0e0 END + CASE WHEN human IS NOT NULL THEN 0.05e0 ELSE 0e0 END) AS weight,
  (0e0 + rule_score * 0.40e0 + coalesce(llm * lw, 0e0) + coalesce(emb * 0.10e0, 0e0) + coalesce(human * 0.05e0, 0e0)) AS weighted FROM w),
f AS (SELECT *, {round2('greatest(0e0, least(100e0, weighted / weight))')} AS final_score FROM s)
SELECT seq, rule_score, final_score, CASE WHEN dec <> '' AND conf >= 70 THEN dec WHEN final_score >= 85 THEN 'core' WHEN final_score >= 75 THEN 'important'
  WHEN final_score >= 60 THEN 'background' WHEN final_score >= 40 THEN 'peripheral' ELSE 'irrelevant' END AS final_decision,
  coalesce(conf, {round2('greatest(35e0, least(95e0, 40e0 + final_score * 0.6e0))')}) AS final_confidence FROM f"""

# ---------------------------------------------------------------- links

PAGES = "pg AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN replace(html, '</nav>', '<a href=\"/files/' || page_id || '.pdf\">x</a></nav>') ELSE html END AS html FROM pages)"


def resolved(base: str, link: str) -> str:
    root = f"(regexp_extract({base}, {lit(RFC)}, 2) || '://' || regexp_extract({base}, {lit(RFC)}, 4))"
    folder = f"coalesce(nullif(regexp_replace(regexp_extract({base}, {lit(RFC)}, 5), '[^/]*$', ''), ''), '/')"
    page = f"regexp_replace({base}, '#.*$', '')"
    return f"""CASE WHEN {link} = '' THEN {base} WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {link} WHEN starts_with({link}, '//') THEN regexp_extract({base}, {lit(RFC)}, 2) || ':' || {link}
      WHEN starts_with({link}, '/') THEN {root} || {link} WHEN starts_with({link}, '?') THEN regexp_replace({page}, '\\?.*$', '') || {link}
      WHEN starts_with({link}, '#') THEN {page} || {link} ELSE {root} || {folder} || {link} END"""


RAW_LINKS = "[]::VARCHAR[]"
for _pattern in PAGE_PATTERNS:
    RAW_LINKS = f"list_concat({RAW_LINKS}, regexp_extract_all(html, {lit(_pattern)}, 1))"
TAG_LINKS = "x[1]"
for _entity, _char in ENTITIES.items():
    TAG_LINKS = f"replace({TAG_LINKS}, {lit(_entity)}, {lit(_char)})"
_found = ", ".join("coalesce(" + ", ".join(f"nullif(regexp_extract(t, {lit(a)}, 1), '')" for a in group) + ")" for group in LINK_ATTRIBUTES)
TAG_LINKS = f"list_transform(list_filter(flatten(list_transform(regexp_extract_all(html, {lit(LINK_TAG)}), lambda t: [{_found}])), lambda u: u IS NOT NULL), lambda u: {TAG_LINKS.replace('x[1]', 'u')})"
RAW_LINKS = f"list_concat({RAW_LINKS}, {TAG_LINKS})"
PAGE_LINKS = f"""{PAGES}, pl AS (SELECT page_id, url, {RAW_LINKS} AS raw FROM pg),
pu AS (SELECT page_id, i, {resolved('url', f"{strip('raw[i]')}")} AS link FROM pl, unnest(range(1, len(raw) + 1)) AS u(i)),
pd AS (SELECT page_id, link, min(i) AS i FROM (SELECT page_id, i, link, row_number() OVER (PARTITION BY page_id, lower(link) ORDER BY i) AS k FROM pu) WHERE k = 1 GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM pd WHERE {plausible('link')})"""
ORACLES["page_pdf_links"] = f"WITH {PAGE_LINKS} SELECT page_id, coalesce((SELECT string_agg(link, '|' ORDER BY k) FROM pk WHERE pk.page_id = pages.page_id AND k <= 12), '') AS links FROM pages"
ORACLES["scraped_page_links"] = f"WITH {PAGE_LINKS} SELECT page_id, link AS url, 'crossref.page_scrape[' || (k - 1) || ']' AS source FROM pk WHERE k <= 12"
ORACLES["restricted_pages"] = f"""WITH {PAGES}, h AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN html || '<p>请登录</p>' ELSE html END AS marked FROM pg)
SELECT page_id, regexp_matches(marked, '验证码|登录|机构|权限|购买|收费|访问受限') AS restricted,
  starts_with(lower(ltrim(left(html, 300))), '<!doctype html') OR starts_with(lower(ltrim(left(html, 300))), '<html') AS is_html,
  contains(left(html, 2048), '%PDF') OR (page_id % 3 = 0 AND strlen(html) > 1024) AS is_pdf FROM h"""
OWN_LINKS = f"""own AS (SELECT seq, url, source, landing AS from_landing, row_number() OVER (PARTITION BY seq ORDER BY o) - 1 AS pos FROM (
  SELECT seq, 0 AS o, pdf_url AS url, 'metadata.pdf_url' AS source, false AS landing FROM laid
  UNION ALL SELECT seq, 1, oa_pdf, 'unpaywall.best_oa_location.url_for_pdf', false FROM laid UNION ALL SELECT seq, 2, base, 'unpaywall.best_oa_location.url', true FROM laid
  UNION ALL SELECT seq, 3, oa_page, 'unpaywall.best_oa_location.url_for_landing_page', true FROM laid
  UNION ALL SELECT seq, 4, base || '/v1.pdf', 'unpaywall.oa_locations[0].url_for_pdf', false FROM laid UNION ALL SELECT seq, 5, base || '/v1', 'unpaywall.oa_locations[0].url', true FROM laid
  UNION ALL SELECT seq, 6, landing_page_url, 'metadata.landing_page_url', true FROM laid) WHERE url IS NOT NULL),
both_links AS (SELECT seq, pos, url, source, from_landing FROM own
  UNION ALL SELECT page_id, 10000000 + k - 1, link, 'crossref.page_scrape[' || (k - 1) || ']', false FROM pk WHERE k <= 12),
links AS (SELECT * FROM both_links QUALIFY row_number() OVER (PARTITION BY seq, lower(url) ORDER BY pos) = 1)"""
LINKS = f"{P}, {OA}, {PAGE_LINKS}, {OWN_LINKS}"
ORACLES["link_candidates"] = f"{LINKS} SELECT seq, pos::BIGINT AS pos, url, source, from_landing FROM links"
LOG = """log AS (SELECT event_id AS seq, ts, event_type AS source, user_id AS paper_id, value >= 50 AS success, value * 100 AS latency_ms,
  CASE WHEN value < 50 THEN 'http_' || (400 + event_id % 4) ELSE '' END AS reason FROM events)"""


def health(source: str) -> str:
    return f"""ordered AS (SELECT *, {source} AS bucket, row_number() OVER (PARTITION BY {source} ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY {source}) AS n FROM log),
timed AS (SELECT bucket, latency_ms, row_number() OVER (PARTITION BY bucket ORDER BY ts, seq) AS i, count(*) OVER (PARTITION BY bucket) AS n FROM ordered WHERE success AND latency_ms > 0),
lat AS (SELECT bucket, sum(0.12e0 * pow(0.88e0, n - i) * latency_ms) + pow(0.88e0, max(n)) * 4000e0 AS latency_ema FROM timed GROUP BY 1),
suc AS (SELECT bucket, sum(0.12e0 * pow(0.88e0, n - i) * CASE WHEN success THEN 1e0 ELSE 0e0 END) + pow(0.88e0, max(n)) * 0.5e0 AS success_ema, count(*) AS attempts,
  arg_max(reason, i) AS last_error, max(ts) AS last_ts FROM ordered GROUP BY 1),
health AS (SELECT suc.*, coalesce(latency_ema, 4000e0) AS latency_ema FROM suc LEFT JOIN lat USING (bucket))"""


ORACLES["source_health_ema"] = f"""WITH {LOG}, {health('source')} SELECT bucket, round(success_ema, 6) AS success_ema, round(latency_ema, 3) AS latency_ema, attempts, last_error,
  strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_update FROM health"""
ORACLES["source_health_stream"] = ORACLES["source_health_ema"]
PRIORITY = "CASE " + " ".join(f"WHEN source = '{s}' THEN {p}e0" for s, p in SOURCE_PRIORITY.items())
PRIORITY += " " + " ".join(f"WHEN links2.bucket = '{s}' THEN {p}e0" for s, p in SOURCE_PRIORITY.items()) + " ELSE 0.55e0 END"
BUCKET = "CASE WHEN starts_with(source, 'metadata.') THEN source ELSE split_part(split_part(split_part(source, ':', 1), '[', 1), '.', 1) END"
ORACLES["candidate_rank"] = f"""{LINKS}, {LOG}, {health("(['unpaywall', 'arxiv', 'crossref'])[(seq % 3 + 1)::INT]")},
links2 AS (SELECT *, {BUCKET} AS bucket FROM links),
r AS (SELECT links2.*, {PRIORITY} + CASE WHEN from_landing THEN 0e0 ELSE 0.14e0 END + 0e0 + coalesce(success_ema, 0.5e0) AS p, coalesce(latency_ema, 4000e0) AS ms
  FROM links2 LEFT JOIN health ON health.bucket = links2.bucket)
SELECT seq, url, source, bucket, round(p, 6) AS priority, round(ms, 3) AS expected_ms, row_number() OVER (PARTITION BY seq ORDER BY p DESC, ms, url) AS link_rank FROM r"""


def checked(threshold: float, blocked: str) -> str:
    allowed = f"contains({part('url', 'netloc')} || {part('url', 'path')}, '{blocked}')" if blocked else "false"
    return f"""counts AS (SELECT seq, count(*) AS links, count(*) FILTER (WHERE regexp_matches(url, '(?i)^https?:') AND NOT {allowed}) AS allowed_links FROM links GROUP BY 1),
checked AS (SELECT s.*, coalesce(links, 0) AS links, coalesce(allowed_links, 0) AS allowed_links, CASE WHEN rule_score < {threshold} THEN 'skipped_score' WHEN coalesce(links, 0) = 0 THEN 'skipped_no_pdf'
  WHEN coalesce(allowed_links, 0) = 0 THEN 'skipped_restricted' ELSE 'ready' END AS status FROM scored s LEFT JOIN counts USING (seq))"""


LINKS_RULES = f"{RULES}, {OA}, {PAGE_LINKS}, {OWN_LINKS}"
ORACLES["download_precheck"] = f"{LINKS_RULES}, {checked(50, 'oa.example.org/1')} SELECT seq, links, allowed_links, status FROM checked"
ORACLES["precheck_stats"] = f"""{LINKS_RULES}, {checked(50, 'oa.example.org/1')} SELECT count(*) AS selected, count(pdf_url) AS has_pdf_url, count(*) FILTER (WHERE links > 0) AS has_candidate_url,
  count(*) FILTER (WHERE status = 'ready') AS to_download, count(*) FILTER (WHERE status = 'skipped_no_pdf') AS skipped_no_pdf,
  count(*) FILTER (WHERE status = 'skipped_restricted') AS skipped_restricted, count(*) FILTER (WHERE status = 'skipped_score') AS skipped_score FROM checked"""
ORACLES["download_plan"] = f"""{LINKS_RULES}, {checked(66, '')}, flagged AS (SELECT *, count(*) FILTER (WHERE status = 'ready') OVER (PARTITION BY source_database) AS ready FROM checked),
spare AS (SELECT *, row_number() OVER (PARTITION BY source_database ORDER BY {ORDER}) AS r FROM flagged WHERE ready = 0 AND links > 0)
SELECT source_database, seq, status, false AS fallback FROM flagged WHERE status = 'ready' UNION ALL SELECT source_database, seq, status, true FROM spare WHERE r <= 5"""
ORACLES["discovery_stats"] = f"{LINKS} SELECT (SELECT count(*) FROM papers) AS papers_seen, count(*) AS candidates_found, count(DISTINCT (seq, {BUCKET})) AS sources_with_candidates FROM links"
STATUS = "att AS (SELECT *, (['downloaded', 'request_failed', 'http_error', 'non_pdf', 'resolved_from_landing', 'blocked', 'attempt'])[(seq % 7 + 1)::INT] AS status FROM log)"
COUNTERS = f"""count(*) FILTER (WHERE status IN ({', '.join(lit(s) for s in ATTEMPTED)})) AS attempted_urls, count(*) FILTER (WHERE status = 'resolved_from_landing') AS resolved_from_landing,
  count(*) FILTER (WHERE status = 'non_pdf') AS non_pdf_responses, count(*) FILTER (WHERE status = 'blocked') AS blocked_by_policy"""
ORACLES["attempt_stats"] = f"WITH {LOG}, {STATUS} SELECT {COUNTERS} FROM att"
ORACLES["attempt_stats_by_paper"] = f"WITH {LOG}, {STATUS} SELECT paper_id, {COUNTERS}, arg_max(status, seq) AS last_status, arg_max(reason, seq) AS last_reason FROM att GROUP BY 1"
ORACLES["failure_reasons"] = f"WITH {LOG} SELECT reason, count(*) AS failures FROM log WHERE reason <> '' GROUP BY 1"
ORACLES["failure_runs"] = f"""WITH {LOG}, o AS (SELECT source, success, row_number() OVER w AS i, lag(success, 1, true) OVER w AS p1, lag(success, 2, true) OVER w AS p2 FROM log WINDOW w AS (PARTITION BY source ORDER BY ts, seq)),
g AS (SELECT source, count(*) AS attempts, min(i) FILTER (WHERE NOT success AND NOT p1 AND NOT p2) AS stop_after FROM o GROUP BY 1)
SELECT source, attempts, stop_after, coalesce(attempts - stop_after, 0)::BIGINT AS skipped FROM g"""
META = """meta AS (SELECT event_type AS source, event_type <> 'signup' AS enabled, count(*) AS queries,
  sum(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 17 END)::BIGINT AS returned, count(*) FILTER (WHERE event_id % 5 = 0) AS failed_queries,
  sum((event_id % 100)::DOUBLE) AS elapsed_seconds FROM events GROUP BY 1),
stat AS (SELECT *, CASE WHEN NOT enabled THEN 'skipped' WHEN failed_queries > 0 AND returned = 0 THEN 'failed' ELSE 'ok' END AS status FROM meta)"""
ORACLES["search_meta"] = f"WITH {META} SELECT *, status = 'ok' AS available FROM stat"
ORACLES["search_summary"] = f"WITH {META} SELECT count(*) AS sources_total, count(*) FILTER (WHERE enabled OR status = 'skipped') AS completed_sources FROM stat"

# ---------------------------------------------------------------- reports

ORACLES["papers_by_year"] = f"{P} SELECT year::VARCHAR AS year, count(*) AS papers FROM papers GROUP BY 1"
ORACLES["papers_by_journal"] = f"{P} SELECT coalesce(journal, 'unknown') AS journal, count(*) AS papers, min(seq) AS first_seq FROM papers GROUP BY 1 ORDER BY papers DESC, first_seq LIMIT 20"


def bin_of(c: str) -> str:
    return f"CASE WHEN {c} < 40 THEN '0-39' WHEN {c} < 60 THEN '40-59' WHEN {c} < 75 THEN '60-74' WHEN {c} < 85 THEN '75-84' ELSE '85-100' END"


BIN_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS score, {bin_of(c)} AS bin FROM scored" for c in ("rule_score", "citation_score", "year_score"))
ORACLES["score_bins"] = f"""{RULES}, b AS ({BIN_ROWS}), grid AS (SELECT * FROM (VALUES ('rule_score'), ('citation_score'), ('year_score')) s(score), (VALUES ('0-39'), ('40-59'), ('60-74'), ('75-84'), ('85-100')) t(bin))
SELECT grid.score, grid.bin, count(b.bin) AS papers FROM grid LEFT JOIN b USING (score, bin) GROUP BY ALL"""
ORACLES["score_averages"] = f"{RULES} SELECT {round2('avg(rule_score)')} AS rule_score_avg, {round2('avg(rule_score)')} AS final_score_avg FROM scored"
ORACLES["link_counts"] = f"{P} SELECT count(pdf_url) AS with_pdf_url, 0::BIGINT AS downloaded FROM papers"
DECIDED = "CASE WHEN rule_score >= 85 THEN 'core' WHEN rule_score >= 75 THEN 'important' WHEN rule_score >= 60 THEN 'background' WHEN rule_score >= 40 THEN 'peripheral' ELSE 'irrelevant' END"
ORACLES["low_confidence"] = f"""{RULES}, {ANSWERS}, {FIRST_ANSWER} SELECT row_number() OVER (ORDER BY {ORDER}) AS rank, seq FROM scored JOIN firsts ON conv_id = seq % 97
WHERE j IS NOT NULL AND coalesce({safe_number('confidence')}, 0) < 50 ORDER BY rank LIMIT 20"""
ORACLES["report_lists"] = f"""{RULES}, {RANKED}, {ANSWERS}, {FIRST_ANSWER}, t AS (SELECT ranked.*, j FROM ranked LEFT JOIN firsts ON conv_id = seq % 97 WHERE r <= 20),
l AS (SELECT 'core' AS list, r, seq FROM t WHERE {DECIDED} = 'core' UNION ALL SELECT 'method', r, seq FROM t WHERE contains(json_extract_string(j, '$.decision'), 'method')
  UNION ALL SELECT 'data', r, seq FROM t WHERE contains(json_extract_string(j, '$.decision'), 'data')),
k AS (SELECT list, row_number() OVER (PARTITION BY list ORDER BY r) AS list_rank, seq FROM l) SELECT * FROM k WHERE list_rank <= 10"""


def escaped(x: str) -> str:
    for char in ["\\", "{", "}", "&", "%", "_"]:
        x = f"replace({x}, {lit(char)}, {lit(chr(92) + char)})"
    return x


BIB_KEY = clean_name(f"concat_ws('_', {author('authors')}, year::VARCHAR, {short('title', 3)})", 80)
ORACLES["bibtex"] = f"""{P} SELECT seq, concat_ws(chr(10), '@article{{' || {BIB_KEY} || ',', '  title = {{' || {escaped('title')} || '}},',
  '  author = {{' || CASE WHEN len(authors) > 0 THEN {escaped("array_to_string(authors, ' and ')")} ELSE 'Unknown' END || '}},', '  year = {{' || year || '}},',
  '  journal = {{' || nullif({escaped('journal')}, '') || '}},', '  doi = {{' || doi || '}},', '  url = {{' || landing_page_url || '}},', '}}') AS entry FROM papers"""
PDF_STEM = f"concat_ws('_', year::VARCHAR, {author('authors')}, {short('title', 5)}, replace(replace(coalesce(doi, 'no_doi'), '/', '_'), '.', '_')) || '.pdf'"
CARD_STEM = f"concat_ws('_', format('{{:03d}}', seq + 1), {author('authors')}, {short('title', 6)})"
ORACLES["file_names"] = f"{P} SELECT seq, {clean_name(PDF_STEM, 180)} AS pdf_name, {clean_name(CARD_STEM, 120)} || '.md' AS card_name FROM papers"
CARD_OF_RANK = CARD_STEM.replace("seq + 1", "rank")
ORACLES["card_index"] = f"""{RULES}, {RANKED}, grouped AS (SELECT *, CASE WHEN r <= 30 AND (rule_score >= 80 OR r <= 10) THEN 0 ELSE 1 END AS g FROM ranked),
c AS (SELECT *, row_number() OVER (ORDER BY g, {ORDER}) AS rank FROM grouped)
SELECT rank, format('{{:.2f}}', rule_score) AS final_score, {DECIDED} AS decision, year::VARCHAR AS year, replace(title, '|', ' ') AS title, replace(coalesce(journal, ''), '|', ' ') AS journal,
  coalesce(doi, '') AS doi, {clean_name(CARD_OF_RANK, 120)} || '.md' AS card FROM c WHERE rank <= 30"""

# ---------------------------------------------------------------- reuse

WORK_KEY = f"sha256(concat_ws(chr(31), 'evidence_v1', {lit(TOPIC)}, id, coalesce(title, ''), md5(coalesce(abstract, '')), ''))"
ORACLES["incremental_todo"] = f"{P} SELECT seq, {WORK_KEY} AS key FROM papers WHERE seq % 3 <> 0"
ORACLES["incremental_reuse"] = f"{P} SELECT {WORK_KEY} AS key, seq AS result FROM papers WHERE seq % 4 = 0 AND seq % 6 < 3"

# ---------------------------------------------------------------- expansion and retrieval

TOPICS = r"""tp AS (SELECT item_id AS topic_id, array_to_string(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+')[1:4], ' ') AS topic FROM benchmark),
lg AS (SELECT *, CASE WHEN regexp_matches(topic, '[A-Za-z]') THEN CASE WHEN regexp_matches(topic, '[一-鿿]') THEN 'mixed' ELSE 'en' END WHEN regexp_matches(topic, '[一-鿿]') THEN 'zh' END AS detected_language FROM tp)"""
EN_TOKENS = dedupe("list_filter(regexp_extract_all(topic, '[A-Za-z][A-Za-z0-9\\-\\+_\\.]*'), lambda t: length(t) > 2 OR lower(t) IN ('gcam', 'iam'))")
COMBO = ", ".join(f"({i}, [{', '.join(map(str, c))}])" for i, c in enumerate(COMBINATIONS))
RELATED = "[" + ", ".join(lit(t) for t in RELATED_TERMS) + "]"
EXPANDED = f"""{TOPICS}, ek AS (SELECT *, {EN_TOKENS} AS en FROM lg), cb(ci, c) AS (VALUES {COMBO}),
cq AS (SELECT topic_id, ci, array_to_string(list_transform(c, lambda i: en[i]), ' ') AS q FROM ek, cb WHERE list_max(c) <= least(8, len(en))),
cl AS (SELECT topic_id, list(q ORDER BY ci) AS qs FROM cq WHERE length(q) >= 8 GROUP BY 1),
eq AS (SELECT ek.*, {dedupe("list_concat([topic], coalesce(qs, []))[1:12]")} AS enq FROM ek LEFT JOIN cl USING (topic_id)),
ex AS (SELECT *, {RELATED} AS related, {dedupe(f"list_concat(list_concat([topic], enq), {RELATED})")}[1:30] AS loose,
  {dedupe("list_concat(list_concat([topic], list_transform(enq[1:4], lambda q: '\"' || q || '\"')), ['\"' || topic || '\"'])")}[1:16] AS phrases,
  list_filter(en, lambda k: length(k) > 2) AS en2 FROM eq),
ez AS (SELECT *, CASE WHEN len(en2) > 0 THEN '(' || array_to_string(list_transform(en2[1:2], lambda k: '"' || k || '"'), ' OR ') || ') AND ("China") AND ("carbon neutrality" OR "net zero")' END AS boolean FROM ex)"""
ORACLES["query_expand"] = f"""WITH {EXPANDED} SELECT topic_id, detected_language, topic AS english_topic, array_to_string(en, '|') AS english_keywords, '' AS chinese_keywords,
  array_to_string(related, '|') AS related_terms, array_to_string(loose, '|') AS loose_queries, array_to_string(phrases, '|') AS phrase_queries, coalesce(boolean, '') AS boolean_queries FROM ez"""
ORACLES["expansion_counts"] = f"""WITH {EXPANDED} SELECT topic_id, (len(loose) + len(phrases) + CASE WHEN boolean IS NULL THEN 0 ELSE 1 END)::BIGINT AS query_count,
  len(en)::BIGINT AS english_keywords_count, 0::BIGINT AS chinese_keywords_count FROM ez"""
RUNS = "list_transform(list_filter([1, 3, 5, 7], lambda i: i <= least(8, len(en))), lambda i: array_to_string((en[1:8])[i:i + 2], ' '))"
POOLS = {
    "OpenAlex": ("list_concat(list_concat(list_concat([topic], phrases), loose), list_filter([boolean], lambda b: b IS NOT NULL))", 24),
    "Semantic Scholar": (f"list_concat(list_concat(list_concat([topic], phrases[1:6]), loose[1:8]), {RUNS})", 16),
    "Crossref": ("list_concat(list_concat([topic], loose), phrases)", 16),
    "arXiv": ("list_concat(list_concat([topic], en[1:10]), loose)", 8),
    "CNKI": (f"list_concat([topic], [{', '.join(lit(q) for q in CHINESE_POOL)}])", 10),
}
ORACLES["query_pools"] = f"WITH {EXPANDED}, pools AS (" + " UNION ALL ".join(
    f"SELECT topic_id, '{name}' AS provider, {dedupe(parts)}[1:{size}] AS pool FROM ez" for name, (parts, size) in POOLS.items()
) + ") SELECT topic_id, provider, (i - 1)::BIGINT AS pos, pool[i] AS query FROM pools, unnest(range(1, len(pool) + 1)) AS u(i)"
TOKENS_OF_TOPIC = f"list_filter(regexp_extract_all(lower(topic), '{TOKEN}'), lambda t: length(t) > 2)"
ORACLES["scoring_term_lists"] = f"""WITH {EXPANDED} SELECT topic_id, array_to_string({dedupe('list_concat(list_concat(en, related), [topic])')}[1:60], '|') AS terms,
  array_to_string({dedupe(f'list_concat(list_concat(list_concat([topic], {TOKENS_OF_TOPIC}), en), related)')}[1:80], '|') AS evidence_terms,
  array_to_string({dedupe('list_concat([topic], phrases)')}[1:20], '|') AS phrases,
  array_to_string({dedupe('list_concat(list_concat([topic], loose), list_filter([boolean], lambda b: b IS NOT NULL))')}[1:20], '|') AS loose FROM ez"""
ORACLES["expansion_merge"] = f"""WITH {EXPANDED} SELECT topic_id, CASE WHEN topic_id % 2 = 0 THEN 'Topic ' || topic_id ELSE topic END AS english_topic,
  array_to_string(CASE WHEN topic_id % 2 = 0 THEN {dedupe("list_concat(en, ['extra one', 'THE', 'extra one'])")} ELSE en END, '|') AS english_keywords,
  CASE WHEN topic_id % 2 = 0 THEN 'other ' || topic_id ELSE '' END AS synonyms FROM ez"""
PADDED = f"""pad AS (SELECT seq, ' ' || {norm('title')} || ' ' AS t1, ' ' || {norm("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))")} || ' ' AS t2,
  ' ' || {norm("concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''), array_to_string(list_filter(keywords, lambda k: k <> ''), ' '))")} || ' ' AS t3 FROM papers)"""
ORACLES["retrieve_topk"] = f"""{P}, {TOPICS}, {PADDED}, qs AS (SELECT topic_id AS query_id, list_distinct(list_filter(string_split({norm("array_to_string(string_split(topic, ' ')[1:2], ' ')")}, ' '), lambda w: w <> '')) AS ws FROM tp),
m AS (SELECT query_id, seq, round(0.30e0 * (100e0 * len(list_filter(ws, lambda w: contains(t1, ' ' || w || ' '))) / len(ws)) + 0.25e0 * (100e0 * len(list_filter(ws, lambda w: contains(t2, ' ' || w || ' '))) / len(ws)), 4) AS relevance
  FROM qs, pad WHERE len(ws) > 0 AND len(list_filter(ws, lambda w: contains(CASE query_id % 3 WHEN 0 THEN t3 WHEN 1 THEN t2 ELSE t1 END, ' ' || w || ' '))) = len(ws)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, seq) AS hit_rank FROM m) SELECT * FROM r WHERE hit_rank <= 20"""

# Chinese dress: letters as Han characters without blanks; a Han word matches anywhere inside a run.
HAN = f"translate(regexp_replace(lower({{}}), '[ à-ÿ]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', '{HAN_LETTERS}')"
HAN_TEXT = f"""han AS (SELECT seq, {norm('h1')} AS t1, {norm("concat_ws(' ', h1, h2)")} AS t2
  FROM (SELECT seq, {HAN.format("coalesce(title, '')")} AS h1, {HAN.format("coalesce(abstract, '')")} AS h2 FROM papers))"""
WORDS_OF = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))"


def best_hits(texts: str, queries: str, text: str, matched: str, holds: str) -> str:
    """Twenty best papers of queries (query_id, ws) whose ``text`` is ``matched``; relevance by the words in t1 and t2."""
    share = "100e0 * len(list_filter(ws, lambda w: " + holds + ")) / len(ws)"
    return f"""{P}, {TOPICS}, {texts}, qs AS ({queries}), m AS (
  SELECT query_id, seq, round(0.30e0 * ({share.format('t1')}) + 0.25e0 * ({share.format('t2')}), 4) AS relevance
  FROM (SELECT *, {text} AS t FROM qs, {texts.split(' ')[0]}) WHERE len(ws) > 0 AND {matched}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, seq) AS hit_rank FROM m)
SELECT * FROM r WHERE hit_rank <= 20"""


ORACLES["retrieve_cjk"] = best_hits(
    HAN_TEXT,
    f"SELECT topic_id AS query_id, {WORDS_OF.format(norm(HAN.format("array_to_string(string_split(topic, ' ')[1:2], ' ')")))} AS ws FROM tp",
    "CASE query_id % 3 WHEN 2 THEN t1 ELSE t2 END",
    "len(list_filter(ws, lambda w: contains(t, w))) = len(ws)",
    "contains({}, w)",
)
ORACLES["retrieve_phrase"] = best_hits(
    PADDED,
    f"SELECT topic_id AS query_id, {norm("array_to_string(string_split(topic, ' ')[1:2], ' ')")} AS phrase, "
    f"{norm("coalesce(string_split(topic, ' ')[3], '')")} AS word, "
    f"{WORDS_OF.format(norm("array_to_string(string_split(topic, ' ')[1:3], ' ')"))} AS ws FROM tp",
    "CASE query_id % 3 WHEN 0 THEN t3 WHEN 1 THEN t2 ELSE t1 END",
    "contains(t, ' ' || phrase || ' ') AND (word = '' OR contains(t, ' ' || word || ' '))",
    "contains({}, ' ' || w || ' ')",
)

assert DEFAULTS["weights"]["relevance"] == 0.40

# ---------------------------------------------------------------- wide outputs

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&middot;": "·", "&copy;": "©", "&amp;": "&"}
PAGE_TEXT = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')"
for _name, _char in ENTITIES.items():
    PAGE_TEXT = f"replace({PAGE_TEXT}, {lit(_name)}, {lit(_char)})"
ORACLES["page_text"] = f"WITH {PAGES} SELECT page_id, {squeeze(PAGE_TEXT)} AS text FROM pg"

RULE_STATS = f"""SELECT count(*) AS rule_scored, count(*) FILTER (WHERE rule_score >= 55) AS rule_passed,
  {round2('avg(rule_score)')} AS rule_score_avg, {round2('max(rule_score)')} AS rule_score_max FROM scored"""
ORACLES["diagnostics_json"] = f"""{RULES}, {OA}, {KEYED}, s1 AS ({RULE_STATS}), s2 AS ({OA_STATS}),
c AS (SELECT count(*) AS b, count(DISTINCT gid) + count(*) FILTER (WHERE gid IS NULL) AS a FROM keyed),
s3 AS (SELECT b AS before, a AS after, greatest(0, b - a)::BIGINT AS removed FROM c)
SELECT to_json({{'scoring': s1, 'unpaywall': s2, 'deduplication': s3}})::VARCHAR AS value FROM s1, s2, s3"""

EVIDENCE_TEXT = "array_to_string(list_transform(items, lambda x: regexp_replace(regexp_replace(x, '^[a-z]+\\|', ''), '\\|(matched_topic|weak)$', '')), ' | ')"
FLAT: dict[str, str] = {
    "paper_id": "s.id",
    "final_score": "fs",
    "final_decision": DECIDED.replace("rule_score", "fs"),
    "final_confidence": round2("greatest(35e0, least(95e0, 40e0 + fs * 0.6e0))"),
    "rule_score": "rule_score",
    "evidence": EVIDENCE_TEXT,
    "usable_for": "''",
    "labels": "replace(labels, '|', '; ')",
    "title_match_score": round2("m_title"),
    "abstract_match_score": round2("m_abstract"),
    "keyword_match_score": round2("m_keyword"),
    "phrase_match_score": round2("m_phrase"),
    "fuzzy_match_score": "0e0",
    **{c: f"s.{c}" for c in ("title", "year", "journal", "doi", "citation_count", "open_access_status", "pdf_url", "landing_page_url", "source_database", "paper_type", "primary_topic")},
    **{c: f"coalesce(array_to_string(s.{c}, ', '), '')" for c in ("authors", "matched_queries", "keywords", "concepts", "topics")},
    "source_count": "1::INT",
    "download_candidate_count": "0::BIGINT",
    "download_attempts": "0::BIGINT",
    "cnki_download_count": "NULL::INT",
    "cnki_restricted": "NULL::BOOLEAN",
}
NUMBERS = {"llm_score", "llm_final_score", "llm_confidence", "human_feedback_score", *FLAT_COLUMNS[8:16], *FLAT_COLUMNS[22:26]}
ORACLES["flat_table"] = f"""{RULES}, {EVIDENCE}, fin AS (SELECT *, {round2('(0e0 + rule_score * 0.40e0) / (0e0 + 0.40e0)')} AS fs FROM scored)
SELECT {', '.join(f"{FLAT.get(c, 'NULL::DOUBLE' if c in NUMBERS else 'NULL::VARCHAR')} AS {c}" for c in FLAT_COLUMNS)} FROM fin s JOIN (SELECT seq AS ev_seq, items FROM ev) e ON ev_seq = s.seq"""
