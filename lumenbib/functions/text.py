"""Text keys and cleaners as Column expressions; everything here stays in the JVM except ``strip_html``."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\x0b\x0c"
CJK = "[\\u4e00-\\u9fff]"

# Patterns that define the keys.
DOI_PREFIX = r"(?i)^https?://(dx\.)?doi\.org/"
NOT_WORD = r"[^\p{L}\p{N}_\s]"
NOT_FILENAME = r'[\\/*?:"<>|]+'
TOPIC_TOKEN = r"[a-z0-9][a-z0-9\-\+_\.]*"
SENTENCE_BREAK = r"[。！？!?;\n]|(?<=\.)\s+"
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf|ftp)/([^\s?#&]+)"
ARXIV_ID = r"(?i)(?:arxiv\s*:\s*)?(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[a-z]+)?/\d{7}(?:v\d+)?)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def missing_if_blank(c: Column | str) -> Column:
    """The merge and scoring rules treat an empty string as missing."""
    return F.nullif(col(c), F.lit(""))


def round2(c: Column) -> Column:
    """Half-up at two places by plain arithmetic: stays in codegen and equals the same SQL elsewhere."""
    return F.floor(c * 100.0 + 0.5).cast("double") / 100.0


def has_cjk(c: Column | str) -> Column:
    return col(c).rlike(CJK)


# ---------------------------------------------------------------- keys


def normalize_doi(c: Column | str) -> Column:
    bare = F.regexp_replace(strip(c), DOI_PREFIX, "")
    return missing_if_blank(F.lower(strip(bare)))


def normalize_title(c: Column | str) -> Column:
    """Lower case, punctuation to blanks, blanks squeezed. Unicode letters and digits stay."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), NOT_WORD, " "))


normalize_journal = normalize_title


def title_tokens(c: Column | str) -> Column:
    """Distinct tokens of the normalised title in alphabetical order (empty array for a blank title)."""
    words = F.filter(F.split(normalize_title(c), " "), lambda w: w != "")
    return F.array_sort(F.array_distinct(words))


def short_title(c: Column | str, max_words: int = 6) -> Column:
    head = F.array_join(F.slice(F.split(normalize_title(c), " "), 1, max_words), "_")
    return F.coalesce(missing_if_blank(head), F.lit("untitled"))


def first_author(authors: Column | str) -> Column:
    """Surname of author one: the last word before the comma; ``unknown`` where there is none."""
    lead = strip(F.get(col(authors), F.lit(0)))
    surname = F.element_at(F.split(squeeze(F.split_part(lead, F.lit(","), F.lit(1))), " "), -1)
    key = F.replace(normalize_title(surname), F.lit(" "), F.lit("_"))
    return F.coalesce(missing_if_blank(key), F.lit("unknown"))


def clean_filename(c: Column | str, max_len: int = 120) -> Column:
    name = F.regexp_replace(strip(F.regexp_replace(col(c), NOT_FILENAME, "_")), r"\s+", "_")
    name = F.btrim(name, F.lit("._"))
    return F.substring(F.coalesce(missing_if_blank(name), F.lit("paper")), 1, max_len)


def paper_key(doi: Column | str, title: Column | str, paper_id: Column | str) -> Column:
    """Stable lookup key: DOI, else title, else record id."""
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(doi)),
        F.concat(F.lit("title:"), missing_if_blank(normalize_title(title))),
        F.concat(F.lit("paper:"), col(paper_id)),
    )


def source_bucket(c: Column | str) -> Column:
    """Stable bucket of a detailed link label: cut at ``:`` and ``[``, keep ``metadata.x`` and ``raw.x``."""
    text = F.lower(strip(F.coalesce(missing_if_blank(c), F.lit("unknown"))))
    base = F.split_part(F.split_part(text, F.lit(":"), F.lit(1)), F.lit("["), F.lit(1))
    kept = F.when(base.startswith("metadata.") | base.startswith("raw."), base)
    head = missing_if_blank(F.split_part(base, F.lit("."), F.lit(1)))
    return F.coalesce(kept, head, F.lit("unknown"))


def arxiv_id(c: Column | str) -> Column:
    """arXiv id without version: from an arxiv.org link first, else the first id-shaped piece."""
    text = F.coalesce(col(c), F.lit(""))
    raw = F.coalesce(
        missing_if_blank(F.regexp_extract(text, ARXIV_URL, 1)),
        F.when(~text.rlike(ARXIV_URL), missing_if_blank(F.regexp_extract(text, ARXIV_ID, 1))),
    )
    bare = F.regexp_replace(strip(raw), r"(?i)^arxiv\s*:\s*", "")
    bare = strip(F.regexp_replace(bare, r"(?i)v\d+$", ""))
    return F.when(bare.rlike("^" + ARXIV_ID.replace("(?i)", "(?i:") + ")"), bare)


# ---------------------------------------------------------------- lists


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it inside lambdas: a captured expression runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ordered_distinct(values: Column | str, clean: bool = True) -> Column:
    """Case-insensitive distinct in list order, first spelling kept.

    ``clean`` squeezes blanks in the values; without it values stay as they are and only
    null or empty ones go.
    """
    values = col(values)
    if clean:
        values = F.transform(values, lambda v: squeeze(v))

    def keyed(items: Column) -> Column:
        # Sorted by key and place, the first of each key stands behind another one: no search through the list per value.
        entries = F.sort_array(F.transform(items, lambda v, i: F.struct(F.lower(strip(v)).alias("key"), i.alias("i"), v.alias("v"))))
        firsts = let(entries, lambda e: F.filter(e, lambda x, j: (j == 0) | (x["key"] != F.get(e, j - 1)["key"])))
        return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"], x["v"]))), lambda x: x["v"])

    return let(F.filter(values, lambda v: v.isNotNull() & (v != "")), keyed)


def no_nulls(values: Column | str) -> Column:
    return F.coalesce(col(values), F.array().cast("array<string>"))


def non_blank(values: Column | str) -> Column:
    return F.filter(no_nulls(values), lambda v: v.isNotNull() & (v != ""))


def join_non_empty(*values: Column, sep: str = ", ") -> Column:
    return F.concat_ws(sep, *[missing_if_blank(v) for v in values])


def tokenize_topic(c: Column | str) -> Column:
    found = F.regexp_extract_all(F.lower(col(c)), F.lit(TOPIC_TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) > 2)


def words(c: Column | str) -> Column:
    """All tokens of a text in order, for retrieval."""
    return F.filter(F.split(normalize_title(c), " "), lambda w: w != "")


def split_sentences(c: Column | str) -> Column:
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), SENTENCE_BREAK), lambda s: squeeze(s))
    return F.filter(parts, lambda s: s != "")


def detect_language(c: Column | str) -> Column:
    zh, en = has_cjk(c), col(c).rlike("[A-Za-z]")
    return F.when(zh & ~en, "zh").when(en & ~zh, "en").when(zh & en, "mixed")


def term_in_text(term: str | Column, text: Column) -> Column:
    """CJK terms match as they are, others in lower case. ``text`` is already lowered by the caller."""
    if isinstance(term, str):
        import re

        needle = term if re.search(CJK, term) else term.lower()
        return F.contains(text, F.lit(needle))
    return F.contains(text, F.when(has_cjk(term), term).otherwise(F.lower(term)))


def term_in_raw_text(term: str | Column, text: Column, lowered: Column) -> Column:
    """Twin of :func:`term_in_text` for evidence: CJK terms look into the text before lowering."""
    if isinstance(term, str):
        import re

        return F.contains(text, F.lit(term)) if re.search(CJK, term) else F.contains(lowered, F.lit(term.lower()))
    return F.when(has_cjk(term), F.contains(text, term)).otherwise(F.contains(lowered, F.lower(term)))


# ---------------------------------------------------------------- markup


@F.pandas_udf(T.StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def strip_html(c: Column | str) -> Column:
    """Tags to blanks, entities resolved, blanks squeezed. Only values with ``&`` carry text to Python."""
    bare = F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " ")
    resolved = F.coalesce(_unescape(F.when(F.contains(bare, F.lit("&")), bare)), bare)
    return F.trim(F.regexp_replace(resolved, r"(?U)\s+", " "))


def escape_bibtex(c: Column | str) -> Column:
    out = col(c)
    # Characters escaped, backslash first.
    for char in ["\\", "{", "}", "&", "%", "_"]:
        out = F.replace(out, F.lit(char), F.lit("\\" + char))
    return out
