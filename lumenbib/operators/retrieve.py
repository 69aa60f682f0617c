"""Retrieval: query pools against a positional index of the paper table.

A query is a conjunction of groups of alternatives, each a word or a phrase; a quoted part of a query is one phrase. A
paper can only match when it holds all tokens of an alternative of each group, so every query probes with the rarest
tokens of its cheapest group, and the places of its other tokens are looked up by paper and token for what comes back.
A frequent word drives the probe only where every group has one. Queries that a task can hold are broadcast to the papers,
whose tokens stay in their rows; more of them meet an index that is dealt out by token and, for frequent ones, by paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.functions.text import normalize_title, squeeze, words
from lumenbib.operators.expand import concept_pool, query_pool
from lumenbib.operators import postings
from lumenbib.operators.postings import last_word, phrase
from lumenbib.session import cut_lineage

# Search modes in turn, share of each source, least share.
MODES = ["default", "title_abstract", "title"]
SOURCE_SHARES = {"OpenAlex": 0.45, "Semantic Scholar": 0.30, "Crossref": 0.15, "arXiv": 0.10}
SOURCE_SHARES_WITH_CNKI = {
    "OpenAlex": 0.35,
    "Semantic Scholar": 0.25,
    "Crossref": 0.15,
    "arXiv": 0.10,
    "CNKI": 0.15,
}
LEAST_SHARE = {"OpenAlex": 20, "Semantic Scholar": 15, "Crossref": 10, "arXiv": 10, "CNKI": 10}
QUERY_LIMITS = {"OpenAlex": (8, 80, 8), "Semantic Scholar": (10, 120, 10), "Crossref": (8, 60, 6), "arXiv": (10, 100, 10)}
TRACE_PREFIX = {"Semantic Scholar": "semantic_scholar", "Crossref": "crossref", "arXiv": "arxiv", "CNKI": "cnki"}


def sanitize_query(c: Column | str) -> Column:
    return squeeze(F.regexp_replace(c, "[,:]", " "))


def source_limits(total: int, sources: list[str], cnki_limit: int = 100) -> dict[str, int]:
    """Candidates per source: shares renormalised over the enabled sources, with floors."""
    shares = SOURCE_SHARES_WITH_CNKI if "CNKI" in sources else SOURCE_SHARES
    whole = sum(share for name, share in shares.items() if name in sources)
    if whole <= 0:
        raise ValueError("no enabled source")
    limits = {}
    for name, share in shares.items():
        if name in sources:
            limits[name] = max(LEAST_SHARE[name], int(total * (share / whole)))
            if name == "CNKI":
                limits[name] = min(limits[name], cnki_limit)
    return limits


def per_query_limit(provider: str, limit: int, queries: Column, most: int | None = None) -> Column:
    """Hits kept per query: the limit spread over the queries plus a margin, inside bounds; ``most`` is an upper bound."""
    low, high, margin = QUERY_LIMITS.get(provider, (10, 100, 10))
    high = most or high
    spread = F.ceil(F.lit(float(limit)) / F.greatest(F.lit(1), queries)) + margin
    return F.greatest(F.lit(low), F.least(F.lit(high), spread)).cast("int")


def provider_queries(expanded: DataFrame, provider: str, limit: int = 500, most: int | None = None) -> DataFrame:
    """``(topic_id, source, q_order, query, mode, trace, hits, newest)`` for one provider."""
    pool = expanded.select("topic_id", query_pool(provider, limit).alias("pool"), concept_pool(max(6, limit // 5)).alias("concepts"))
    main = pool.select(
        "topic_id", F.size("pool").alias("n"), F.posexplode("pool").alias("i", "query"), F.lit(provider).alias("source")
    )
    limit_here = per_query_limit(provider, limit, F.col("n"), most)
    if provider != "OpenAlex":
        return main.select(
            "topic_id",
            "source",
            (F.col("i") * 2).alias("q_order"),
            "query",
            F.lit("default").alias("mode"),
            F.concat(F.lit(TRACE_PREFIX[provider] + ":"), "query").alias("trace"),
            limit_here.alias("hits"),
            F.lit(False).alias("newest"),
        )
    mode = F.get(F.array(*[F.lit(m) for m in MODES]), F.col("i") % 3)
    columns = ["topic_id", "source", "q_order", "query", "mode", "trace", "hits", "newest"]
    first = main.withColumns(
        {"q_order": F.col("i") * 2, "mode": mode, "hits": F.greatest(F.lit(6), limit_here), "newest": F.lit(False)}
    )
    first = first.withColumn("trace", F.concat("mode", F.lit(":"), "query"))
    extra = first.filter("i % 4 = 0").withColumns(
        {
            "q_order": F.col("q_order") + 1,
            "mode": F.lit("default"),
            "hits": F.greatest(F.lit(4), F.floor(F.col("hits") / 2)).cast("int"),
            "trace": F.concat(F.lit("default:"), "query"),
        }
    )
    each = F.greatest(F.lit(4), F.ceil(F.lit(float(max(6, limit // 5))) / F.col("n"))).cast("int")
    concept = pool.select("topic_id", F.size("concepts").alias("n"), F.posexplode("concepts").alias("i", "query")).select(
        "topic_id",
        F.lit(provider).alias("source"),
        (F.col("i") + 1000).alias("q_order"),
        "query",
        F.lit("default").alias("mode"),
        F.concat(F.lit("concept:"), "query").alias("trace"),
        each.alias("hits"),
        F.lit(True).alias("newest"),
    )
    return first.select(columns).unionByName(extra.select(columns)).unionByName(concept)


QUOTED = r'"([^"]*)"'


def query_groups(query: Column | str) -> Column:
    """Conjunction of alternatives: the quoted phrases and the single words of a plain query, or the AND / OR groups
    of a boolean one."""
    query = F.col(query) if isinstance(query, str) else query
    quoted = F.transform(F.regexp_extract_all(query, F.lit(QUOTED), F.lit(1)), lambda p: normalize_title(p))
    single = words(F.regexp_replace(query, QUOTED, " "))
    plain = F.transform(F.array_distinct(F.filter(F.concat(quoted, single), lambda w: w != "")), lambda w: F.array(w))
    groups = F.transform(
        F.split(query, " AND "),
        lambda g: F.filter(F.transform(F.split(g, " OR "), lambda p: normalize_title(p)), lambda p: p != ""),
    )
    return F.when(query.rlike(" (AND|OR) "), groups).otherwise(plain)


def search(queries: DataFrame, papers: DataFrame, year_from: int | None = None, keep_undated: bool = True) -> DataFrame:
    """All matches ``(query_id, seq, relevance, ...)`` of ``queries(query_id, query, mode, source)``.

    A query only looks at the papers of its source when ``source`` is not null. ``relevance`` weighs
    the share of query words in the title by 0.30 and in the abstract by 0.25.
    """
    if year_from:
        old = F.col("year") < year_from
        papers = papers.filter(~F.coalesce(old, F.lit(False)) if keep_undated else F.col("year") >= year_from)
    asked = queries.withColumns({
        "groups": F.transform(query_groups("query"), lambda g: F.transform(g, phrase)),
        "words": F.transform(F.array_distinct(words("query")), phrase),
    }).filter(F.size("groups") > 0)
    prepared = cut_lineage(asked.repartition("query_id"))
    phrases = prepared.select("query_id", F.explode(F.concat(F.flatten("groups"), "words")).alias("p"))
    tokens = phrases.select("query_id", (F.size("p.tokens") > 1).alias("spots_needed"), F.explode("p.tokens.token").alias("token"))
    wanted = cut_lineage(tokens.groupBy("token").agg(F.max("spots_needed").alias("spots_needed")))
    few = wanted.count() <= postings.BROADCAST_TOKENS and prepared.count() <= postings.BROADCAST_QUERIES
    seen = _seen_in_rows(prepared, papers, wanted) if few else _seen_by_index(prepared, papers, wanted, tokens)
    limit = (
        F.when(F.col("mode") == "title", F.col("title_words"))
        .when(F.col("mode") == "title_abstract", F.col("both_words"))
        .otherwise(F.lit(1 << 30))
    )
    found = F.col("found")
    matched = F.forall("groups", lambda g: F.exists(g, lambda p: F.coalesce(last_word(p, found) < limit, F.lit(False))))

    def share(most: str) -> Column:
        hits = F.size(F.filter("words", lambda p: F.coalesce(last_word(p, found) < F.col(most), F.lit(False))))
        return 100.0 * hits / F.greatest(F.lit(1), F.size("words"))

    relevance = 0.30 * share("title_words") + 0.25 * share("both_words")
    return seen.filter(matched).select(*queries.columns, "seq", "year", relevance.alias("relevance"))


def _rarest(prepared: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(query_id, probe)``: the rarest tokens ``(df, token)`` of the alternatives of each query's cheapest group."""
    return (
        prepared.select("query_id", F.posexplode("groups").alias("g", "alternatives"))
        .select("query_id", "g", F.posexplode("alternatives").alias("a", "p"))
        .select("query_id", "g", "a", F.explode("p.tokens.token").alias("token"))
        .join(frequency, "token", "left")
        .groupBy("query_id", "g", "a")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("rare"))
        .groupBy("query_id", "g")
        .agg(F.sum("rare.df").alias("cost"), F.collect_set("rare").alias("probe"))
        .groupBy("query_id")
        .agg(F.min(F.struct("cost", "g", "probe")).alias("best"))
        .select("query_id", "best.probe")
    )


def _seen_in_rows(prepared: DataFrame, papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Queries beside the papers that hold a probe of theirs, with the tokens ``found`` in the paper.

    Queries are few and go to the papers: a paper's tokens stay in its row, no posting is shuffled.
    """
    held = postings.held_tokens(papers, wanted)
    frequency = held.select(F.explode(F.map_keys("found")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    probes = _rarest(prepared, frequency).withColumn("probes", F.transform("probe", lambda p: p["token"])).select("query_id", "probes")
    asked = cut_lineage(prepared.join(probes, "query_id").withColumn("token", F.explode("probes")))
    met = held.select("*", F.explode(F.map_keys("found")).alias("token")).join(F.broadcast(asked), "token")
    met = met.filter(F.col("source").isNull() | (F.col("source") == F.col("source_database")))
    # A paper that holds several probes of a query is met once, by the first of them.
    first = F.get(F.filter("probes", lambda t: F.map_contains_key("found", t)), F.lit(0))
    return met.filter((F.size("probes") == 1) | (F.col("token") == first)).drop("token", "probes", "source_database")


def _seen_by_index(prepared: DataFrame, papers: DataFrame, wanted: DataFrame, tokens: DataFrame) -> DataFrame:
    """The same for more queries than a task can hold, by an index that is dealt out by token."""
    index = postings.postings(papers, wanted)
    frequency = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = _rarest(prepared, frequency).select("query_id", F.inline("probe"))
    needed = tokens.groupBy("query_id").agg(F.collect_set("token").alias("needed"))
    rare = rarest.filter("df > 0").join(prepared.select("query_id", "source"), "query_id").join(needed, "query_id")
    met = postings.probe(rare, index).filter(F.col("source").isNull() | (F.col("source") == F.col("source_database")))
    candidates = met.dropDuplicates(["query_id", "seq"]).select("query_id", "seq", F.explode("needed").alias("token"))
    entry = F.struct("token", F.struct("first", "spots"))
    looked_up = candidates.join(index.drop("source_database"), ["seq", "token"])
    looked_up = looked_up.groupBy("query_id", "seq", "year", "title_words", "both_words").agg(
        F.map_from_entries(F.collect_list(entry)).alias("found")
    )
    return looked_up.join(prepared, "query_id")


def top_hits(hits: DataFrame, limit: str | int = "hits", newest: str | None = None, largest: int | None = None) -> DataFrame:
    """Best hits per query by relevance (newest first for concept queries), then arrival order.

    A literal limit is cut before the shuffle, so a query that matches a large part of the table sends
    only its best rows; for a limit column that takes its ``largest`` value.
    """
    by_year = F.when(F.col(newest), F.coalesce("year", F.lit(0))).otherwise(0) if newest else F.lit(0)
    w = Window.partitionBy("query_id").orderBy(by_year.desc(), F.col("relevance").desc(), "seq")
    ranked = hits.withColumn("hit_rank", F.row_number().over(w))
    if isinstance(limit, int):
        return ranked.filter(F.col("hit_rank") <= limit)
    if largest is not None:
        ranked = ranked.filter(F.col("hit_rank") <= largest)
    return ranked.filter(F.col("hit_rank") <= F.col(limit))


def cut_to_quota(hits: DataFrame, quotas: dict[str, int], by: list[str] | None = None, order: list | None = None) -> DataFrame:
    """First rows of every source up to its quota. One literal bound per source keeps the cut local."""
    w = Window.partitionBy(*(["topic_id"] if by is None else by), "source").orderBy(*(order or ["q_order", "hit_rank"]))
    largest = max(quotas.values())
    ranked = hits.withColumn("source_rank", F.row_number().over(w)).filter(F.col("source_rank") <= largest)
    quota = F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in quotas.items()], F.lit(0))
    return ranked.filter(F.col("source_rank") <= quota)


def retrieve(
    expanded: DataFrame,
    papers: DataFrame,
    total: int = 1500,
    sources: list[str] | None = None,
    year_from: int | None = None,
    most: dict[str, int] | None = None,
) -> DataFrame:
    """Candidate papers of every topic: ``(topic_id, seq, matched_queries)`` over all sources.

    ``most`` sets a source's upper bound of hits per query.
    """
    sources = sources or list(SOURCE_SHARES)
    quotas = source_limits(total, sources)
    expanded = cut_lineage(expanded)  # small, and read once per provider and role
    # Without a year bound all providers search alike: one pass over the texts.
    lenient_only = year_from is None
    groups: dict[bool, DataFrame] = {}
    for name in sources:
        queries = provider_queries(expanded, name, quotas[name], (most or {}).get(name))
        keep_undated = lenient_only or name not in ("OpenAlex", "Crossref")
        groups[keep_undated] = groups[keep_undated].unionByName(queries) if keep_undated in groups else queries
    found = None
    for keep_undated, queries in groups.items():
        named = cut_lineage(queries.withColumn("query_id", F.xxhash64("topic_id", "source", "q_order", "query", "mode")))
        largest = named.agg(F.max("hits")).first()[0]  # of a small table that is already there
        hits = top_hits(search(named, papers, year_from, keep_undated), "hits", "newest", largest)
        found = hits if found is None else found.unionByName(hits)
    return with_match_trace(cut_to_quota(found, quotas))


def with_match_trace(hits: DataFrame) -> DataFrame:
    """One row per topic and paper with its query traces in query order, each once."""
    traces = F.array_sort(F.collect_list(F.struct("q_order", "trace")))
    return (
        hits.groupBy("topic_id", "seq")
        .agg(traces.alias("traces"))
        .select("topic_id", "seq", F.array_distinct(F.transform("traces", lambda t: t["trace"])).alias("matched_queries"))
    )
