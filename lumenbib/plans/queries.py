"""Registered queries: every operator over the whole sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.functions import text as tx
from lumenbib.functions import urls
from lumenbib.operators import (
    candidates as ca,
    dedup,
    enrich,
    evidence,
    expand,
    feedback as fb,
    health,
    incremental,
    report,
    retrieve,
    rubric,
    score,
    select,
)
from lumenbib.plans import search as plan
from lumenbib.plans import views as v
from lumenbib.session import checkpoint_dir, cut_lineage

# Study lists, words that occur in the sample tables.
TERMS = ["the and", "attion", "energy", "einber", "leaux", "ciónrr", "of the", "中国", "thnt", "over", "edthere"]
PHRASES = ["the and attion", "with the", "is the", "de la", "碳中和 路径"]
LOOSE = ["the and attion to", "energy policy of the", "einber leaux"]
TOPIC = "The attion of energy"
YEAR = v.AS_OF_YEAR
QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def papers(spark: SparkSession, sf: str) -> DataFrame:
    return v.papers_view(spark, sf)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Rule scores of all papers; the final score starts as the rule score."""
    rated = enrich.with_quartile(papers(spark, sf), v.journals_view(spark))
    return score.rule_scores(rated, TERMS, PHRASES, F.lit(TOPIC), None, YEAR).withColumn("final_score", F.col("rule_score"))


def scored_once(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Some columns of ``scored``, written once for steps that read them several times."""
    s = scored(spark, sf).withColumn("final_decision", score.decision(F.col("final_score")))
    return cut_lineage(s.select(*dict.fromkeys(["seq", "source_database", "citation_count", "rule_score", "final_score", *columns])))


def joined(name: str, sep: str = "|") -> Column:
    return F.array_join(tx.no_nulls(name), sep).alias(name)


# ---------------------------------------------------------------- keys and text


@query
def normalize_keys(spark, sf):
    return papers(spark, sf).select(
        "seq",
        tx.normalize_doi("doi").alias("doi_norm"),
        tx.normalize_title("title").alias("title_norm"),
        tx.short_title("title").alias("short_title"),
        tx.first_author("authors").alias("author"),
        tx.normalize_journal("journal").alias("journal_key"),
        tx.clean_filename("title", 60).alias("file_name"),
        tx.paper_key("doi", "title", "id").alias("paper_key"),
        tx.detect_language("title").alias("language"),
        tx.join_non_empty(F.col("journal"), F.col("pdf_url")).alias("place"),
    )


@query
def topic_tokens(spark, sf):
    p = papers(spark, sf)
    return p.select(
        "seq",
        F.array_join(tx.tokenize_topic("title"), "|").alias("tokens"),
        F.size(tx.tokenize_topic("abstract")).cast("long").alias("abstract_tokens"),
        F.size(F.array_distinct(tx.words("abstract"))).cast("long").alias("vocabulary"),
        F.md5(F.array_join(tx.ordered_distinct(tx.words("abstract")), " ")).alias("words_md5"),
    )


@query
def sentences(spark, sf):
    parts = papers(spark, sf).select("seq", F.posexplode(tx.split_sentences("abstract")).alias("pos", "sentence"))
    return parts.select("seq", F.col("pos").cast("long").alias("pos"), "sentence")


@query
def page_text(spark, sf):
    return v.pages_view(spark, sf).select("page_id", tx.strip_html("html").alias("text"))


@query
def query_sanitize(spark, sf):
    return papers(spark, sf).select("seq", retrieve.sanitize_query("abstract").alias("clean"))


def derived_urls(spark, sf):
    n = F.col("doc_id")
    word = F.md5("text")
    forms = [
        F.concat(F.lit("https://Repo.example.org/"), word, F.lit(".pdf")),
        F.concat(F.lit("http://a.example.org/article/"), n.cast("string"), F.lit("?format=pdf&x="), word),
        F.concat(F.lit("https://hal.science/hal-"), n.cast("string"), F.lit("/document")),
        F.concat(F.lit("https://doaj.org/subjects/"), word, F.lit(".pdf")),
        F.concat(F.lit("ftp://files.example.org/"), word, F.lit(".pdf")),
        F.concat(F.lit("https://user@blocked.example.org:8080/download/"), word),
        F.concat(F.lit("https://example.org/"), word, F.lit("?download=1&n=pdf")),
        F.concat(F.lit("https://core.ac.uk/data-providers/"), n.cast("string"), F.lit("/pdf")),
        F.concat(F.lit("https://example.org/a.pdf;jsession="), n.cast("string")),
    ]
    url = F.get(F.array(*forms), (n % len(forms)).cast("int"))
    return v.table(spark, sf, "documents").select(n.alias("seq"), url.alias("url"))


@query
def url_checks(spark, sf):
    u = derived_urls(spark, sf)
    return u.select(
        "seq",
        "url",
        urls.is_http_url("url").alias("is_http"),
        urls.is_plausible_pdf_url("url").alias("plausible"),
        urls.is_repository_pdf_url("url").alias("repository"),
        F.coalesce(urls.url_policy("url", ["blocked."]), F.lit("")).alias("blocked_reason"),
    )


@query
def url_join(spark, sf):
    n = F.col("doc_id")
    word = F.md5("text")
    forms = [
        F.concat(F.lit("/files/"), word),
        F.concat(F.lit("//cdn.example.org/"), word),
        word,
        F.concat(F.lit("https://else.example.org/"), word),
        F.concat(F.lit("?q="), word),
        F.concat(F.lit("../up/"), word),
    ]
    base = F.concat(F.lit("https://pub.example.org/a/b/"), n.cast("string"), F.lit("?x=1"))
    link = F.get(F.array(*forms), (n % len(forms)).cast("int"))
    return v.table(spark, sf, "documents").select(n.alias("seq"), urls.join_url(base, link).alias("resolved"))


@query
def arxiv_ids(spark, sf):
    n = F.col("doc_id")
    number = F.concat(F.lit("2301."), F.lpad(n.cast("string"), 5, "0"))
    old = F.concat(F.lit("hep-th/"), F.lpad(n.cast("string"), 7, "0"))
    forms = [
        F.concat(F.lit("https://arxiv.org/abs/"), number, F.lit("v2")),
        F.concat(F.lit("arXiv: "), old),
        F.concat(F.lit("see "), number, F.lit(" and more")),
        F.lit("no id here"),
        F.concat(F.lit("https://arxiv.org/pdf/"), old, F.lit("v1?x=1")),
    ]
    given = F.get(F.array(*forms), (n % len(forms)).cast("int"))
    noted = F.concat("text", F.lit("\n"), given)
    return v.table(spark, sf, "documents").select(n.alias("seq"), tx.arxiv_id(noted).alias("arxiv_id"))


# ---------------------------------------------------------------- merge


@query
def doi_dedup_merge(spark, sf):
    merged = dedup.dedup_by_doi(papers(spark, sf))
    return merged.select(
        "seq",
        "id",
        "title",
        F.md5("abstract").alias("abstract_md5"),
        "year",
        "doi",
        "journal",
        "citation_count",
        "source_database",
        "source_count",
        "open_access_status",
        "pdf_url",
        "landing_page_url",
        "paper_type",
        "primary_topic",
        *[joined(f) for f in ("keywords", "authors", "matched_queries", "concepts", "topics", "merged_sources")],
    )


@query
def doi_merge_lists(spark, sf):
    keyed = papers(spark, sf).withColumn("gid", tx.normalize_doi("doi")).filter("gid is not null")
    values = dedup.merged_list_values(keyed)
    return values.select("gid", "field", "seq", F.col("pos").cast("long").alias("pos"), "value")


@query
def doi_dedup_counts(spark, sf):
    p = papers(spark, sf)
    return dedup.dedup_counts(p, dedup.dedup_by_doi(p))


@query
def title_dedup_exact(spark, sf):
    named = papers(spark, sf).withColumn("title_norm", tx.normalize_title("title"))
    return named.groupBy("title_norm").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("records"), F.max("citation_count").alias("citation_count")
    )


@query
def title_dedup_fuzzy(spark, sf):
    return dedup.title_clusters(papers(spark, sf))


@query
def merge_sources(spark, sf):
    merged = dedup.merge_papers(papers(spark, sf))
    return merged.select("seq", "id", "title", "doi", "source_database", "source_count", joined("keywords"))


@query
def arrival_order(spark, sf):
    from lumenbib.schema import assign_seq, union_sources

    p = papers(spark, sf).withColumn("position", F.col("seq"))
    parts = [assign_seq(p.filter(F.col("source_database") == s)) for s in ("arXiv", "Crossref", "OpenAlex", "Semantic Scholar")]
    return union_sources(*parts).select("seq", "id", "source_database")


@query
def candidate_cut(spark, sf):
    return dedup.cut_candidates(dedup.dedup_by_doi(papers(spark, sf)), 300).select("seq", "id")


# ---------------------------------------------------------------- enrichment


@query
def journal_quartile(spark, sf):
    rated = enrich.with_quartile(papers(spark, sf), v.journals_view(spark))
    return rated.select("seq", "journal", "quartile", score.journal_score(plan.scoring_config()).alias("journal_score"))


def overlaid(spark, sf):
    return enrich.overlay_unpaywall(papers(spark, sf), v.unpaywall_view(spark, sf))


@query
def oa_overlay(spark, sf):
    return overlaid(spark, sf).select(
        "seq", "open_access_status", "pdf_url", "landing_page_url", score.access_score(plan.scoring_config()).alias("access_score")
    )


@query
def oa_stats(spark, sf):
    return enrich.unpaywall_stats(overlaid(spark, sf))


# ---------------------------------------------------------------- scores


@query
def term_match(spark, sf):
    m = score.with_matches(papers(spark, sf), TERMS, PHRASES)
    return m.select("seq", *[tx.round2(F.col(f"_{c}")).alias(c) for c in ("title", "abstract", "keyword", "phrase", "coverage")])


@query
def term_match_lists(spark, sf):
    """The same scores with the term lists as columns, the form for many topics."""
    terms, phrases = (F.array(*[F.lit(x) for x in xs]) for xs in (TERMS, PHRASES))
    listed = papers(spark, sf).withColumns({"t": terms, "p": phrases})
    m = score.with_matches(listed, F.col("t"), F.col("p"))
    return m.select("seq", *[tx.round2(F.col(f"_{c}")).alias(c) for c in ("title", "abstract", "keyword", "phrase", "coverage")])


SCORES = ["relevance", "year", "citation", "journal", "access", "type"]


@query
def rule_score(spark, sf):
    return scored(spark, sf).select("seq", *[f"{c}_score" for c in SCORES], "rule_score", joined("labels"))


@query
def rule_score_fuzzy(spark, sf):
    rated = enrich.with_quartile(papers(spark, sf), v.journals_view(spark))
    loose = F.array(*[F.lit(q) for q in LOOSE])
    full = score.rule_scores(rated, TERMS, PHRASES, F.lit(TOPIC), loose, YEAR)
    return full.select("seq", "fuzzy_match_score", "relevance_score", "rule_score")


@query
def rule_stats(spark, sf):
    return score.rule_stats(scored(spark, sf), 55.0)


@query
def rule_passed(spark, sf):
    return score.passed_rules(scored(spark, sf), 55.0).select("seq", "rule_score")


@query
def year_filters(spark, sf):
    from lumenbib.sources.records import from_year

    p = papers(spark, sf).withColumn("year", F.when(F.col("seq") % 13 != 0, F.col("year")))
    lenient = from_year(p, 2015, True).agg(F.count(F.lit(1)).alias("papers"), F.sum("seq").alias("seq_sum"))
    strict = from_year(p, 2015, False).agg(F.count(F.lit(1)).alias("papers"), F.sum("seq").alias("seq_sum"))
    return lenient.withColumn("rule", F.lit("undated pass")).unionByName(strict.withColumn("rule", F.lit("undated fail")))


def similarity(spark, sf):
    e = v.table(spark, sf, "embeddings")
    topic = e.filter("vec_id = 0").agg(F.min("embedding")).scalar()
    both = e.withColumn("topic_vector", topic)
    return both.select("vec_id", score.similarity_score(F.col("topic_vector"), F.col("embedding")).alias("embedding_score"))


@query
def embedding_topk(spark, sf):
    top = similarity(spark, sf).orderBy(F.col("embedding_score").desc(), "vec_id").limit(20)
    return top


@query
def embedding_scores(spark, sf):
    s = similarity(spark, sf)
    n = F.col("vec_id")
    title = F.when(n % 2 == 0, F.col("embedding_score"))
    return s.select("vec_id", tx.round2(score.combined_similarity(title, F.col("embedding_score"), F.lit(40.0))).alias("combined"))


@query
def embedding_stats(spark, sf):
    ids = papers(spark, sf).select("seq").join(similarity(spark, sf), F.col("seq") == F.col("vec_id"), "left")
    return score.similarity_stats(ids)


# ---------------------------------------------------------------- evidence


def items(spark, sf):
    return evidence.with_evidence(papers(spark, sf), TERMS)


@query
def evidence_items(spark, sf):
    packed = F.transform("evidence_items", lambda e: F.concat_ws("|", e["source"], e["text"], e["relevance"]))
    return items(spark, sf).select("seq", F.array_join(packed, "||").alias("evidence"))


@query
def evidence_stats(spark, sf):
    return evidence.evidence_stats(items(spark, sf))


# ---------------------------------------------------------------- expansion and retrieval


@query
def query_expand(spark, sf):
    e = expand.expand_topics(v.topics_view(spark, sf))
    columns = ["english_keywords", "chinese_keywords", "related_terms", "loose_queries", "phrase_queries", "boolean_queries"]
    return e.select("topic_id", "detected_language", "english_topic", *[joined(c) for c in columns])


@query
def expansion_counts(spark, sf):
    return expand.expansion_counts(expand.expand_topics(v.topics_view(spark, sf)))


@query
def query_pools(spark, sf):
    e = expand.expand_topics(v.topics_view(spark, sf))
    out = None
    for name in ("OpenAlex", "Semantic Scholar", "Crossref", "arXiv", "CNKI"):
        rows = e.select("topic_id", F.lit(name).alias("provider"), F.posexplode(expand.query_pool(name)).alias("pos", "query"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("pos", F.col("pos").cast("long"))


@query
def scoring_term_lists(spark, sf):
    lists = expand.scoring_lists(expand.expand_topics(v.topics_view(spark, sf)))
    return lists.select("topic_id", *[joined(c) for c in ("terms", "evidence_terms", "phrases", "loose")])


@query
def expansion_merge(spark, sf):
    t = v.topics_view(spark, sf)
    answer = F.concat(
        F.lit('```json\n{"english_topic": "Topic '), F.col("topic_id").cast("string"),
        F.lit('", "english_keywords": ["extra one", " THE ", "extra one"], "synonyms": ["other '), F.col("topic_id").cast("string"), F.lit('"]}\n```'),
    )
    answers = t.filter("topic_id % 2 = 0").select("topic_id", answer.alias("answer"))
    e = expand.merge_model_expansion(expand.expand_rules(t), answers)
    return e.select("topic_id", "english_topic", joined("english_keywords"), joined("synonyms"))


def topic_queries(spark, sf):
    t = v.topics_view(spark, sf)
    mode = F.get(F.array(*[F.lit(m) for m in retrieve.MODES]), (F.col("topic_id") % 3).cast("int"))
    words = F.slice(F.split("topic", " "), 1, 2)
    return t.select(
        F.col("topic_id").alias("query_id"), F.array_join(words, " ").alias("query"), mode.alias("mode"), F.lit(None).cast("string").alias("source")
    )


@query
def retrieve_topk(spark, sf):
    return best_hits(topic_queries(spark, sf), papers(spark, sf))


def best_hits(queries, table):
    hits = retrieve.top_hits(retrieve.search(queries, table), 20)
    return hits.select("query_id", "seq", F.round("relevance", 4).alias("relevance"), F.col("hit_rank").cast("long").alias("hit_rank"))


@query
def retrieve_cjk(spark, sf):
    """The first two words of each topic, in Chinese dress one term, wherever it stands inside a sentence."""
    asked = topic_queries(spark, sf)
    return best_hits(asked.withColumn("query", v.chinese(F.col("query"))), v.chinese_papers_view(spark, sf))


@query
def retrieve_phrase(spark, sf):
    """The first two words of each topic as a phrase, and its third word."""
    asked = topic_queries(spark, sf).drop("query")
    words = F.split("topic", " ")
    quoted = F.concat(F.lit('"'), F.array_join(F.slice(words, 1, 2), " "), F.lit('" '), F.get(words, F.lit(2)))
    topics = v.topics_view(spark, sf).select(F.col("topic_id").alias("query_id"), quoted.alias("query"))
    return best_hits(asked.join(topics, "query_id"), papers(spark, sf))


@query
def source_quota(spark, sf):
    p = papers(spark, sf).select("seq", F.col("source_database").alias("source"))
    quotas = retrieve.source_limits(200, ["OpenAlex", "Semantic Scholar", "Crossref", "arXiv"])
    kept = retrieve.cut_to_quota(p, quotas, by=[], order=["seq"])
    return kept.select("source", "seq", F.col("source_rank").cast("long").alias("source_rank"))


@query
def match_trace(spark, sf):
    e = expand.expand_topics(v.topics_view(spark, sf))
    found = retrieve.retrieve(e, papers(spark, sf))
    return found.select("topic_id", "seq", joined("matched_queries"))


@query
def topic_search(spark, sf):
    """All stages for every topic at once."""
    tables = plan.search_topics(
        v.topics_view(spark, sf), papers(spark, sf), v.journals_view(spark), YEAR,
        snapshot=v.unpaywall_view(spark, sf), feedback=v.feedback_view(spark, sf), load_model=stub_model,
    )
    return tables["selected"].select("topic_id", "seq", "rule_score", "final_score", "final_decision", joined("labels"))


# ---------------------------------------------------------------- selection


@query
def select_threshold(spark, sf):
    return select.select_papers(scored(spark, sf), "threshold", 55.0, 0).select("seq", "final_score")


@query
def select_topk(spark, sf):
    return select.select_papers(scored(spark, sf), "topk", 55.0, 500).select("seq", "final_score")


@query
def select_hybrid(spark, sf):
    return select.select_papers(scored(spark, sf), "hybrid", 80.0, 500).select("seq", "final_score")


@query
def select_hybrid_groups(spark, sf):
    return select.select_papers(scored(spark, sf), "hybrid", 62.0, 25, by=["source_database"]).select(
        "source_database", "seq", "final_score"
    )


@query
def selection_stats(spark, sf):
    s = scored_once(spark, sf)
    return select.selection_stats(s, select.select_papers(s, "hybrid", 80.0), 80.0, 10)


@query
def rubric_candidates(spark, sf):
    return select.rubric_candidates(scored_once(spark, sf), "hybrid", 62.0, by=["source_database"]).select("source_database", "seq", "rule_score")


@query
def cards_auto(spark, sf):
    s = scored_once(spark, sf)
    chosen = select.select_papers(s, "threshold", 64.0, 12)
    cards = select.card_papers(s, chosen, "auto", 30)
    return cards.select("seq", F.col("card_group").cast("long").alias("card_group"), F.col("card_rank").cast("long").alias("card_rank"))


@query
def cards_groups(spark, sf):
    s = scored_once(spark, sf)
    chosen = select.select_papers(s, "threshold", 66.0, 12, by=["source_database"])
    cards = select.card_papers(s, chosen, "auto", 15, 30.0, by=["source_database"])
    return cards.select("source_database", "seq", F.col("card_rank").cast("long").alias("card_rank"))


@query
def top_papers(spark, sf):
    return select.top_papers(scored(spark, sf)).select(F.col("rank").cast("long").alias("rank"), "seq", "final_score")


# ---------------------------------------------------------------- rubric


def answers(spark, sf):
    """Conversation turns as model answers: fenced, in prose, as numbers in text, or without JSON."""
    c, t = F.col("conv_id"), F.col("turn")
    n = c * 7 + t * 13
    body = F.concat(
        F.lit('{"topic_relevance": '), (n % 130).cast("string"), F.lit(', "confidence": "'), (n * 3 % 101).cast("string"),
        F.lit('", "final_llm_score": '), (n * 5 % 101).cast("string"), F.lit('.5, "novelty": "n/a", "decision": " '),
        F.get(F.array(*[F.lit(d) for d in ("core", "important", "background", "method", "data")]), (n % 5).cast("int")),
        F.lit(' ", "labels": ["a", " ", "b '), F.col("role"), F.lit('"], "evidence": ["quote '), n.cast("string"), F.lit('"], "reason": ""}'),
    )
    text = (
        F.when(n % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n % 4 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Thanks, "), F.replace(F.replace("text", F.lit("{"), F.lit("")), F.lit("}"), F.lit(""))))
        .when(n % 4 == 2, body)
        .otherwise(F.replace(F.replace("text", F.lit("{"), F.lit("")), F.lit("}"), F.lit("")))
    )
    return v.table(spark, sf, "conversations").select("conv_id", "turn", text.alias("answer"))


def rubrics(spark, sf):
    return answers(spark, sf).withColumn("rubric", rubric.parse_rubric("answer"))


@query
def rubric_parse(spark, sf):
    r = F.col("rubric")
    return rubrics(spark, sf).select(
        "conv_id",
        "turn",
        r.isNotNull().alias("parsed"),
        *[r[c].alias(c) for c in ("topic_relevance", "confidence", "final_llm_score", "novelty", "decision", "reason")],
        F.array_join(r["labels"], "|").alias("labels"),
        F.array_join(r["evidence"], "|").alias("evidence"),
    )


@query
def rubric_stats(spark, sf):
    outcome = F.when(F.col("rubric").isNull(), "failed").when(F.col("turn") > 3, "skipped").otherwise("scored")
    return rubric.rubric_stats(rubrics(spark, sf).withColumn("outcome", outcome))


@query
def rubric_apply(spark, sf):
    s = items(spark, sf).withColumns({"labels": F.array(F.lit("a"), F.lit("x")), "rule_score": F.lit(50.0)})
    answered = rubrics(spark, sf).groupBy(F.col("conv_id").alias("seq")).agg(F.min_by("rubric", "turn").alias("rubric"))
    out = rubric.apply_rubric(s.join(answered, "seq", "left"))
    return out.select("seq", "llm_score", "llm_decision", joined("labels"), F.size("evidence_items").cast("long").alias("evidence"))


@query
def relevance_blend(spark, sf):
    n = F.col("seq")
    answer = F.when(
        n % 3 != 0,
        F.concat(F.lit('{"llm_score": "'), (n % 120).cast("string"), F.lit('", "reason": "r", "labels": ["recent","m"], "paper_type": "review"}')),
    ).otherwise(F.lit("no answer"))
    s = scored(spark, sf).withColumn("relevance", rubric.parse_relevance(answer))
    return rubric.apply_relevance(s).select("seq", "final_score", "llm_score", "paper_type", joined("labels"))


@query
def rubric_prompts(spark, sf):
    p = papers(spark, sf)
    prompt = rubric.rubric_prompt(F.lit(TOPIC), F.array(*[F.lit(t) for t in TERMS]))
    return p.select("seq", F.md5(prompt).alias("prompt_md5"), F.md5(rubric.relevance_prompt(F.lit(TOPIC))).alias("simple_md5"))


def stub_model():
    """Deterministic stand-in for an outside model: a score from the prompt length, broken at times."""

    def answer(prompts):
        return [
            None if len(p) % 11 == 0 else f'{{"final_llm_score": {len(p) % 101}, "confidence": {len(p) % 97}, "decision": "core"}}'
            for p in prompts
        ]

    return answer


@query
def rubric_infer(spark, sf):
    order = [F.col("rule_score").desc(), F.col("seq").asc()]
    marked = rubric.split_budget(scored(spark, sf), 100, order)
    prompt = rubric.rubric_prompt(F.lit(TOPIC), F.array(*[F.lit(t) for t in TERMS]))
    asked = marked.filter("outcome_hint = 'ask'").select("seq", prompt.alias("prompt"))
    done = rubric.ask_model(asked, stub_model, 8)
    skipped = marked.filter("outcome_hint = 'skipped'").select("seq", F.lit(None).cast("double").alias("score"), F.lit("skipped").alias("outcome"))
    return done.select("seq", rubric.parse_rubric("response")["final_llm_score"].alias("score"), "outcome").unionByName(skipped)


# ---------------------------------------------------------------- feedback and final score


@query
def feedback_doi(spark, sf):
    return fb.match_by_doi(papers(spark, sf), v.feedback_view(spark, sf))


@query
def feedback_title(spark, sf):
    return fb.match_by_title(papers(spark, sf), v.feedback_view(spark, sf))


@query
def feedback_scores(spark, sf):
    f = v.feedback_view(spark, sf)
    return f.select("pos", fb.feedback_label().alias("label"), fb.feedback_score().alias("score"))


@query
def feedback_apply(spark, sf):
    out = fb.apply_feedback(papers(spark, sf), v.feedback_view(spark, sf))
    return out.select("seq", "human_label", "human_feedback_score", "feedback_applied")


@query
def final_score(spark, sf):
    n = F.col("seq")
    llm = F.when(n % 4 == 0, ((n * 13) % 101).cast("double"))
    parts = scored(spark, sf).withColumns(
        {
            "llm_final_score": llm,
            "llm_confidence": F.when((n % 4 == 0) & (n % 8 != 0), ((n * 7) % 100).cast("double")),
            "llm_decision": F.when(n % 4 == 0, F.get(F.array(F.lit("core"), F.lit("method"), F.lit("")), (n % 3).cast("int"))),
        }
    )
    parts = parts.join(similarity(spark, sf).withColumnRenamed("vec_id", "seq"), "seq", "left")
    human = fb.match_by_doi(papers(spark, sf), v.feedback_view(spark, sf))
    out = score.final_scores(parts.join(human, "seq", "left"))
    return out.select("seq", "rule_score", "final_score", "final_decision", "final_confidence")


# ---------------------------------------------------------------- links


@query
def page_pdf_links(spark, sf):
    found = ca.page_links(v.pages_view(spark, sf))
    return found.select("page_id", F.array_join("pdf_links", "|").alias("links"))


@query
def scraped_page_links(spark, sf):
    return ca.scraped_links(v.pages_view(spark, sf), "page_id").select("page_id", "url", "source")


@query
def restricted_pages(spark, sf):
    n = F.col("page_id")
    html = F.when(n % 4 == 0, F.concat("html", F.lit("<p>请登录</p>"))).otherwise(F.col("html"))
    return v.pages_view(spark, sf).select(
        "page_id",
        ca.is_restricted_page(html).alias("restricted"),
        ca.looks_like_html(F.lit(""), F.encode("html", "UTF-8")).alias("is_html"),
        ca.looks_like_pdf(F.when(n % 3 == 0, "application/pdf"), F.encode("html", "UTF-8")).alias("is_pdf"),
    )


def link_table(spark, sf):
    own = ca.collect_links(overlaid(spark, sf))
    extra = v.pages_view(spark, sf).select(F.col("page_id").alias("seq"), "html", "url")
    scraped = ca.scraped_links(extra, "seq")
    return ca.first_links(ca.union_links(own, scraped))


@query
def link_candidates(spark, sf):
    return link_table(spark, sf).select("seq", "pos", "url", "source", "from_landing")


@query
def candidate_rank(spark, sf):
    log = v.attempts_view(spark, sf).withColumn(
        "source", F.get(F.array(*[F.lit(s) for s in ("unpaywall.best", "arxiv", "crossref.page_scrape[0]")]), (F.col("seq") % 3).cast("int"))
    )
    ranked = ca.rank_links(link_table(spark, sf), health.source_health(log))
    return ranked.select(
        "seq", "url", "source", "bucket", F.round("priority", 6).alias("priority"), F.round("expected_ms", 3).alias("expected_ms"),
        F.col("link_rank").cast("long").alias("link_rank"),
    )


def checked(spark, sf):
    return ca.precheck(scored(spark, sf), link_table(spark, sf), 50.0, ["oa.example.org/1"])


@query
def download_precheck(spark, sf):
    return checked(spark, sf).select("seq", "links", "allowed_links", "status")


@query
def precheck_stats(spark, sf):
    return ca.precheck_stats(checked(spark, sf))


@query
def download_plan(spark, sf):
    strict = cut_lineage(ca.precheck(scored_once(spark, sf), link_table(spark, sf), 66.0))  # read three times
    return ca.download_plan(strict, 5, ["source_database"]).select("source_database", "seq", "status", "fallback")


@query
def discovery_stats(spark, sf):
    return ca.discovery_stats(papers(spark, sf), link_table(spark, sf))


def attempt_rows(spark, sf):
    status = F.get(
        F.array(*[F.lit(s) for s in ("downloaded", "request_failed", "http_error", "non_pdf", "resolved_from_landing", "blocked", "attempt")]),
        (F.col("seq") % 7).cast("int"),
    )
    return v.attempts_view(spark, sf).withColumn("status", status)


@query
def attempt_stats(spark, sf):
    return ca.attempt_stats(attempt_rows(spark, sf))


@query
def attempt_stats_by_paper(spark, sf):
    return ca.attempt_stats(attempt_rows(spark, sf), ["paper_id"])


@query
def failure_reasons(spark, sf):
    return ca.failure_reasons(attempt_rows(spark, sf))


@query
def source_health_ema(spark, sf):
    h = health.source_health(v.attempts_view(spark, sf))
    return h.select("bucket", F.round("success_ema", 6).alias("success_ema"), F.round("latency_ema", 3).alias("latency_ema"), "attempts", "last_error", F.date_format("last_update", "yyyy-MM-dd HH:mm:ss").alias("last_update"))


@query
def source_health_stream(spark, sf):
    """The same averages through a stream: slices land in a table, a closing row pushes the watermark."""
    import uuid

    from lumenbib.streaming.jobs import stream_health_slices

    home = f"{checkpoint_dir(spark)}/health-{uuid.uuid4().hex}"
    log = v.attempts_view(spark, sf)
    close = log.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(
        F.lit(-1).cast("long").alias("seq"), "ts", F.lit("closing").alias("source"), F.lit(None).cast("long").alias("paper_id"),
        F.lit(True).alias("success"), F.lit(0.0).alias("latency_ms"), F.lit("").alias("reason"),
    )
    log.unionByName(close).write.parquet(f"{home}/log")
    rows = spark.readStream.schema(log.schema).parquet(f"{home}/log")
    stream_health_slices(rows, f"{home}/slices", f"{home}/state").awaitTermination()
    slices = spark.read.parquet(f"{home}/slices").filter("bucket <> 'closing'")
    h = health.health_from_slices(slices)
    return h.select("bucket", F.round("success_ema", 6).alias("success_ema"), F.round("latency_ema", 3).alias("latency_ema"), "attempts", "last_error", F.date_format("last_update", "yyyy-MM-dd HH:mm:ss").alias("last_update"))


@query
def failure_runs(spark, sf):
    return health.failure_stops(v.attempts_view(spark, sf))


@query
def search_meta(spark, sf):
    n = F.col("event_id")
    log = v.table(spark, sf, "events").select(
        F.col("event_type").alias("source"), n.alias("query"), F.when(F.col("event_type") == "error", 0).otherwise(n % 17).cast("long").alias("returned"),
        (n % 5 == 0).alias("failed"), (n % 100).cast("double").alias("elapsed_seconds"), (F.col("event_type") != "signup").alias("enabled"),
    )
    return report.search_meta(log)


@query
def search_summary(spark, sf):
    return report.search_summary(search_meta(spark, sf))


@query
def title_doi(spark, sf):
    p = papers(spark, sf)
    return ca.resolve_titles(p, p.filter(tx.normalize_doi("doi").isNotNull()))


# ---------------------------------------------------------------- reports


@query
def papers_by_year(spark, sf):
    return report.papers_by_year(papers(spark, sf))


@query
def papers_by_journal(spark, sf):
    return report.papers_by_journal(papers(spark, sf))


@query
def score_bins(spark, sf):
    return report.score_bins(scored(spark, sf), "rule_score", "citation_score", "year_score")


@query
def score_averages(spark, sf):
    return report.score_averages(scored(spark, sf))


@query
def link_counts(spark, sf):
    return report.link_counts(papers(spark, sf))


def with_rubric(spark, sf):
    answered = rubrics(spark, sf).groupBy("conv_id").agg(F.min_by("rubric", "turn").alias("rubric"))
    s = scored(spark, sf).withColumn("final_decision", score.decision(F.col("final_score")))
    return s.join(answered, F.col("seq") % 97 == F.col("conv_id"), "left").drop("conv_id")


@query
def low_confidence(spark, sf):
    return report.low_confidence(with_rubric(spark, sf)).select(F.col("rank").cast("long").alias("rank"), "seq")


@query
def report_lists(spark, sf):
    lists = report.report_lists(with_rubric(spark, sf))
    return lists.select("list", F.col("list_rank").cast("long").alias("list_rank"), "seq")


@query
def bibtex(spark, sf):
    return papers(spark, sf).select("seq", report.bibtex_entry().alias("entry"))


@query
def file_names(spark, sf):
    return papers(spark, sf).select("seq", report.pdf_name().alias("pdf_name"), report.card_name((F.col("seq") + 1).cast("int")).alias("card_name"))


@query
def card_index(spark, sf):
    s = scored_once(spark, sf, "final_decision", "year", "title", "journal", "doi", "authors")
    cards = select.card_papers(s, select.select_papers(s, "hybrid", 80.0), "auto", 30)
    index = report.card_index(cards)
    return index.withColumn("rank", F.col("rank").cast("long"))


def full_papers(spark, sf):
    s = evidence.with_evidence(scored(spark, sf), TERMS).withColumn("rubric", F.lit(None).cast(_rubric_type(spark, sf)))
    return score.final_scores(plan.typed_nulls(s))


def _rubric_type(spark, sf):
    return rubrics(spark, sf).schema["rubric"].dataType


@query
def flat_table(spark, sf):
    return report.flat_table(full_papers(spark, sf))


@query
def cards_md(spark, sf):
    s = full_papers(spark, sf)
    return s.select("seq", F.md5(report.card_body(s)).alias("card_md5"), F.length(report.card_body(s)).cast("long").alias("card_chars"))


@query
def diagnostics_json(spark, sf):
    s = scored(spark, sf)
    p = papers(spark, sf)
    return report.diagnostics(
        scoring=score.rule_stats(s, 55.0), unpaywall=enrich.unpaywall_stats(overlaid(spark, sf)), deduplication=dedup.dedup_counts(p, dedup.dedup_by_doi(p))
    )


# ---------------------------------------------------------------- reuse


@query
def incremental_todo(spark, sf):
    keyed = papers(spark, sf).withColumn("key", incremental.work_key("evidence_v1", F.lit(TOPIC)))
    done = keyed.filter("seq % 3 = 0").select("key")
    return incremental.todo(keyed, done).select("seq", "key")


@query
def incremental_reuse(spark, sf):
    keyed = papers(spark, sf).withColumn("key", incremental.work_key("evidence_v1", F.lit(TOPIC)))
    done = keyed.filter("seq % 4 = 0").select("key", F.col("seq").alias("result"))
    return incremental.reuse(keyed.filter("seq % 6 < 3"), done).select("key", "result")
