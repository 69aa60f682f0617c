"""Topic expansion: every topic becomes keyword lists and query pools, all topics in one projection."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.functions.text import (
    CJK,
    col,
    detect_language,
    let,
    missing_if_blank,
    no_nulls,
    non_blank,
    ordered_distinct,
    squeeze,
    strip,
    tokenize_topic,
)

# Dictionaries of the rule-based translation and of the expansion.
ZH_TO_EN = {
    "碳中和": "carbon neutrality",
    "净零": "net zero",
    "电力投资": "electricity investment",
    "电力部门": "power sector",
    "电力行业": "power industry",
    "碳价格": "carbon price",
    "碳定价": "carbon pricing",
    "综合评估模型": "integrated assessment model",
    "能源系统模型": "energy system model",
    "中国": "China",
    "情景分析": "scenario analysis",
    "减排路径": "decarbonization pathway",
}
EN_TO_ZH = {
    "carbon neutrality": "碳中和",
    "net zero": "净零",
    "electricity investment": "电力投资",
    "power sector": "电力部门",
    "power industry": "电力行业",
    "carbon price": "碳价格",
    "carbon pricing": "碳定价",
    "integrated assessment model": "综合评估模型",
    "energy system model": "能源系统模型",
    "china": "中国",
    "scenario analysis": "情景分析",
    "decarbonization pathway": "减排路径",
    "gcam": "GCAM",
    "gcam-china": "GCAM-China",
}
RELATED_TERMS = [
    "integrated assessment model",
    "energy system model",
    "scenario analysis",
    "decarbonization pathway",
    "climate policy",
    "power system planning",
]
KNOWN_PHRASES = (
    "carbon neutrality|net zero|power sector|electricity investment|carbon pricing"
    "|integrated assessment model|energy system model"
)
SHORT_KEYWORDS = ["gcam", "iam"]
CHINESE_POOL = ["碳中和 电力投资", "碳价格 电力部门 中国", "综合评估模型 中国", "能源系统模型 碳中和"]

COMBINATIONS = [c for size in (2, 3) for c in combinations(range(1, 9), size)]
LIST_COLUMNS = ["english_keywords", "chinese_keywords", "synonyms", "related_terms"]
QUERY_COLUMNS = ["phrase_queries", "loose_queries", "boolean_queries"]


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _if_present(value: Column) -> Column:
    return F.when(missing_if_blank(value).isNull(), _strings()).otherwise(F.array(value))


def _cut(values: Column | str, size: int) -> Column:
    return F.slice(col(values), 1, size)


def to_english(c: Column | str, dictionary: dict[str, str] | None = None) -> Column:
    out = col(c)
    for zh, en in sorted((dictionary or ZH_TO_EN).items(), key=lambda kv: -len(kv[0])):
        out = F.replace(out, F.lit(zh), F.lit(en))
    return squeeze(out)


def to_chinese(c: Column | str, dictionary: dict[str, str] | None = None) -> Column:
    out = col(c)
    for en, zh in sorted((dictionary or EN_TO_ZH).items(), key=lambda kv: -len(kv[0])):
        out = F.regexp_replace(out, rf"(?i)\Q{en}\E", zh)
    return squeeze(out)


def english_keywords(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    phrases = F.regexp_extract_all(text, F.lit(f"(?i)({KNOWN_PHRASES})"), F.lit(0))
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9\-\+_\.]*"), F.lit(0))
    tokens = F.filter(tokens, lambda t: (F.length(t) > 2) | F.lower(t).isin(*SHORT_KEYWORDS))
    return F.concat(phrases, tokens)


def chinese_keywords(c: Column | str) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    known = F.filter(_strings(*ZH_TO_EN), lambda t: F.contains(text, t))
    chunks = F.split(F.regexp_replace(text, r"[，。；、,;/\-\(\)（）]", " "), r"\s+")
    return F.concat(known, F.filter(chunks, lambda t: t.rlike(CJK)))


def _any(values: Column, *pieces: str) -> Column:
    def hit(v: Column) -> Column:
        found = F.lit(False)
        for piece in pieces:
            found = found | F.contains(F.lower(v), F.lit(piece))
        return found

    return F.exists(values, hit)


def _rules(*rules: tuple[Column, list[str]]) -> Column:
    return F.concat(*[F.when(test, _strings(*terms)).otherwise(_strings()) for test, terms in rules])


def _combined_queries(topic: Column, keywords: Column, shortest: int, most: int) -> Column:
    """The topic, then all pairs, then all triples of the first eight keywords, up to ``most``."""
    shapes = F.array(*[F.array(*[F.lit(i) for i in c]) for c in COMBINATIONS])

    def combine(top: Column) -> Column:
        fitting = F.filter(shapes, lambda c: F.array_max(c) <= F.size(top))
        return F.transform(fitting, lambda c: F.array_join(F.transform(c, lambda i: F.element_at(top, i)), " "))

    joined = let(_cut(keywords, 8), combine)
    long_enough = F.filter(joined, lambda q: F.length(q) >= shortest)
    return ordered_distinct(_cut(F.concat(_if_present(topic), long_enough), most))


def expand_rules(topics: DataFrame) -> DataFrame:
    """Language, both topic forms and the four keyword lists of every topic."""
    topic = F.col("topic")
    lang = detect_language(topic)
    both = topics.withColumn("detected_language", lang).withColumns(
        {
            "english_topic": F.when(F.col("detected_language").isin("en", "mixed"), topic).otherwise(to_english(topic)),
            "chinese_topic": F.when(F.col("detected_language").isin("zh", "mixed"), topic).otherwise(to_chinese(topic)),
        }
    )
    known_en = F.filter(_strings(*EN_TO_ZH), lambda t: F.contains(F.lower(topic), t))
    known_zh = F.filter(_strings(*EN_TO_ZH.values()), lambda t: F.contains(topic, t))
    keyed = both.withColumns(
        {
            "english_keywords": ordered_distinct(F.concat(english_keywords("english_topic"), known_en)),
            "chinese_keywords": ordered_distinct(F.concat(chinese_keywords("chinese_topic"), known_zh)),
        }
    )
    en, zh = F.col("english_keywords"), F.col("chinese_keywords")
    # Synonym and related-term rules.
    synonyms = _rules(
        (_any(en, "carbon neutrality"), ["net zero", "decarbonization"]),
        (_any(en, "carbon price", "carbon pricing"), ["carbon market", "emissions trading"]),
        (F.array_contains(zh, "碳中和"), ["净零", "低碳转型"]),
        (F.array_contains(zh, "碳价格") | F.array_contains(zh, "碳定价"), ["碳市场", "碳交易"]),
    )
    related = _rules(
        (F.lit(True), RELATED_TERMS),
        (_any(en, "china") | F.array_contains(zh, "中国"), ["Chinese energy transition", "中国 能源转型"]),
        (_any(en, "gcam"), ["IAM-based scenario analysis", "integrated assessment scenario"]),
    )
    return keyed.withColumns({"synonyms": ordered_distinct(synonyms), "related_terms": ordered_distinct(related)})


def merge_model_expansion(expanded: DataFrame, answers: DataFrame) -> DataFrame:
    """Overlay a model's expansion (``topic_id, answer`` JSON text): topics replaced, lists appended."""
    shape = "english_topic string, chinese_topic string, " + ", ".join(f"{c} array<string>" for c in LIST_COLUMNS)
    bare = F.replace(F.replace(strip("answer"), F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    parsed = answers.select("topic_id", F.from_json(bare, shape).alias("model"))
    joined = expanded.join(parsed, "topic_id", "left")

    def extended(name: str) -> Column:
        extra = non_blank(F.transform(F.col("model")[name], lambda v: strip(v)))
        return ordered_distinct(F.concat(F.col(name), extra))

    topics = {
        name: F.coalesce(missing_if_blank(F.col("model")[name]), F.col(name))
        for name in ("english_topic", "chinese_topic")
    }
    return joined.withColumns(topics | {name: extended(name) for name in LIST_COLUMNS}).drop("model")


def build_queries(expanded: DataFrame) -> DataFrame:
    """Phrase, loose and boolean query lists from the keyword lists."""
    topic, en_topic, zh_topic = F.col("topic"), F.col("english_topic"), F.col("chinese_topic")
    base = expanded.withColumns(
        {
            "_en": _combined_queries(en_topic, F.col("english_keywords"), 8, 12),
            "_zh": _combined_queries(zh_topic, F.col("chinese_keywords"), 2, 10),
        }
    )

    def quoted(values: str) -> Column:
        return F.transform(_cut(values, 4), lambda q: F.concat(F.lit('"'), q, F.lit('"')))

    def other_form(form: Column) -> Column:
        return F.when(form != topic, _if_present(form)).otherwise(_strings())

    phrases = F.concat(F.array(topic), other_form(en_topic), other_form(zh_topic), quoted("_en"), quoted("_zh"))
    loose = F.concat(F.array(topic), F.col("_en"), F.col("_zh"), _cut("synonyms", 5), _cut("related_terms", 8))
    loose = F.filter(loose, lambda q: F.length(strip(q)) > 1)

    en = F.filter("english_keywords", lambda k: F.length(k) > 2)
    zh = F.col("chinese_keywords")

    def group(values: Column, default: list[str]) -> Column:
        chosen = F.when(F.size(values) > 0, _cut(values, 2)).otherwise(_strings(*default))
        return F.concat(
            F.lit("("), F.array_join(F.transform(chosen, lambda k: F.concat(F.lit('"'), k, F.lit('"'))), " OR "), F.lit(")")
        )

    china = F.filter(en, lambda k: F.contains(F.lower(k), F.lit("china")))
    carbon = F.filter(en, lambda k: F.lower(k).rlike("carbon|neutrality|net zero"))
    english = F.concat_ws(" AND ", group(en, []), group(china, ["China"]), group(carbon, ["carbon neutrality", "net zero"]))
    chinese = F.concat(
        F.lit("("), F.get(zh, F.lit(0)), F.lit(" OR "), F.get(zh, F.lit(1)), F.lit(") AND ("), F.get(zh, F.lit(2)), F.lit(" OR 中国)")
    )
    boolean = F.array_compact(F.array(F.when(F.size(en) > 0, english), F.when(F.size(zh) >= 3, chinese)))
    return base.withColumns(
        {
            "phrase_queries": _cut(ordered_distinct(phrases), 16),
            "loose_queries": _cut(ordered_distinct(loose), 30),
            "boolean_queries": _cut(ordered_distinct(boolean), 8),
        }
    ).drop("_en", "_zh")


def expand_topics(topics: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Full expansion of ``(topic_id, topic)``, with an optional overlay of model answers."""
    expanded = expand_rules(topics)
    if answers is not None:
        expanded = merge_model_expansion(expanded, answers)
    return build_queries(expanded)


def scoring_lists(expanded: DataFrame) -> DataFrame:
    """Add the term, phrase and query lists that scoring and evidence use."""
    topic, en, zh = F.col("topic"), F.col("english_topic"), F.col("chinese_topic")
    keyword_lists = [F.col(c) for c in LIST_COLUMNS]
    forms = [_if_present(en), _if_present(zh)]
    return expanded.withColumns(
        {
            "terms": _cut(ordered_distinct(F.concat(*keyword_lists, *forms)), 60),
            "evidence_terms": _cut(
                ordered_distinct(F.concat(F.array(topic), tokenize_topic(topic), *keyword_lists, *forms)), 80
            ),
            "phrases": _cut(ordered_distinct(F.concat(F.array(topic), F.col("phrase_queries"), *forms)), 20),
            "loose": _cut(
                ordered_distinct(F.concat(F.array(topic), F.col("loose_queries"), F.col("boolean_queries"))), 20
            ),
        }
    )


def _steps(values: str) -> Column:
    """Overlapping keyword triples that start at every second of the first eight keywords."""

    def runs(top: Column) -> Column:
        starts = F.filter(F.array(*[F.lit(i) for i in (1, 3, 5, 7)]), lambda i: i <= F.size(top))
        return F.transform(starts, lambda i: F.array_join(F.slice(top, i, F.lit(3)), " "))

    return let(_cut(values, 8), runs)


def query_pool(provider: str, limit: int = 500) -> Column:
    """Ordered distinct query list of one provider, cut at the provider's size."""
    topic = F.array(F.col("topic"))
    en, zh = _if_present(F.col("english_topic")), _if_present(F.col("chinese_topic"))
    phrase, loose, boolean = (no_nulls(c) for c in QUERY_COLUMNS)
    # Pool sizes and the order of the parts.
    if provider == "OpenAlex":
        parts, size = [topic, en, zh, phrase, loose, boolean], 8 if limit <= 80 else 14 if limit <= 250 else 24
    elif provider == "Semantic Scholar":
        keyword_runs = [_steps("english_keywords"), _steps("chinese_keywords")]
        parts, size = [topic, en, zh, _cut(phrase, 6), _cut(loose, 8), *keyword_runs], 16
    elif provider == "Crossref":
        parts, size = [topic, en, zh, loose, phrase], 16
    elif provider == "arXiv":
        parts, size = [topic, en, _cut("english_keywords", 10), loose], 4 if limit <= 60 else 8
    elif provider == "CNKI":
        parts, size = [zh, topic, _steps("chinese_keywords"), _strings(*CHINESE_POOL)], 10
    else:
        raise ValueError(f"unknown provider: {provider}")
    return _cut(ordered_distinct(F.concat(*parts)), size)


def concept_pool(limit: int) -> Column:
    """Concept queries of the OpenAlex search, fewer for small limits."""
    size = 4 if limit <= 8 else 6 if limit <= 20 else 8
    parts = F.concat(
        _cut("related_terms", 8), _cut("synonyms", 6), _cut("english_keywords", 6), _cut("chinese_keywords", 6)
    )
    return _cut(ordered_distinct(parts), size)


def expansion_counts(expanded: DataFrame) -> DataFrame:
    return expanded.select(
        "topic_id",
        sum((F.size(c) for c in QUERY_COLUMNS[1:]), F.size(QUERY_COLUMNS[0])).cast("long").alias("query_count"),
        F.size("english_keywords").cast("long").alias("english_keywords_count"),
        F.size("chinese_keywords").cast("long").alias("chinese_keywords_count"),
    )
