"""Paper-shaped views over plain document tables, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.functions.text import strip
from lumenbib.schema import conform

# The study topic of the single-topic reports (words frequent in the sample tables).
STUDY_TOPIC = "Energy with the attion"
AS_OF_YEAR = 2026


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A text table; a file with fewer splits than cores is dealt out before the text is worked on."""
    whole = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return whole.repartition(cores) if whole._jdf.rdd().getNumPartitions() < cores else whole


def _pick(number: Column, *values: str | None) -> Column:
    """Value by ``number % len(values)``."""
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def papers_view(spark: SparkSession, folder: str) -> DataFrame:
    """Documents dressed as bibliographic records: partly missing fields, shared DOIs and titles."""
    n = F.col("doc_id")
    tokens = F.split(F.btrim(F.col("text"), F.lit(" \t\n\r")), r"[ \t\n\r]+", 17)  # fifteen are read, the rest stays one piece
    return conform(
        texts(spark, folder, "documents").select(
            n.alias("seq"),
            F.concat(F.lit("P"), n.cast("string")).alias("id"),
            F.array_join(F.slice(tokens, 1, 8), " ").alias("title"),
            F.col("text").alias("abstract"),
            F.slice(tokens, 9, 5).alias("keywords"),
            F.slice(tokens, 14, 2).alias("authors"),
            (F.lit(2000) + n % 27).cast("int").alias("year"),
            F.when(n % 3 != 0, F.concat(F.lit("https://doi.org/10.1000/"), F.upper(F.substring(F.md5("text"), 1, 8)))).alias(
                "doi"
            ),
            _pick(n, "Nature", "Applied Energy", "climate  policy", "Sustainability", "Unknown Letters", None).alias(
                "journal"
            ),
            F.when(n % 11 != 0, (n * 37) % 701).cast("int").alias("citation_count"),
            _pick(n, "OpenAlex", "Semantic Scholar", "Crossref", "arXiv").alias("source_database"),
            _pick(n, "gold", "open", "unknown", "open").alias("open_access_status"),
            F.when(n % 5 == 0, F.concat(F.lit("https://repo.example.org/"), n.cast("string"), F.lit(".pdf"))).alias(
                "pdf_url"
            ),
            F.when(n % 2 == 0, F.concat(F.lit("https://pub.example.org/"), n.cast("string"))).alias("landing_page_url"),
            _pick(n, "journal-article", "proceedings-article", "preprint", "book-chapter", "article").alias("paper_type"),
            F.array(F.concat(_pick(n, "default", "title", "title_abstract"), F.lit(":"), F.col("lang"))).alias(
                "matched_queries"
            ),
            F.array(F.col("lang")).alias("concepts"),
            F.array(F.col("source")).alias("topics"),
            F.concat(F.lit("topic "), F.col("lang")).alias("primary_topic"),
            F.array(_pick(n, "OpenAlex", "Semantic Scholar", "Crossref", "arXiv")).alias("merged_sources"),
            F.lit(1).alias("source_count"),
        )
    )


# The letters a to z as Han characters, for records in Chinese dress.
HAN_LETTERS = "碳中和能源政策研究技术经济排放市场环境气候影响评估城"


def chinese(c: Column | str) -> Column:
    """A text whose letters a to z are Han characters, without accented letters and blanks."""
    letters = "".join(map(chr, range(ord("a"), ord("z") + 1)))
    return F.translate(F.regexp_replace(F.lower(c), "[ à-ÿ]", ""), letters, HAN_LETTERS)


def chinese_papers_view(spark: SparkSession, folder: str) -> DataFrame:
    """The papers in Chinese dress: sentences are runs of characters."""
    return papers_view(spark, folder).withColumns(
        {"title": chinese("title"), "abstract": chinese("abstract"), "keywords": F.array().cast("array<string>")}
    )


def topics_view(spark: SparkSession, folder: str) -> DataFrame:
    """One research topic per benchmark item: its first four words."""
    head = F.slice(F.split(F.btrim(F.col("text"), F.lit(" \t\n\r")), r"[ \t\n\r]+"), 1, 4)
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("topic_id"), F.array_join(head, " ").alias("topic")
    )


def journals_view(spark: SparkSession) -> DataFrame:
    """The sample quartile list."""
    # Journal names and quartiles.
    rows = [
        ("Nature", "Q1"),
        ("Science", "Q1"),
        ("Energy", "Q1"),
        ("Applied Energy", "Q1"),
        ("Energy Policy", "Q1"),
        ("Journal of Cleaner Production", "Q1"),
        ("Renewable and Sustainable Energy Reviews", "Q1"),
        ("Energy Economics", "Q1"),
        ("Climate Policy", "Q2"),
        ("Sustainability", "Q3"),
    ]
    values = ", ".join(f"({i}, '{name}', '{quartile}')" for i, (name, quartile) in enumerate(rows))
    return spark.sql(f"SELECT * FROM VALUES {values} AS journals(pos, journal_name, quartile)")


def unpaywall_view(spark: SparkSession, folder: str) -> DataFrame:
    """Open-access snapshot keyed by DOI for two thirds of the documents that carry one."""
    n = F.min("doc_id")
    doi = F.concat(F.lit("10.1000/"), F.substring(F.md5("text"), 1, 8))
    known = table(spark, folder, "documents").filter("doc_id % 3 = 1").groupBy(doi.alias("doi")).agg(n.alias("n"))
    url = F.concat(F.lit("https://oa.example.org/"), F.col("n").cast("string"))
    return known.select(
        "doi",
        (F.col("n") % 2 == 0).alias("is_oa"),
        F.when(F.col("n") % 5 != 0, _pick(F.col("n"), "gold", "green", "bronze")).alias("oa_status"),
        F.struct(
            F.when(F.col("n") % 4 == 0, F.concat(url, F.lit(".pdf"))).alias("url_for_pdf"),
            F.when(F.col("n") % 3 == 0, F.concat(url, F.lit("/page"))).alias("url_for_landing_page"),
            url.alias("url"),
        ).alias("best_oa_location"),
        F.array(
            F.struct(
                F.concat(url, F.lit("/v1.pdf")).alias("url_for_pdf"),
                F.lit(None).cast("string").alias("url_for_landing_page"),
                F.concat(url, F.lit("/v1")).alias("url"),
            )
        ).alias("oa_locations"),
    )


def feedback_view(spark: SparkSession, folder: str) -> DataFrame:
    """Human labels of documents as feedback rows: keyed by DOI where the document has one, else by title."""
    papers = papers_view(spark, folder).select(F.col("seq").alias("doc_id"), "doi", "title")
    label = F.when(F.col("toxic") == 1, "unsure").when(F.col("quality") == 1, "relevant").otherwise("irrelevant")
    score = F.when(F.col("doc_id") % 7 == 0, F.lit("150")).when(F.col("doc_id") % 5 == 0, F.lit("64.5"))
    return (
        table(spark, folder, "labels")
        .join(papers, "doc_id")
        .select(
            F.col("doc_id").alias("pos"),
            F.col("doi"),
            F.col("title"),
            label.alias("human_label"),
            F.coalesce(score, F.when(F.col("doc_id") % 11 == 0, F.lit("abc")), F.lit("")).alias("feedback_score"),
        )
    )


def attempts_view(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log of link attempts: the event type is the source label."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("source"),
        F.col("user_id").alias("paper_id"),
        (F.col("value") >= 50).alias("success"),
        (F.col("value") * 100).alias("latency_ms"),
        F.when(F.col("value") < 50, F.concat(F.lit("http_"), (F.lit(400) + F.col("event_id") % 4).cast("string")))
        .otherwise("")
        .alias("reason"),
    )


def pages_view(spark: SparkSession, folder: str) -> DataFrame:
    """Landing pages; each third page gets a file link in its navigation."""
    extra = F.concat(F.lit('<a href="/files/'), F.col("page_id").cast("string"), F.lit('.pdf">x</a></nav>'))
    return texts(spark, folder, "pages").select(
        "page_id",
        strip("url").alias("url"),
        F.when(F.col("page_id") % 3 == 0, F.replace(F.col("html"), F.lit("</nav>"), extra))
        .otherwise(F.col("html"))
        .alias("html"),
    )
