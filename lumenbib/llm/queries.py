"""Registered queries of the operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.llm import alignment, langid, licenses, merkle, packing, quality, sentencepieces, simhash, token_counts
from lumenbib.llm import toxicity, variants, vectors, warc
from lumenbib.llm.common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def vocabulary(name: str) -> str:
    """Where a public tokenizer file is on this machine and its executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.token_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# A page of at least 1000 bytes refers to the largest page with the same payload; bytes are those of the UTF-8 text.
ORACLES["op10_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS head FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN head > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head > page_id THEN head END AS refers_to
FROM g
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents"))).drop("spans")


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths)


@query
def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.word_counts(table(spark, sf_dir, "documents"), planted=variants.PLANTED))
