"""The corpus pipeline: language, toxicity, near duplicates, packing, each over all that the stage before it kept.

Every stage but the last filters the documents and leaves their columns as they are; the last returns the packed
pieces. Between stages the documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.llm import langid, packing, simhash, toxicity
from lumenbib.llm.common import free_name, table
from lumenbib.llm.queries import vocabulary
from lumenbib.session import checkpoint_dir

TOXIC_FROM = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that no learned language fits."""
    into = free_name(docs, "language")
    model = langid.train(docs, fits=True)
    if not model.known:  # nothing learned: no language fits
        return docs.filter(F.lit(False))
    return langid.identified(docs, model, into=into).filter(F.col(f"{into}.fits")).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose probability of toxicity reaches the threshold."""
    into = free_name(docs, "toxic_score")
    seen = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), into=into)
    return seen.filter(F.col(into) < TOXIC_FROM).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", not_toxic), ("near_duplicates", distinct), ("packing", packed)]

# Classifiers, fingerprints and a tokenizer: no stage is SQL. Tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
