"""Small reference tables and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.operators.candidates import is_stored_pdf
from lumenbib.sources.records import in_landed_order


def _numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV file with header as rows with their line order; names and values trimmed, BOM removed."""
    raw = spark.read.csv(
        path, header=True, encoding="UTF-8", multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    clean = raw.toDF(*[c.strip().lstrip("﻿") for c in raw.columns])
    columns = [
        (F.trim(F.coalesce(F.col(c), F.lit(""))) if c in clean.columns else F.lit("")).alias(c) for c in schema.split(",")
    ]
    return in_landed_order(clean).select(F.col("position").alias("pos"), *columns)


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    return _numbered_lines(spark, path, "journal_name,quartile")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return _numbered_lines(spark, path, "doi,title,human_label,feedback_score")


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Landed PDF files with a validity flag; the bytes stay in the scan stage."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", F.col("length").alias("size"), is_stored_pdf(F.col("content")).alias("is_pdf"))
