"""Work that is already done is skipped by an anti-join on a content key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def work_key(version: str, topic: Column | None = None, expansion: Column | None = None) -> Column:
    """Digest of everything a result depends on: topic, record, abstract, expansion and version."""
    parts = [
        F.lit(version),
        topic if topic is not None else F.lit(""),
        F.col("id"),
        F.coalesce("title", F.lit("")),
        F.md5(F.coalesce("abstract", F.lit(""))),
        expansion if expansion is not None else F.lit(""),
    ]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def todo(inputs: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


def reuse(inputs: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Stored results of those inputs that have one."""
    return done.join(inputs.select(key).distinct(), key, "left_semi")


def store(results: DataFrame, path: str, namespace: str) -> None:
    """Append results to the keyed table, one folder per namespace."""
    results.withColumn("namespace", F.lit(namespace)).write.mode("append").partitionBy("namespace").parquet(path)


def stored(spark, path: str, namespace: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("namespace") == namespace).drop("namespace")
