"""Column rules that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents whose labels are never learned from; false where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


def spread_small(df: DataFrame, width: int | None = None) -> DataFrame:
    """A table of fewer splits than cores is dealt out, as the step after it is heavy.

    Rows hold whole texts, so the session's Arrow batches are set to at most ``BATCH_ROWS`` rows: a batch lies in the
    task's memory several times over.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_KEY)) <= BATCH_ROWS:
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    cores = width or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, features: Callable[[str], Column] | None = None
) -> DataFrame:
    """(doc_id, label, f) of at most ``bound`` labelled rows outside the held-out quarter; f are ``features`` of the text.
    Without ``features`` it is (doc_id, text, label).

    The bound takes the smallest hashes of the ids, and of their rows (an id may repeat) the smallest hashes of id and
    features. Rows without a label, and ids with contradicting ones, teach nothing. The ids are broadcast: ``bound``
    limits them.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    clear = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("most")).filter("label = most")
    chosen = clear.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = spread_small(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id")
    made = F.col("text").alias("text") if features is None else features("text").alias("f")
    rows = rows.select("doc_id", made, "label")
    return rows.orderBy(F.xxhash64(*rows.columns[:2]), "doc_id").limit(bound)


def give_back() -> None:
    """Returns what a fit has freed to the system; otherwise glibc keeps tens of MB of it in the driver for good."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have, upper and lower case alike."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish = f"_{wish}"
    return wish
