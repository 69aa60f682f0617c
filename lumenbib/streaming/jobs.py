"""Streaming twins: source health slices and incremental scoring of newly landed papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lumenbib.operators.health import health_slices
from lumenbib.operators.incremental import todo


def stream_health_slices(attempts: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", width: str = "10 minutes") -> StreamingQuery:
    """Append finished health slices to a Parquet table, exactly once.

    A slice is final once the watermark has passed it, so rows may arrive in any order within
    ``delay``; later ones are dropped and show up in the query metrics. ``health_from_slices`` over
    the table gives the running averages.
    """
    slices = health_slices(attempts.withWatermark("ts", delay), width)
    return (
        slices.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_new_results(
    papers: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    key: str = "key",
    event_time: str | None = None,
    delay: str = "1 day",
) -> StreamingQuery:
    """Compute results for papers whose key has none yet and append them to the table at ``path``.

    Every micro-batch writes its own folder in overwrite mode, so a repeated batch replaces itself. Rows count however
    late they land; with ``event_time`` a watermark bounds the state of the early de-duplication, and rows that are later
    than ``delay`` get no result.
    """
    fresh = papers
    if event_time:
        fresh = papers.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])

    def run(batch: DataFrame, batch_id: int) -> None:
        from pyspark.sql import functions as F

        spark = batch.sparkSession
        unique = batch.dropDuplicates([key])
        if _exists(spark, path):
            done = spark.read.parquet(path).filter(F.col("batch") != batch_id)
            unique = todo(unique, done, key)
        compute(unique).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return fresh.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
