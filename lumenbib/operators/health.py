"""Running health of link sources: exponential averages over an ordered attempt log.

The average is a chain of affine steps, so it splits: every time slice of a source folds to
``(n, b)`` alone, and a source's value is ``sum(b_s * keep^(rows after s)) + keep^n * seed``. Only
slices, never all attempts of a source, meet in one place. A stream emits the same slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.functions.text import source_bucket

# Step size and start values.
ALPHA = 0.12
START_SUCCESS = 0.5
START_LATENCY = 4000.0


def _fold(values: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["n"] + 1).alias("n"), (acc["b"] * (1 - ALPHA) + ALPHA * x).alias("b"))

    return F.aggregate(values, start, step)


def health_slices(attempts: DataFrame, width: str = "10 minutes") -> DataFrame:
    """One row per source bucket and time slice of ``attempts(source, ts, seq, success, latency_ms, reason)``.

    Works on a batch and, behind a watermark, on a stream. A slice is as large as ``width`` allows.
    """
    row = F.struct("ts", "seq", "success", "latency_ms", "reason")
    grouped = attempts.groupBy(
        source_bucket("source").alias("bucket"), F.window("ts", width).alias("slice")
    ).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    success = F.transform("rows", lambda r: F.when(r["success"], 1.0).otherwise(0.0))
    timed = F.filter("rows", lambda r: r["success"] & (r["latency_ms"] > 0))
    last = F.element_at("rows", -1)
    return grouped.select(
        "bucket",
        F.col("slice.start").alias("slice_start"),
        _fold(success).alias("success"),
        _fold(F.transform(timed, lambda r: r["latency_ms"])).alias("latency"),
        F.struct(
            last["ts"].alias("ts"),
            last["seq"].alias("seq"),
            F.when(last["success"], "").otherwise(F.coalesce(last["reason"], F.lit(""))).alias("error"),
        ).alias("last"),
    )


def health_from_slices(slices: DataFrame) -> DataFrame:
    """``(bucket, success_ema, latency_ema, attempts, last_error, last_update)`` from slice rows."""
    after = Window.partitionBy("bucket").orderBy(F.col("slice_start").desc()).rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.select(
        "*",
        F.coalesce(F.sum("success.n").over(after), F.lit(0)).alias("later"),
        F.coalesce(F.sum("latency.n").over(after), F.lit(0)).alias("later_timed"),
    )
    keep = F.lit(1 - ALPHA)

    def folded(name: str, later: str) -> Column:
        return F.sum(F.col(f"{name}.b") * F.pow(keep, F.col(later)))

    total = placed.groupBy("bucket").agg(
        folded("success", "later").alias("success_sum"),
        folded("latency", "later_timed").alias("latency_sum"),
        F.sum("success.n").alias("attempts"),
        F.sum("latency.n").alias("timed"),
        F.max("last").alias("last"),
    )
    return total.select(
        "bucket",
        (F.col("success_sum") + F.pow(keep, F.col("attempts")) * START_SUCCESS).alias("success_ema"),
        (F.col("latency_sum") + F.pow(keep, F.col("timed")) * START_LATENCY).alias("latency_ema"),
        "attempts",
        F.col("last.error").alias("last_error"),
        F.col("last.ts").alias("last_update"),
    )


def source_health(attempts: DataFrame, width: str = "10 minutes") -> DataFrame:
    return health_from_slices(health_slices(attempts, width))


def failure_stops(attempts: DataFrame, run: int = 3, width: str = "10 minutes") -> DataFrame:
    """Where each source would have stopped after ``run`` failures in a row.

    ``(source, attempts, stop_after, skipped)``: ``stop_after`` is the position of the failure that
    completes the first run (null without one), ``skipped`` the attempts behind it. Runs that span
    slices are carried over by slice summaries.
    """
    row = F.struct("ts", "seq", "success")
    grouped = attempts.groupBy("source", F.window("ts", width).alias("slice")).agg(
        F.array_sort(F.collect_list(row)).alias("rows")
    )
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("streak"), F.lit(0).alias("lead"), F.lit(True).alias("pure"), F.lit(0).alias("hit")
    )

    def step(acc: Column, r: Column) -> Column:
        streak = F.when(r["success"], 0).otherwise(acc["streak"] + 1)
        pure = acc["pure"] & ~r["success"]
        return F.struct(
            (acc["n"] + 1).alias("n"),
            streak.alias("streak"),
            F.when(pure, acc["lead"] + 1).otherwise(acc["lead"]).alias("lead"),
            pure.alias("pure"),
            F.when(acc["hit"] > 0, acc["hit"]).when(streak >= run, acc["n"] + 1).otherwise(0).alias("hit"),
        )

    slices = grouped.select("source", F.col("slice.start").alias("at"), F.aggregate("rows", start, step).alias("s")).select(
        "source", "at", "s.*"
    )
    ordered = Window.partitionBy("source").orderBy("at")
    block = F.sum(F.when(F.col("pure"), 0).otherwise(1)).over(ordered)
    grouped = slices.withColumn("block", block)
    inside = Window.partitionBy("source", "block").orderBy("at")
    carried = grouped.withColumn("out", F.sum(F.when(F.col("pure"), F.col("n")).otherwise(F.col("streak"))).over(inside))
    placed = carried.withColumns(
        {
            "carry": F.coalesce(F.lag("out").over(ordered), F.lit(0)),
            "before": F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    local = F.when((F.col("carry") > 0) & (F.col("carry") + F.col("lead") >= run), F.greatest(F.lit(1), run - F.col("carry"))).otherwise(
        F.nullif("hit", F.lit(0))
    )
    stopped = placed.groupBy("source").agg(
        F.sum("n").cast("long").alias("attempts"), F.min(F.col("before") + local).cast("long").alias("stop_after")
    )
    return stopped.withColumn("skipped", F.coalesce(F.col("attempts") - F.col("stop_after"), F.lit(0)).cast("long"))
