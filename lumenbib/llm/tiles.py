"""Blocks of points that are compared pair by pair, dealt out as tiles of bounded size.

A block (all points that share a key) of up to ``tile`` points is one task's group. A larger one is cut into tiles, and
each pair of tiles that may hold a link is a group of its own, so that no group exceeds two tiles however hot a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.session import shuffle_width

TILE = 4096


def tile_groups(
    points: DataFrame, order: Column, reach: int, spread: Column, tile: int = TILE, weight: Column | None = None
) -> DataFrame:
    """``points`` with a ``key`` become groups: adds ``pair`` (a group together with key) and ``side``.

    ``side`` is 0 for a whole block or a tile with itself, else 1 and 2 for the two tiles. Tiles of a large block are
    ranges of ``order`` (an integer), subdivided by the hash ``spread``; pairs of tiles whose orders differ by more
    than ``reach`` are left out, as no link is possible there. ``tile`` bounds the number of points, or the sum of
    their ``weight``.
    """
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    large = points.groupBy("key").agg(size.alias("n")).filter(F.col("n") > tile).select("key")
    whole = points.join(large, "key", "left_anti").withColumns({"pair": F.lit(0).cast("long"), "side": F.lit(0)})
    cut = points.join(large, "key").withColumns({"o": order.cast("int"), "h": F.pmod(spread, F.lit(1 << 20)).cast("int")})
    sizes = cut.groupBy("key", "o").agg(F.ceil(size / tile).cast("int").alias("parts"))
    one = sizes.select("key", "o", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s"))
    other = one.select("key", F.col("o").alias("o2"), F.col("s").alias("s2"))
    ahead = (F.col("o2") > F.col("o")) & (F.col("o2") <= F.col("o") + reach)
    pairs = one.join(other, "key").filter(ahead | ((F.col("o2") == F.col("o")) & (F.col("s2") >= F.col("s"))))
    pairs = pairs.withColumn("pair", F.xxhash64("o", "s", "o2", "s2"))
    same = (F.col("o") == F.col("o2")) & (F.col("s") == F.col("s2"))
    left = pairs.select("key", "o", "s", "pair", F.when(same, 0).otherwise(1).alias("side"))
    right = pairs.filter(~same).select("key", F.col("o2").alias("o"), F.col("s2").alias("s"), "pair", F.lit(2).alias("side"))
    parted = cut.join(sizes, ["key", "o"]).withColumn("s", F.col("h") % F.col("parts"))
    dealt = parted.join(left.union(right), ["key", "o", "s"]).select(*points.columns, "pair", "side")
    return whole.select(*points.columns, "pair", "side").unionByName(dealt)


def per_group(groups: DataFrame, work: Callable[[dict[str, pa.ChunkedArray]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Runs ``work`` on the columns of each (key, pair) group, without a Python call of Spark's per group."""
    dealt = groups.repartition(shuffle_width(groups.sparkSession), "key", "pair").sortWithinPartitions("key", "pair", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, pairs = batch.column("key").to_numpy(), batch.column("pair").to_numpy()
            cuts = [0, *((keys[1:] != keys[:-1]) | (pairs[1:] != pairs[:-1])).nonzero()[0] + 1, batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                name = (keys[a], pairs[a])
                if name != last and held:
                    yield from done(held)
                    held = []
                last = name
                held.append(batch.slice(a, b - a))
        if held:
            yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in held) > 1:
            out = work(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield out

    return dealt.mapInArrow(run, schema)
