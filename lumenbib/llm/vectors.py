"""Near-duplicate vectors (method: random-hyperplane signs in several tables, exact cosine, components).

Equal vectors of a label are one point with a count. A table keys each point by the signs of its products with a few
random hyperplanes; points that share a key in some table are compared exactly, in double precision. The number of
signs grows with the logarithm of the number of points, so blocks stay small, and the number of tables follows from
it: a pair at exactly the least cosine is missed with probability ``MISS`` at most, a closer one more rarely. A pair is
counted in the first table that both share, and tasks return counts and forests, never all links of a dense group.
Blocks that are too large for a task are compared as pairs of tiles (``tiles``).

Vectors that are null, zero, or hold a null or non-finite component link with nothing, nor do rows whose label is null;
vectors of different lengths never link. Rows that repeat an id each get a row; equal ones link with one another. A
null id is never the smallest of a component. An empty table gives an empty table. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbib.llm.forest import LocalClasses, components
from lumenbib.llm.tiles import TILE, per_group, tile_groups
from lumenbib.session import cut_lineage

COSINE, MISS = 0.98, 1e-5
SUB_TILE = 512


def plan_tables(points: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """Signs a table and number of tables for so many points."""
    bits = max(6, math.ceil(math.log2(max(points, 1))) - 6)
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles of length one; scaled first, so that squares neither overflow nor vanish."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def signatures(points: DataFrame, bits: int, tables: int, seed: int = 0) -> DataFrame:
    """Adds ``keys``: per table the signs of the products with its hyperplanes, as one number."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == size)))
                width = int(size)
                if width not in planes:
                    planes[width] = np.random.default_rng(seed).standard_normal((width, tables * bits))
                for a in range(0, own.num_rows, 1024):
                    part = own.slice(a, 1024)
                    signs = _matrix(part.column("embedding")) @ planes[width] >= 0
                    keys = signs.reshape(part.num_rows, tables, bits) @ weights
                    ends = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], [*part.schema.names, "keys"]
                    )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{kinds}, keys array<bigint>")


def _link_group(cosine: float):
    def work(rows: pa.Table) -> pa.RecordBatch:
        unit = _matrix(rows.column("embedding"))
        keys = np.asarray(rows.column("keys").combine_chunks().flatten()).reshape(len(unit), -1)
        side, table = rows.column("side").to_numpy(), int(rows.column("t")[0].as_py())
        node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
        first = int(np.searchsorted(side, 2)) if side[0] else 0
        classes, linked = LocalClasses(len(unit)), np.zeros(len(unit), np.int64)
        for i in range(0, first or len(unit), SUB_TILE):
            end = min(i + SUB_TILE, first or len(unit))
            for j in range(first or i, len(unit), SUB_TILE):
                p, q = np.nonzero(unit[i:end] @ unit[j : j + SUB_TILE].T >= cosine)
                p, q = p + i, q + j
                if not first:
                    p, q = p[p < q], q[p < q]
                classes.link(p, q)
                fresh = ~(keys[p, :table] == keys[q, :table]).any(axis=1)
                p, q = p[fresh], q[fresh]
                linked += np.bincount(p, copies[q], len(linked)).astype(np.int64)
                linked += np.bincount(q, copies[p], len(linked)).astype(np.int64)
        own, root = classes.forest()
        met = np.flatnonzero(linked)
        a, b = np.concatenate([node[own], node[met]]), np.concatenate([node[root], node[met]])
        n = np.concatenate([np.zeros(len(own), np.int64), linked[met]])
        return pa.RecordBatch.from_pydict({"a": a, "b": b, "n": n})

    return work


def links(points: DataFrame, cosine: float, bits: int, tables: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b, 0) of forests, and rows (a, a, n): a part of the number of vectors linked with a."""
    signed = signatures(points, bits, tables)
    exploded = signed.select("node", "copies", "size", "label", "embedding", "keys", F.posexplode("keys").alias("t", "k"))
    keyed = exploded.withColumn("key", F.xxhash64("label", "size", "t", "k"))
    keyed = keyed.select("key", "t", "node", "copies", "embedding", "keys")
    groups = tile_groups(keyed, F.lit(0), 0, F.xxhash64("node"), tile)
    return per_group(groups, _link_group(cosine), "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """Per row of (vec_id, embedding, label): ``n_links``, ``component_id``, ``kept``."""
    v = F.col("embedding")
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", v).withColumn("good", F.coalesce(plain & F.col("label").isNotNull(), F.lit(False)))
    # The same vector has the same two 64-bit hashes.
    rows = rows.withColumns({"h1": F.xxhash64("label", v), "h2": F.xxhash64(F.lit(1), v, "label")})
    same = rows.filter("good").groupBy("label", "h1", "h2")
    points = same.agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    points = cut_lineage(points.withColumns({"size": F.size("embedding"), "node": F.monotonically_increasing_id()}))
    bits, tables = plan_tables(points.count(), cosine, miss)
    found = cut_lineage(links(points, cosine, bits, tables, tile))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("n = 0").select("a", "b"))
    own = points.select("label", "h1", "h2", "least", "copies", "node")
    rooted = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").join(counts, "node", "left")
    known = known.select("label", "h1", "h2", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    ids = rows.select("vec_id", "label", "h1", "h2", "good")
    linked = ids.filter("good").drop("good").join(known, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = ids.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
