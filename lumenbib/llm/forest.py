"""Links become classes: inside a task over numpy arrays, across tasks by alternating stars.

Tasks hand on a forest of what they linked (at most one edge a node), never all links of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbib.session import cut_lineage

FEW = 1 << 14  # links that one task turns into components


class LocalClasses:
    """Classes of ``n`` points of a task under links that arrive in bulk; a class is named by its first point."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.label[left], self.label[right]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.label, high, low)
            while True:  # every point learns the first of its class
                nearer = self.label[self.label]
                if np.array_equal(nearer, self.label):
                    break
                self.label = nearer
            a, b = self.label[low], self.label[high]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Points that are not the first of their class, and the first."""
        own = np.flatnonzero(self.label != np.arange(len(self.label)))
        return own, self.label[own]


def _stars(edges: DataFrame) -> DataFrame:
    """One round: larger neighbours move to a node's smallest neighbour, then smaller ones do."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(least.select("a", F.col("m").alias("b"))).distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) of a few edges, by one task; its rows are dealt out again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(c).to_numpy() for c in ("a", "b")]) for b in batches if b.num_rows]
        if held:
            nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
            classes = LocalClasses(len(nodes))
            classes.link(*ends.reshape(2, -1))
            own, root = classes.forest()
            yield pa.RecordBatch.from_pydict({"node": nodes[own], "root": nodes[root]})

    return cut_lineage(edges.select("a", "b").repartition(1).mapInArrow(run, "node long, root long").repartition("node"))


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` that is not the smallest of its component.

    Up to ``few`` edges are one task's: a round of stars takes seven shuffles however few the edges are, and the driver
    keeps a thread for each shuffle of the last minute. More take alternating large and small stars: a node with very many
    neighbours is aggregated before it is joined, and the joins can be split. The number of rounds follows the logarithm of
    the longest path. Each round is checkpointed.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if mark[0] <= few:
            return _at_once(now)
        state = mark
        now = cut_lineage(_stars(now))
