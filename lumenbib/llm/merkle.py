"""Document fingerprints (method: Merkle trees over sections, paragraphs and phrases).

A text is cut into paragraphs (lines), these into phrases; consecutive paragraphs form sections, which end at a blank
line or at a paragraph whose own digest says so, so that an edit moves no later section edge. A node's digest covers
its children in order and the root is the fingerprint: equal texts have equal roots, and where two roots differ, both
trees are descended side by side. Children of equal digest are aligned in order (the i-th of a digest with the i-th of
it on the other side, the longest increasing run of such pairs), never entered, and part the others into gaps; a gap
without such a pair goes on with the children's children. What is not aligned down to the phrases is an edit, so moved
and repeated branches are. Likeness is the share of characters in aligned branches, from 0 to 1.

Null texts count as empty; two empty texts are alike (1), an empty and another are not (0). Order is by descending id,
null ids last, ties by the hash of the text and then the text; repeated rows each get a row. A table of one row is its
own neighbour, an empty table gives an empty table. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbib.llm.common import free_name
from lumenbib.session import shuffle_width

PHRASES = re.compile(r"[^.,;:!?]{1,80}[.,;:!?]*\s*|[.,;:!?]+\s*").findall
SECTION_PARAGRAPHS = 8  # on average, where no blank line ends a section sooner


class Node(NamedTuple):
    digest: bytes
    start: int
    length: int
    children: tuple


def _digest(parts: list[bytes], kind: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16, person=kind).digest()


def tree(text: str) -> Node:
    """Root over sections over paragraphs over phrases."""
    sections: list[Node] = []
    held: list[Node] = []
    at = first = 0

    def close() -> None:
        sections.append(Node(_digest([p.digest for p in held], b"section"), first, at - first, tuple(held)))
        held.clear()

    for line in text.splitlines(keepends=True):
        leaves, start = [], at
        for p in PHRASES(line):
            digest = hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            leaves.append(Node(digest, at, len(p), ()))
            at += len(p)
        own = _digest([x.digest for x in leaves], b"paragraph")
        held.append(Node(own, start, at - start, tuple(leaves)))
        if own[0] % SECTION_PARAGRAPHS == 0 or not line.strip():
            close()
            first = at
    if held:
        close()
    return Node(_digest([x.digest for x in sections], b"root"), 0, at, tuple(sections))


def _numbered(nodes: list[Node]) -> list[tuple[bytes, int]]:
    seen: Counter = Counter()
    out = []
    for x in nodes:
        out.append((x.digest, seen[x.digest]))
        seen[x.digest] += 1
    return out


def _rising(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs that rises in both; the first members rise already."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, q) in enumerate(places):
        k = bisect_left(ends, q)
        before.append(at[k - 1] if k else -1)
        ends[k:k + 1], at[k:k + 1] = [q], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(places[i])
        i = before[i]
    return out[::-1]


def aligned(a: Node, b: Node) -> list[tuple[int, int, int]]:
    """Equal branches in order: (start in ``a``, start in ``b``, length)."""
    out, todo = [], [([a], [b])]
    while todo:
        left, right = todo.pop()
        head = tail = 0
        while head < min(len(left), len(right)) and left[head].digest == right[head].digest:
            out.append((left[head].start, right[head].start, left[head].length))
            head += 1
        while tail < min(len(left), len(right)) - head and left[-1 - tail].digest == right[-1 - tail].digest:
            out.append((left[-1 - tail].start, right[-1 - tail].start, left[-1 - tail].length))
            tail += 1
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        if not left or not right:
            continue
        where = {key: q for q, key in enumerate(_numbered(right))}
        pairs = _rising([(p, where[key]) for p, key in enumerate(_numbered(left)) if key in where])
        if pairs:
            last_p = last_q = 0
            for p, q in [*pairs, (len(left), len(right))]:
                todo.append((left[last_p:p], right[last_q:q]))
                if p < len(left):
                    out.append((left[p].start, right[q].start, left[p].length))
                last_p, last_q = p + 1, q + 1
        elif left[0].children and right[0].children:
            todo.append(([c for x in left for c in x.children], [c for x in right for c in x.children]))
    return sorted(out)


def likeness(a: Node, b: Node) -> float:
    """Twice the characters of aligned branches over all characters; 1 for two empty texts."""
    if a.digest == b.digest:
        return 1.0
    return 2 * sum(n for _, _, n in aligned(a, b)) / (a.length + b.length)


def edited_spans(a: Node, b: Node) -> list[tuple[int, int]]:
    """Spans (start, length) of ``a`` that are in no branch aligned with ``b``."""
    out, at = [], 0
    for start, _, n in [*aligned(a, b), (a.length, b.length, 0)]:
        if start > at:
            out.append((at, start - at))
        at = start + n
    return out


# ---------------------------------------------------------------- Spark


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (the root) and ``sections`` (their digests and places).

    Columns of these names are replaced.
    """
    kind = "fingerprint string, sections array<struct<digest: string, start: long, length: long>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            roots = [tree(t) for t in batch.fillna("")]
            rows = [(r.digest.hex(), [(s.digest.hex(), s.start, s.length) for s in r.children]) for r in roots]
            yield pd.DataFrame(rows, columns=["fingerprint", "sections"])

    made = free_name(docs, "tree")
    kept = [c for c in docs.columns if c.lower() not in ("fingerprint", "sections")]
    return docs.withColumn(made, run(F.col(text).cast("string"))).select(*kept, f"{made}.*")


def locate_edits(pairs: DataFrame, left: str, right: str, into: str = "edits") -> DataFrame:
    """``pairs`` with the spans of ``left``'s paragraphs that differ from ``right``'s."""

    @F.pandas_udf("array<struct<start: long, length: long>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            rows = zip(a.fillna(""), b.fillna(""), strict=True)
            yield pd.Series([edited_spans(tree(x), tree(y)) for x, y in rows], dtype=object)

    return pairs.withColumn(into, run(F.col(left).cast("string"), F.col(right).cast("string")))


def neighbour_runs(docs: DataFrame) -> DataFrame:
    """Texts dealt out as runs in descending id order: (run, guest, doc_id, text), sorted within each partition.

    The last row of a run is a guest: the row that opens the next run, sent there as well (the first one's for the last),
    so each row's neighbour follows it in its own partition. Texts are shuffled once; the driver sees the edges of the
    runs only (a few per partition). Rows without an id are spread by the hash of their text.
    """
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = [(k + 1) / (8 * width) for k in range(8 * width - 1)]
    edges = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), wanted, 100_000)).first()[0]
    cuts = np.unique(np.array(edges or [], np.int64))

    @F.pandas_udf("long")
    def above(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="left"))

    missing = F.lit(-129) - F.shiftright("h", 56)
    key = F.when(F.col("doc_id").isNull(), missing).otherwise(above(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("run", key)
    heads = rows.groupBy("run").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("head")).collect()
    heads.sort(key=lambda r: -r["run"])
    opens = [(r["run"], r["head"]["doc_id"], ~r["head"]["h"]) for r in heads]
    kinds = f"run long, first {rows.schema['doc_id'].dataType.simpleString()}, fh long, goes_to long"
    before = [(run, first, h, opens[i - 1][0]) for i, (run, first, h) in enumerate(opens)]
    edge = F.broadcast(docs.sparkSession.createDataFrame(before, kinds))  # a row per run
    is_head = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("fh"))
    places = F.array(
        F.struct(F.col("run"), F.lit(0).alias("guest")),
        F.when(is_head, F.struct(F.col("goes_to").alias("run"), F.lit(1).alias("guest"))),
    )
    dealt = rows.join(edge, "run").select("doc_id", "text", "h", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("p"))
    dealt = dealt.select("p.run", "p.guest", "doc_id", "h", "text").repartition(width, "run")
    order = [F.col("run"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("text")]
    return dealt.sortWithinPartitions(*order).select("run", "guest", "doc_id", "text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Per document: size, digest of its edited text (the tail replaced by the next document's head), both
    fingerprints, the likeness of its own to the edited text's and to the next document's, and how many spans the trees
    locate as edited, and where the first one starts."""
    runs = neighbour_runs(docs)
    id_kind = runs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_edits", "first_edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (run, guest, doc_id, text, tree)
        for batch in batches:
            rows, id_type = [], batch.schema.field("doc_id").type
            for own, guest, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if last and last[0] == own and guest and last[1]:
                    continue  # further rows that tie with the head
                now = tree(text)
                if last and last[0] == own:
                    n = len(last[3])
                    edited = last[3][: n - n // 2] + text[: n // 2]
                    changed = tree(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    roots = last[4].digest.hex(), changed.digest.hex()
                    edits = edited_spans(last[4], changed)
                    near = likeness(last[4], changed), likeness(last[4], now)
                    rows.append((last[2], n, sha, *roots, *near, len(edits), edits[0][0] if edits else None))
                last = (own, guest, doc, text, now)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *map(pa.array, cols[1:8]), pa.array(cols[8], pa.int64())], names)

    kinds = f"doc_id {id_kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string"
    return runs.mapInArrow(run, f"{kinds}, near_edited double, near_next double, n_edits long, first_edit long")
