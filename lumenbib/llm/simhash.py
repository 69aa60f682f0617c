"""SimHash near-duplicates (method: tiled exact comparison with numpy exclusive-or and bit counts).

A fingerprint is the bitwise majority over the XXH64 hashes of all word shingles. Equal fingerprints are one point.
Two points within ``radius`` bits agree in at least one of ``radius + 1`` bit bands, so comparing inside bands misses no
link; inside a band's block, points are sorted by their number of set bits, compared tile by tile, and tiles whose
counts differ by more than the radius are skipped, as are such tile pairs of blocks that are too large for one task.
Tasks return forests of their links, which alternating stars turn into components.

The pipeline's stage (``one_of_each``) takes longer shingles and verifies its links on the texts. Its candidates are the links
of the same tiles; as fingerprints tell its similarity badly (at a Jaccard similarity of 0.8 they differ in 9.7 of 64 bits on
average), bands of least hashes add those beyond the radius.

Texts: null counts as empty; a text without words has fingerprint zero and is linked like any other. Rows that repeat
an id each get a row; a null id gets the component of its text, named by the smallest id that is not null (null if
there is none). An empty table gives an empty table. Only the id and text columns are looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbib.llm.common import free_name, spread_small
from lumenbib.llm.forest import LocalClasses, components
from lumenbib.llm.tiles import TILE, per_group, tile_groups
from lumenbib.session import checkpoint_dir, cut_lineage

WORDS, RADIUS, SEED = 4, 4, 42
STAGE_WORDS, LEAST_SIMILARITY = 5, 0.8  # of the pipeline's stage
BANDS, ROWS = 30, 6
TEXT_TILE = 1 << 19  # shingles of the texts that a task holds as one side
SUB_TILE = 512
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
STEP = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """Majority bits over the hashes of all shingles of ``words`` words, repeats included."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # at space and \\x09-\\x0d
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    return majority(
        np.array([of(whole[a:b], SEED) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP], strict=True)], np.uint64)
        for i in range(0, len(starts), STEP)
    )


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for own in parts:
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(own)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            own = np.array([fingerprint(t, words) for t in batch.fillna("")], np.uint64)
            yield pd.Series(own.view(np.int64))

    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    return rows.select(key, run("text").alias("fp"))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two arrays, sorted by bit count, that differ in at most ``radius`` bits, tile by tile."""
    ones_a, ones_b = np.bitwise_count(a), np.bitwise_count(b)
    for i in range(0, len(a), SUB_TILE):
        x = a[i : i + SUB_TILE]
        low, high = int(ones_a[i]), int(ones_a[min(i + SUB_TILE, len(a)) - 1])
        for j in range(i if upper else 0, len(b), SUB_TILE):
            y = b[j : j + SUB_TILE]
            if int(ones_b[j]) - high > radius:
                break
            if low - int(ones_b[min(j + SUB_TILE, len(b)) - 1]) > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            yield p + i, q + j


def _link_group(radius: int):
    def work(rows: pa.Table) -> pa.RecordBatch:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        side = rows.column("side").to_numpy()
        order = np.lexsort((np.bitwise_count(fp), side))
        fp, side = fp[order], side[order]
        first = int(np.searchsorted(side, 2)) if side[0] else 0
        classes = LocalClasses(len(fp))
        a, b = (fp[:first], fp[first:]) if first else (fp, fp)
        for p, q in close_pairs(a, b, radius, upper=not first):
            classes.link(p, q + first)
        own, root = classes.forest()
        return pa.RecordBatch.from_pydict({"a": fp[own].view(np.int64), "b": fp[root].view(np.int64)})

    return work


def links(points: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    bands = [
        F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(i << 60))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    banded = points.select("fp", F.explode(F.array(*bands)).alias("key"))
    groups = tile_groups(banded, F.bit_count("fp"), radius, F.xxhash64("fp"), tile)
    return per_group(groups, _link_group(radius), "a long, b long")


def classes(points: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(fp, root) for distinct fingerprints ``fp``: the smallest fingerprint of its component."""
    roots = components(links(points.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    return points.select("fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Per document: ``doc_id``, ``fp``, ``fingerprint`` (16 hexadecimal digits), ``component_id``."""
    prints = cut_lineage(fingerprints(spread_small(docs.select("doc_id", "text")), words))
    points = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = points.join(classes(points, radius, tile), "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    own = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(own, "fp").select("doc_id", "fp", digits.alias("fingerprint"), "component_id")


def placed(docs: DataFrame, place: str) -> DataFrame:
    """``docs`` written once to the shared folder with a number of each row, so that every later read has the same."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/placed-{uuid.uuid4().hex}"
    docs.withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(hashes(text, words))


def hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    k, of = min(words, len(parts)), xxhash.xxh64_intdigest
    if not parts:
        return np.empty(0, np.uint64)
    return np.array([of(b" ".join(parts[i : i + k]), SEED) for i in range(len(parts) - k + 1)], np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key of each band: mixed least values of the band's hash functions over a text's shingles."""
    draw = np.random.default_rng(SEED)
    n = BANDS * ROWS
    factor, shift = draw.integers(0, 1 << 64, (2, n), np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1024):
        mixed = (own[i : i + 1024, None] ^ shift) * (factor | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """Adds to ``rows`` of a ``text`` the struct of ``same`` (digest of the words), ``n`` distinct shingles,
    the fingerprint ``fp`` and ``bands``."""

    @F.pandas_udf("same binary, n long, fp long, bands array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = []
            for text in batch.fillna(""):
                whole = b" ".join(text.encode("utf-8", "surrogatepass").translate(LOWER).split())
                every = hashes(text, words)
                own = np.unique(every)
                fp = int(np.uint64(majority(every[i : i + STEP] for i in range(0, len(every), STEP))).view(np.int64))
                out.append((xxhash.xxh3_128_digest(whole), len(own), fp, band_keys(own).view(np.int64) if len(own) else []))
            yield pd.DataFrame(out, columns=["same", "n", "fp", "bands"])

    return rows.withColumn("sketch", run(F.col("text").cast("string")))


def _verify_group(words: int, least: float):
    """Links of a group's texts by exact shingle similarity; compared are pairs that are not linked yet and lie within the
    radius or share a band."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        at, side, n = (rows.column(c).to_numpy() for c in ("at", "side", "n"))
        fp = rows.column("fp").to_numpy().view(np.uint64)
        bands = np.array(rows.column("bands").to_pylist(), np.int64)
        texts = rows.column("text")
        sets: dict[int, np.ndarray] = {}

        def own(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(texts[i].as_py(), words)
            return sets[i]

        classes = LocalClasses(len(at))
        for p in range(len(at) - 1):
            apart = np.flatnonzero(classes.label[p + 1 :] != classes.label[p]) + p + 1
            if side[p]:
                apart = apart[side[apart] != side[p]]
            apart = apart[np.minimum(n[apart], n[p]) >= least * np.maximum(n[apart], n[p])]
            apart = apart[(np.bitwise_count(fp[apart] ^ fp[p]) <= RADIUS) | (bands[apart] == bands[p]).any(axis=1)]
            for q in apart:
                if classes.label[q] == classes.label[p]:
                    continue
                common = len(np.intersect1d(own(p), own(q), assume_unique=True))
                if common >= least * (n[p] + n[q] - common):
                    classes.link(np.array([p]), np.array([q]))
        own_at, root = classes.forest()
        return pa.RecordBatch.from_pydict({"a": at[own_at], "b": at[root]})

    return work


def candidates(points: DataFrame) -> DataFrame:
    """(node, root) of the components of candidate pairs of ``points(at, n, fp, bands)``: fingerprints within the radius, found
    by tiles, and shared bands. Links go through one point of each fingerprint and of each band."""
    worded = points.filter("n > 0")
    prints = cut_lineage(worded.groupBy("fp").agg(F.min("at").alias("least")))
    equal = worded.join(prints, "fp").filter("at <> least").select(F.col("at").alias("a"), F.col("least").alias("b"))
    ends = [prints.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(c)) for c in "ab"]
    tiled = cut_lineage(links(prints.select("fp"))).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    close = tiled.join(ends[0], "fp_a").join(ends[1], "fp_b").select("a", "b")
    banded = worded.select("at", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("at").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("key", "hub")
    met = banded.join(hubs, "key").filter("at <> hub").select(F.col("at").alias("a"), F.col("hub").alias("b"))
    return components(equal.union(close).union(met))


def one_of_each(docs: DataFrame, words: int = STAGE_WORDS, least: float = LEAST_SIMILARITY, tile: int = TEXT_TILE) -> DataFrame:
    """``docs`` with one row of each group of near copies: its smallest id, null ids last, the first row of equal ids.

    Near copies share at least ``least`` of the distinct shingles of ``words`` words of both (Jaccard), or are linked by
    such pairs. Candidates have fingerprints within ``RADIUS`` bits, all of which the tiles find, or share one of ``BANDS`` keys
    of ``ROWS`` least hashes: a pair at 0.8 does with probability 0.9999, a closer one more surely. Every link is verified on whole texts: those of a candidate component meet once,
    in tiles of about ``tile`` shingles whose counts can agree. Texts of the same words, also of none, are one.

    Rows are told apart by a number that is written with them once. Only the numbers of rows that go are joined to
    the texts.
    """
    place = free_name(docs, "place")
    rows = placed(docs, place)
    texts = rows.select(F.col(place).alias("at"), F.col("text").cast("string").alias("text"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(place).alias("at")).alias("own"))
    prints = cut_lineage(sketches(spread_small(texts), words).select("at", "own", "sketch.*"))
    # One point for each text, named by the row number of its smallest id.
    points = prints.groupBy("same").agg(F.min("own").alias("own"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    points = cut_lineage(points.withColumn("at", F.col("own.at")))
    met = cut_lineage(candidates(points))
    roots = met.union(met.select(F.col("root").alias("node"), "root").distinct())
    members = points.select("at", "n", "fp", "bands").join(roots.select(F.col("node").alias("at"), F.col("root").alias("key")), "at")
    # Counts of a verified pair differ by less than a factor of 1 / least: the logarithms' whole parts by one at most.
    size = F.floor(F.log("n") / F.lit(-float(np.log(least))) + 1e-9)
    whole = cut_lineage(members.join(texts.select("at", "text"), "at"))
    groups = tile_groups(whole, size, 2, F.xxhash64("at"), tile, F.greatest("n", F.lit(1)))
    linked = components(per_group(groups, _verify_group(words, least), "a long, b long")).select(F.col("node").alias("at"), "root")
    rooted = points.select("same", "own", "at").join(linked, "at", "left").withColumn("root", F.coalesce("root", "at"))
    heads = rooted.groupBy("root").agg(F.min("own").alias("head"))
    firsts = rooted.join(heads, "root").select("same", F.col("head.at").alias("head"))
    gone = prints.join(firsts, "same").filter(F.col("at") != F.col("head")).select(F.col("at").alias(place))
    return rows.join(gone, place, "left_anti").select(*docs.columns)
