"""Best-fit packing of token pieces into sequences (method: dominance reduction, then best fit).

Pieces of equal length are alike, so the packing problem is a histogram of at most ``capacity`` lengths, whatever the
number of documents; ``plan_bins`` solves that histogram and gives patterns with multiplicities. The pieces of a
length are numbered in parallel (salted, so that a length which holds most pieces is no single task) and look their
place up in the patterns. Texts and ids never leave the tasks; only piece rows (six numbers each) are shuffled.

Null texts count as empty (a document of the end id alone). Repeated rows are separate documents and get rows of
their own. An empty table gives an empty table. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from struct import pack as packed

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.llm.common import spread_small
from lumenbib.llm.words import Memo, slices
from lumenbib.session import cut_lineage, shuffle_width

CAPACITY = 4096
END_ID = 1
JOINED, KEPT = 4096, 300_000
MERGED = 16  # partitions of texts whose pieces make one partition
PART_CHARS = 1 << 17  # texts split at once: their words stay in the processor's cache
MARKS = ".,;:!?"
# A mark that ends a word behind a Latin-1 letter; others may turn into a letter and a combining mark, which a mark
# behind it joins.
END_MARK = re.compile(f"([{MARKS}])(?<=[A-Za-zªµºÀ-ÖØ-öø-ÿ].)(?=[ \\n]|\\Z)")


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> Memo:
    """Ids of blank-free words as little-endian bytes.

    The tokenizer never joins across a blank or a line end.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    model = Tokenizer.from_file(path)

    def compute(words: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(words), JOINED):  # one call for many words: a call a word costs more than its merges
            part = words[k : k + JOINED]
            found = model.encode(" ".join(part), add_special_tokens=False)
            firsts = np.cumsum([0, *(len(w) + 1 for w in part)])
            places = np.array([a for a, _ in found.offsets], np.int64)
            edges = (4 * np.searchsorted(places, firsts)).tolist()
            whole = np.array(found.ids, "<u4").tobytes()
            out += [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
    spelled = {c: bytewise.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256)}

    single = [packed("<I", i) for i in range(model.get_vocab_size())]

    def ids(words: list[str]) -> list[bytes]:
        """A lower-case word of Latin-1 letters is one token group of the tokenizer; its model takes it byte by byte."""
        out, rest, merge = [], [], model.model.tokenize
        for w in words:
            if w.isascii():
                w = w.lower()
                own = merge(w) if w.isalpha() else None
            else:
                own = merge(w.translate(spelled)) if w.isalpha() and w.islower() and latin(w) else None
            if own is None:
                rest.append(w)
                out.append(None)
            else:
                out.append(b"".join([single[t.id] for t in own]))
        others = iter(compute(rest))
        return [next(others) if x is None else x for x in out]

    return Memo(ids, KEPT)


def text_ids(texts: list[str], known: Memo, end_id: int = END_ID) -> Iterator[bytes]:
    """Ids of each text and the end id, four bytes each."""
    # The tokenizer lower-cases after composing characters; Latin-1 texts have nothing to compose. It takes a word and
    # the mark at its end apart: as words of their own both are met more often.
    parts = [END_MARK.sub(r" \1", t.lower() if latin(t) else t).replace("\n", " ").split(" ") for t in texts]
    found, k, end = known([w for p in parts for w in p]), 0, np.array([end_id], "<u4").tobytes()
    for p in parts:
        yield b"".join(found[k : k + len(p)]) + end
        k += len(p)


PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    step = 4 * capacity
    rows = spread_small(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    kind = T.StructType([rows.schema["doc_id"], *PIECE.fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = word_ids(path), kind.names
        for batch in batches:
            texts, of, own = [t or "" for t in batch.column(1).to_pylist()], [], []
            for a, b in slices(texts, PART_CHARS):
                for i, whole in enumerate(text_ids(texts[a:b], known, end_id), a):
                    for k, at in enumerate(range(0, len(whole), step)):
                        x = whole[at : at + step]
                        of.append(i)
                        own.append((k, k * capacity, len(x) // 4, zlib.crc32(x)))
            if own:
                piece, *others = zip(*own, strict=True)
                ids = batch.column(0).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in others)], names)

    return rows.mapInArrow(cut, kind)  # texts go to Python alone: no row waits for its result in the executor


# ---------------------------------------------------------------- the histogram problem


def dominating_set(top: int, lengths: list[int], count: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """Companions of item ``top`` in a set that dominates every other feasible set with it, or None.

    ``lengths`` is sorted and holds all that is left. A set dominates if the companions in any other feasible set can
    be exchanged for its own, of at least the same size; fixing it then costs no sequence.
    """
    room = capacity - top

    def largest(at_most: int, *used: int) -> int:
        k = bisect_left(lengths, at_most + 1) - 1
        while k >= 0 and count[lengths[k]] <= used.count(lengths[k]):
            k -= 1
        return lengths[k] if k >= 0 else 0

    best = largest(room, top)
    if best in (0, room):
        return (best,) if best else ()
    small: list[int] = []
    for x in lengths[:4]:
        small += [x] * min(count[x] - (x == top), 3)
    if len(small) < 2 or small[0] + small[1] > room:
        return (best,)  # one companion at most
    if len(small) > 2 and sum(small[:3]) <= room:
        return None
    pairs = {}
    for x in lengths[: bisect_left(lengths, room + 1)]:
        if count[x] > (x == top) and (y := largest(min(x, room - x), top, x)):
            pairs[x] = y
    if not pairs or best >= max(x + y for x, y in pairs.items()):
        return (best,)
    if pairs.get(best, 0) >= max(pairs.values()):
        return best, pairs[best]
    return None


def fix_dominating(count: dict[int, int], capacity: int) -> Counter:
    """Fixed patterns with their number; what they use is taken out of ``count``.

    Items go largest first, again until no rule holds for any. A rule that holds for an item still holds after its
    set is taken, as long as the members last: fewer items are left to form another set.
    """
    fixed: Counter = Counter()
    lengths = sorted(count)
    again = True
    while again:
        again = False
        for top in lengths[::-1]:
            while count.get(top) and (mates := dominating_set(top, lengths, count, capacity)) is not None:
                use = Counter((top, *mates))
                times = min(count[x] // k for x, k in use.items())
                fixed[tuple(sorted(use.items(), reverse=True))] += times
                for x, k in use.items():
                    count[x] -= k * times
                    if not count[x]:
                        del count[x]
                        lengths.remove(x)
                again = True
    return fixed


def best_fit(count: dict[int, int], capacity: int) -> Counter:
    """Largest first, each item into the fullest sequence that has room; equal items and sequences go together."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[tuple, int]]] = {}

    def put(room: int, pattern: tuple, n: int) -> None:
        if n:
            if room not in bins:
                insort(rooms, room)
                bins[room] = []
            bins[room].append((pattern, n))

    for x in sorted(count, reverse=True):
        n = count[x]
        while n:
            k = bisect_left(rooms, x)
            if k == len(rooms):
                room, pattern, have = capacity, (), n
            else:
                room = rooms[k]
                pattern, have = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[k]
            each = room // x
            full = min(have, n // each)
            put(room - each * x, (*pattern, (x, each)), full)
            n, have = n - full * each, have - full
            if have and n:
                put(room - n * x, (*pattern, (x, n)), 1)
                n, have = 0, have - 1
            if pattern:
                put(room, pattern, have)
    packed: Counter = Counter()
    for own in bins.values():
        for pattern, n in own:
            packed[pattern] += n
    return packed


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how many), ...) with their number of sequences, for the counts of each length."""
    count = {x: n for x, n in histogram.items() if n > 0}
    fixed = fix_dominating(count, capacity)
    return sorted((fixed + best_fit(count, capacity)).items(), reverse=True)


def slots(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """Rows (length, first number, copies a sequence, first sequence, first offset), sorted by the first two."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, times in plan:
        offset = 0
        for x, k in pattern:
            rows.append((x, used[x], k, sequence, offset))
            used[x] += k * times
            offset += x * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- all pieces


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``number``, counting from 0 within each length, without bringing a length into one task."""
    width = shuffle_width(pieces.sparkSession)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(width)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("own", F.row_number().over(own))
    return ranked.join(offsets, ["length", "salt"]).withColumn("number", F.col("before") + F.col("own") - 1)


def few(pieces: DataFrame) -> DataFrame:
    """Fewer partitions of piece rows, which are a thirtieth of the texts that the session's width is meant for.

    A file of some hundred rows costs more than its rows: each one that a task writes starts processes (``chmod``) on
    file systems without Hadoop's native library.
    """
    session = pieces.sparkSession
    return pieces.coalesce(max(session.sparkContext.defaultParallelism, shuffle_width(session) // MERGED))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; the driver only sees the histogram of at most ``capacity`` rows."""
    cut = token_pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    pieces = cut_lineage(cut)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan_bins(histogram, capacity))
    kind = "sequence_id long, offset long"

    @F.pandas_udf(kind)
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        wide = np.int64(1 << 48)
        x, k = length.to_numpy(np.int64), number.to_numpy(np.int64)
        own = table[np.searchsorted(table[:, 0] * wide + table[:, 1], x * wide + k, side="right") - 1]
        k = k - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 3] + k // own[:, 2], "offset": own[:, 4] + k % own[:, 2] * x})

    placed = few(numbered(pieces)).withColumn("at", place("length", "number"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
