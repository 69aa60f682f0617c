"""Alignment of two tokenizers and corpus-wide counts of aligned id pairs (method: external spill counting).

Token bytes of both tokenizers cover the same bytes, so the byte offsets where tokens of both end cut a document into
groups, and every (A id, B id) occurrence inside a group is a link. The count of an id pair is the number of documents
that hold it linked. Nothing but compressed runs is counted:

* A task encodes slices of whole documents, each distinct unit (a word behind its blank) of a slice once. The pair-document records of a slice are radix-partitioned by A id, sorted
  with the A id as major key and spilled as one zstd run per radix: the distinct pairs with their number of documents,
  and the records (document, occurrences) behind them.
* The pairs of up to ``FAN_IN`` runs of a radix meet in one task, which merges them with a heap by A id. When the heap
  leaves an A id, all counts of that id are known, hence also its highest: both are streamed back to the runs. More
  runs than that are first merged to longer ones, level by level, and get their counts back down the same way.
* The counts of a slice's runs meet its records again, and give every document its sums.

A frequent id costs one entry a run and partner, not one a document, and no partner list is longer than the other
vocabulary; records of a slice never meet those of another one. A document lies in one slice, however long it is: texts
are encoded in segments, cut where neither tokenizer reaches across.

Texts that are null or empty, or whose joined token bytes of either tokenizer differ from space + text, have no tokens:
zeros and an empty column of groups. Repeated rows, null and repeated ids are documents of their own; ids may have any
type; columns other than id and text are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbib.llm.common import spread_small
from lumenbib.session import cut_lineage, shuffle_width

RADIX = 64
FAN_IN = 256
SLICE_CHARS, SEGMENT, JOINED = 1 << 22, 1 << 16, 1 << 14
WIDE_GROUP = 1 << 10
SPACE = "▁"


def squeeze(values: np.ndarray) -> bytes:
    """Non-negative numbers, byte planes one after another, as a zstd frame."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(frame: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


class Aligner:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(x): x for x in shown}
        byte_of |= {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.b_bytes, crosses = [], False
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.b_bytes.append(piece.replace(SPACE, " ").encode())
                crosses |= SPACE in piece.lstrip(SPACE)
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # Where a blank follows anything but white space a word of A starts, and no piece of B reaches over it: the parts
        # between such blanks, each behind its blank, encode alone as they do in the text.
        self.cut = None if crosses else re.compile(r"(?<=\S) (?!\Z)")
        self.spelled = [b"%d%c" % (i, mark) for mark in b",|;" for i in range(max(self.n_a, self.n_b))]
        self.spelled_size = np.array([len(x) for x in self.spelled], np.int64)
        self.step = max(self.n_a, self.n_b)
        if self.n_a * self.n_b >= 1 << 39:
            raise ValueError("id pairs do not fit beside a document's place")

    def segments(self, text: str) -> Iterator[list[str]]:
        """Units of a text, in lists of bounded length; the blank in front of a unit is left out."""
        start = 0
        while self.cut and len(text) - start > SEGMENT:
            found = self.cut.search(text, start + SEGMENT)
            if not found:
                break
            yield self.cut.split(text[start : found.start()])
            start = found.end()
        yield self.cut.split(text[start:]) if self.cut else [text]

    def _align(self, joined: list[str]) -> tuple[list[bytes], list[np.ndarray], list[np.ndarray]]:
        """Of texts: the bytes both tokenizers must cover, ids of A and of B."""
        want = [f" {t}" for t in joined]
        a = [np.array(x.ids, np.int64) for x in self.a.encode_batch(want, add_special_tokens=False)]
        b = [np.array(x, np.int64) for x in self.b.encode(joined, num_threads=1)]
        return [w.encode() for w in want], a, b

    def _covers(self, want: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        said = b"".join(map(self.b_bytes.__getitem__, b.tolist()))
        return said == want and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want

    def align(self, units: list[str]) -> Iterator[tuple[range, np.ndarray | None, np.ndarray, np.ndarray]]:
        """Units in order, many at once: (their range, where each ends in bytes, A ids, B ids).

        Units whose bytes differ come alone, with None: texts that do not cover their bytes are halved.
        """
        todo, start, size = [], 0, 0
        for i, u in enumerate(units):
            alone = u[-1].isspace()  # a blank behind it would not start a word
            size += len(u) + 1
            if alone and i > start:
                todo.append(range(start, i))
                start = i
            if alone or size > JOINED:
                todo.append(range(start, i + 1))
                start, size = i + 1, 0
        if start < len(units):
            todo.append(range(start, len(units)))
        for k in range(0, len(todo), 16):
            waiting = todo[k : k + 16][::-1]
            texts = [" ".join(units[x.start : x.stop]) for x in waiting]
            known = dict(zip(waiting, zip(*self._align(texts), strict=True), strict=True))
            while waiting:
                own = waiting.pop()
                if own not in known:
                    known[own] = next(zip(*self._align([" ".join(units[own.start : own.stop])]), strict=True))
                want, a, b = known.pop(own)
                if self._covers(want, a, b):
                    ends = np.cumsum([len(u.encode()) + 1 for u in units[own.start : own.stop]])
                    yield own, ends, a, b
                elif len(own) == 1:
                    yield own, None, a, b
                else:
                    half = len(own) // 2
                    waiting += [own[half:], own[:half]]

    def table(self, units: list[str]) -> "Units":
        """Tokens, groups and links of each unit."""
        out = Units(len(units))
        spelled, pairs, each, where = [], [], [], []
        for own, ends, a, b in self.align(units):
            if ends is None:
                out.good[own.start] = False
                spelled.append(b"")
                continue
            k = len(own)
            a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
            both = np.zeros(int(ends[-1]) + 1, np.int8)
            both[a_end] = 1
            both[b_end] += 2
            closed = np.cumsum(both == 3)
            ga, gb = closed[a_end - 1], closed[b_end - 1]
            unit_a, unit_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
            out.sums[own.start : own.stop, 0] = np.bincount(unit_a, minlength=k)
            out.sums[own.start : own.stop, 1] = np.bincount(unit_b, minlength=k)
            out.sums[own.start : own.stop, 2] = np.diff(closed[ends], prepend=0)
            linked, times, unit = self.links(a, b, ga, gb, unit_a)
            out.sums[own.start : own.stop, 3] = np.bincount(unit, weights=times, minlength=k)
            pairs.append(linked)
            each.append(times)
            where.append(unit + own.start)
            spelled += self.spell(a, b, ga, gb, unit_a, unit_b, k)
        out.spelled = spelled
        if pairs:
            unit = np.concatenate(where)
            order = np.argsort(unit, kind="stable")
            out.pairs, out.each = np.concatenate(pairs)[order], np.concatenate(each)[order]
            out.edges = np.searchsorted(unit[order], np.arange(len(units) + 1))
        return out

    def spell(self, a, b, ga, gb, unit_a, unit_b, n: int) -> list[bytes]:
        """Groups of each unit as decimal ids, ``a1,a2|b1;a3|b2;`` with a mark behind each group."""
        # marks: a comma between ids, a bar behind the last A id, a semicolon behind the last B id of a group
        last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        codes = np.concatenate([a + self.step * last_a, b + 2 * self.step * last_b])
        order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        codes = codes[order]
        whole = b"".join(map(self.spelled.__getitem__, codes.tolist()))
        tokens = np.cumsum(np.bincount(unit_a, minlength=n) + np.bincount(unit_b, minlength=n))
        edges = np.concatenate([[0], np.cumsum(self.spelled_size[codes])])[np.concatenate([[0], tokens])].tolist()
        return [whole[i:j] for i, j in zip(edges, edges[1:], strict=False)]

    def links(self, a, b, ga, gb, unit_a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs (a * n_b + b), how often each, and the unit; pairs may come again."""
        n = int(ga[-1]) + 1
        in_a, in_b = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        wide = in_a * in_b > WIDE_GROUP
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        times = np.where(wide[ga], 0, in_b[ga])
        at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        pairs = [np.repeat(a, times) * self.n_b + b[np.repeat(start_b[ga], times) + at]]
        each, unit = [np.ones(len(pairs[0]), np.int64)], [np.repeat(unit_a, times)]
        for g in np.flatnonzero(wide).tolist():  # a long group holds few distinct ids: their products, not its occurrences
            x, nx = np.unique(a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
            pairs.append((x[:, None] * self.n_b + y).ravel())
            each.append((nx[:, None] * ny).ravel())
            unit.append(np.full(len(pairs[-1]), unit_a[start_a[g]]))
        return np.concatenate(pairs), np.concatenate(each), np.concatenate(unit)


class Units:
    """What is known of each unit: sums (A tokens, B tokens, groups, links), its groups spelled out, its links."""

    def __init__(self, n: int):
        self.good = np.ones(n, bool)
        self.sums = np.zeros((n, 4), np.int64)
        self.spelled: list[bytes] = []
        self.pairs, self.each, self.edges = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)


@functools.lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _summed(keys: list[np.ndarray], each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(each)
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(n[order], heads) if len(key) else n


class Slice:
    """Documents whose records are spilled together; a unit that comes again is encoded once."""

    def __init__(self, own: Aligner):
        self.own, self.chars, self.held = own, 0, 0
        self.keys: list[np.ndarray] = []
        self.each: list[np.ndarray] = []
        self.known: dict[str, int] = {}
        self.waiting: list[tuple[int, np.ndarray]] = []
        self.queued = 0
        self.sums: list[list | None] = []  # per document: n_a, n_b, n_groups, n_links, digest; None without tokens

    def add(self, text: str) -> None:
        place = len(self.sums)
        self.sums.append([0, 0, 0, 0, hashlib.sha256(), b""] if text else None)
        self.chars += len(text)
        for units in self.own.segments(text) if text else ():
            number = self.known.setdefault
            self.waiting.append((place, np.array([number(u, len(self.known)) for u in units], np.int64)))
            self.queued += sum(map(len, units)) + len(units)
            if self.queued > SLICE_CHARS:
                self.work()

    def work(self) -> None:
        waiting, units = self.waiting, self.own.table(list(self.known))
        self.waiting, self.known, self.queued = [], {}, 0
        if not waiting:
            return
        for place, own in waiting:
            row = self.sums[place]
            if row is None:
                continue
            if not units.good[own].all():
                self.sums[place] = None
                continue
            spelled = row[5] + b"".join(map(units.spelled.__getitem__, own.tolist()))
            row[4].update(spelled[:-1])
            row[5] = spelled[-1:]  # the mark behind the last group waits for the next units
            for i, n in enumerate(units.sums[own].sum(axis=0).tolist()):
                row[i] += n
        places = np.repeat([p for p, _ in waiting], [len(x) for _, x in waiting])
        n = len(units.good)
        held, times = np.unique(places * n + np.concatenate([x for _, x in waiting]), return_counts=True)
        place, unit = held // n, held % n
        first, width = units.edges[unit], np.diff(units.edges)[unit]
        at = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        self.keys.append(units.pairs[at] << 24 | np.repeat(place, width))
        self.each.append(units.each[at] * np.repeat(times, width))
        self.held += len(at)
        if self.held > 1 << 21:
            self.reduce()

    def reduce(self) -> None:
        if self.keys:
            key, n = _summed(self.keys, self.each)
            self.keys, self.each, self.held = [key], [n], 0

    def runs(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(radix, distinct pairs, documents of each, record documents, record occurrences), pairs ascending."""
        self.work()
        if not self.keys:
            return
        key, n = _summed(self.keys, self.each)
        alive = np.array([s is not None for s in self.sums])
        kept = alive[key & 0xFFFFFF]  # a later segment can show that a document has no tokens
        key, n = key[kept], n[kept]
        radix = (key >> 24) // self.own.n_b % RADIX
        order = np.argsort(radix, kind="stable")
        key, n, radix = key[order], n[order], radix[order]
        edges = np.searchsorted(radix, np.arange(RADIX + 1)).tolist()
        for r, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
            if i < j:
                pair, docs = np.unique(key[i:j] >> 24, return_counts=True)
                yield r, squeeze(pair), squeeze(docs), squeeze(key[i:j] & 0xFFFFFF), squeeze(n[i:j])


RUN = "pairs binary, documents binary, places binary, times binary"
SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def spilled(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str, text: str, slice_chars: int) -> DataFrame:
    """One row a document (slice, place, id and sums) and one a run (slice, radix and its frames)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = spread_small(docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text")))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"slice long, place int, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, {RUN}"

    def spill(own: Slice, ids: list, number: int) -> Iterator[pa.RecordBatch]:
        runs = list(own.runs())
        n, k = len(own.sums), len(runs)
        sums = np.array([s[:4] if s else [0] * 4 for s in own.sums], np.int64).reshape(n, 4)
        held = ids[0] if len(ids) == 1 else pa.concat_arrays(ids)
        digests = [s[4].hexdigest() if s else "" for s in own.sums]
        documents = [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), held]
        documents += [pa.array(sums[:, i]) for i in range(4)] + [pa.array(digests, pa.string())]
        documents += [pa.nulls(n, pa.int32())] + [pa.nulls(n, pa.binary())] * 4
        names = ["slice", "place", "doc_id", *SUMS, "groups_sha256", "radix", "pairs", "documents", "places", "times"]
        yield pa.RecordBatch.from_arrays(documents, names)
        if runs:
            empty = [pa.nulls(k, pa.int64())] * 4 + [pa.nulls(k, pa.string())]
            frames = [pa.array([r[0] for r in runs], pa.int32())]
            frames += [pa.array([r[i] for r in runs], pa.binary()) for i in range(1, 5)]
            first = [pa.array([number] * k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, held.type)]
            yield pa.RecordBatch.from_arrays(first + empty + frames, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(byte_path, piece_path)
        number, own, ids = TaskContext.get().partitionId() << 32, Slice(tools), []
        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column("text")):
                own.add(value.as_py())
                if own.chars >= slice_chars or len(own.sums) >= 1 << 16:
                    ids.append(batch.column("doc_id").slice(start, i + 1 - start))
                    yield from spill(own, ids, number)
                    number, own, ids, start = number + 1, Slice(tools), [], i + 1
            if start < batch.num_rows:
                ids.append(batch.column("doc_id").slice(start))
        if ids:
            yield from spill(own, ids, number)

    return rows.mapInArrow(run, schema)


# ---------------------------------------------------------------- merging


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Merges runs (pairs ascending, documents of each) by a heap of A ids; yields A id by A id.

    Each step gives the distinct pairs, their counts, whether a count is the highest of the A id, and per run that takes
    part (run, from, to, places of its entries among the pairs).
    """
    cuts = []
    for pairs, _ in runs:
        major = pairs // n_b
        heads = np.flatnonzero(np.concatenate([[True], major[1:] != major[:-1]])) if len(major) else np.zeros(0, np.int64)
        cuts.append((major[heads].tolist(), [*heads.tolist(), len(major)]))
    heap = [(own[0], r, 0) for r, (own, _) in enumerate(cuts) if own]
    heapq.heapify(heap)
    while heap:
        a, parts = heap[0][0], []
        while heap and heap[0][0] == a:
            _, r, k = heap[0]
            ids, edges = cuts[r]
            parts.append((r, edges[k], edges[k + 1]))
            if k + 1 < len(ids):
                heapq.heapreplace(heap, (ids[k + 1], r, k + 1))
            else:
                heapq.heappop(heap)
        if len(parts) == 1:
            r, i, j = parts[0]
            pairs, counts, back = runs[r][0][i:j], runs[r][1][i:j], [(r, i, j, slice(None))]
        else:
            every = np.concatenate([runs[r][0][i:j] for r, i, j in parts])
            pairs, at = np.unique(every, return_inverse=True)
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, at, np.concatenate([runs[r][1][i:j] for r, i, j in parts]))
            back, start = [], 0
            for r, i, j in parts:
                back.append((r, i, j, at[start : start + j - i]))
                start += j - i
        yield pairs, counts, counts == counts.max(), back


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by key."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _meet(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys, "slice")


MERGED = pa.schema([("slice", pa.int64()), ("radix", pa.int32()), ("pairs", pa.binary()), ("documents", pa.binary())])
COUNTED = pa.schema([("slice", pa.int64()), ("radix", pa.int32()), ("counts", pa.binary()), ("best", pa.binary())])


def _merged_up(runs: DataFrame, n_b: int) -> DataFrame:
    """One longer run for the runs of a radix that share a parent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, parent), rows in _grouped(batches, ["radix", "parent"]):
            own = [(expand(x["pairs"]), expand(x["documents"])) for x in rows]
            pairs, counts = (np.concatenate(x) for x in zip(*((p, c) for p, c, _, _ in merge_runs(own, n_b)), strict=True))
            row = {"slice": parent, "radix": radix, "pairs": squeeze(pairs), "documents": squeeze(counts)}
            yield pa.RecordBatch.from_pylist([row], MERGED)

    return _meet(runs, "radix", "parent").mapInArrow(work, "slice long, radix int, pairs binary, documents binary")


def _streamed_back(runs: DataFrame, n_b: int) -> DataFrame:
    """Counts of all runs of a radix in one merge, back in the order of each run's pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix,), rows in _grouped(batches, ["radix"]):
            own = [(expand(x["pairs"]), expand(x["documents"])) for x in rows]
            counts = [np.zeros(len(p), np.int64) for p, _ in own]
            best = [np.zeros(len(p), bool) for p, _ in own]
            for _, found, top, back in merge_runs(own, n_b):
                for r, i, j, at in back:
                    counts[r][i:j], best[r][i:j] = found[at], top[at]
            for row, c, b in zip(rows, counts, best, strict=True):
                out = {"slice": row["slice"], "radix": radix, "counts": squeeze(c), "best": squeeze(b)}
                yield pa.RecordBatch.from_pylist([out], COUNTED)

    return _meet(runs, "radix").mapInArrow(work, "slice long, radix int, counts binary, best binary")


def _handed_down(runs: DataFrame, parents: DataFrame, counted: DataFrame) -> DataFrame:
    """Counts of ``parents`` reach the runs they were merged from."""
    above = parents.select("slice", "radix", "pairs").join(counted, ["slice", "radix"]).withColumnRenamed("slice", "parent")
    above = above.select("radix", "parent", F.lit(-1).cast("long").alias("slice"), "pairs", "counts", "best")
    none = F.lit(None).cast("binary")
    below = runs.select("radix", "parent", "slice", "pairs", none.alias("counts"), none.alias("best"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (radix, _), rows in _grouped(batches, ["radix", "parent"]):
            pairs, counts, best = (expand(rows[0][c]) for c in ("pairs", "counts", "best"))
            for row in rows[1:]:
                at = np.searchsorted(pairs, expand(row["pairs"]))
                out = {"slice": row["slice"], "radix": radix, "counts": squeeze(counts[at]), "best": squeeze(best[at])}
                yield pa.RecordBatch.from_pylist([out], COUNTED)

    return _meet(above.unionByName(below), "radix", "parent").mapInArrow(work, "slice long, radix int, counts binary, best binary")


def counted_runs(runs: DataFrame, n_b: int, fan_in: int = FAN_IN) -> DataFrame:
    """(slice, radix, counts, best) for ``runs(slice, radix, pairs, documents)``."""
    levels, now = [], runs
    while (most := now.groupBy("radix").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        parents = -(-2 * most // fan_in)  # by hash, so filled to about a half
        now = now.withColumn("parent", F.pmod(F.xxhash64("slice"), F.lit(parents)))
        levels.append(now)
        now = cut_lineage(_merged_up(now, n_b))
    counted = _streamed_back(now, n_b)
    for level in levels[::-1]:
        counted = _handed_down(level, now, counted)
        now = level
    return counted


def document_sums(records: DataFrame, counted: DataFrame) -> DataFrame:
    """(slice, place, n_best, count_sum) of every document with links; a slice's runs meet their counts."""
    none = F.lit(None).cast("binary")
    held = records.select("slice", "radix", F.lit(0).alias("side"), "documents", "places", "times")
    found = counted.select("slice", "radix", F.lit(1).alias("side"), F.col("counts").alias("documents"), F.col("best").alias("places"), none.alias("times"))
    rows = held.unionByName(found)
    rows = rows.repartition(shuffle_width(rows.sparkSession), "slice").sortWithinPartitions("slice", "radix", "side")
    kind = pa.schema([("slice", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def done(number: int, best: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(total)
        columns = [np.full(len(own), number), own.astype(np.int32), best[own], total[own]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best, total, last = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != number:
                    if number is not None:
                        yield done(number, best, total)
                    number, best, total = row["slice"], np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
                if row["side"] == 0:
                    last = row
                    continue
                each = expand(last["documents"])
                counts, tops = np.repeat(expand(row["documents"]), each), np.repeat(expand(row["places"]), each)
                place, times = expand(last["places"]), expand(last["times"])
                np.add.at(total, place, times * counts)
                np.add.at(best, place, times * tops)
        if number is not None:
            yield done(number, best, total)

    return rows.mapInArrow(work, "slice long, place int, n_best long, count_sum long")


def align(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    slice_chars: int = SLICE_CHARS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Per document its tokens, groups and links, and what its links count in the whole corpus."""
    n_b = aligner(byte_path, piece_path).n_b
    table = cut_lineage(spilled(docs, byte_path, piece_path, doc_id, text, slice_chars))
    records = table.filter("radix is not null")
    counted = counted_runs(records.select("slice", "radix", "pairs", "documents"), n_b, fan_in)
    rows = table.filter("radix is null").select("slice", "place", "doc_id", *SUMS, "groups_sha256")
    rows = rows.join(document_sums(records, counted), ["slice", "place"], "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return rows.select("doc_id", *SUMS, *zero, "groups_sha256")
