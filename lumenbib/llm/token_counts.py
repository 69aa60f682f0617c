"""Token counts of whole texts (method: overlap resynchronisation).

A text of up to ``chunk`` characters is encoded at once. A longer one is cut into chunks that reach ``overlap`` characters
into the next chunk; chunks are dealt out and encoded with offsets, wherever their document lies. Two neighbouring
chunks are spliced at a place of their overlap where a word of the tokenizer's first split starts in both. Such a
place is proven: the split reads from left to right, looks ahead by a few characters and never behind, and merges
stay inside a word, so from a common start on both chunks go on alike. Places nearer to a cut end than ``margin`` are
not trusted, as the missing characters could change them. With n_k(p) the tokens of chunk k before place p, a seam
adds n_left(p) - n_right(p), the same at every common place; the last chunk adds all its tokens; the sum is the
tokenizer's count of the whole text.

Neighbours without a common place (one word may be longer than any overlap) are bridged: a run of failing seams becomes
one seam between the chunk before the run and the one behind it, whose overlap doubles until a common place is found.
The end of the text always is one.

A text that is encoded at once is cut in front of each blank that a visible character follows: the split begins a word
there whatever stands before, and looks ahead across it for nothing but whether blanks end. So it does with a mark
behind a letter. A task counts each distinct
unit once while it remembers it. Texts with a special token's string are encoded whole, as it ends the split's view.

Null and empty texts have no tokens. Repeated rows, null ids and repeated ids are rows of their own; ids may have any
type; columns other than id and text are not looked at; an empty table gives an empty table. Strings of the special
tokens inside a text are special tokens, as the library has it. Tokenizers without a byte-level split by pattern, or
with a normalizer, are refused: the proof does not cover them.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenbib.llm.common import spread_small
from lumenbib.llm.words import slices
from lumenbib.session import cut_lineage, shuffle_width

CHUNK, OVERLAP = 1 << 15, 512
AHEAD = 4  # characters the split looks at beyond the start of a word: two letters behind an apostrophe, and one
SLICE = 1 << 18
UNITS, UNIT_SIZE = 1 << 19, 64  # units that a task remembers, and their longest


UNIT = re.compile(r" (?=\S)|(?<=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])(?=[.,;:!?)])")


def units(text: str) -> list[str]:
    """``text`` cut in front of each blank that a visible character follows, and of marks behind a letter."""
    cuts = [m.start() for m in UNIT.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]


class Counter:
    """The tokenizer of one file, with the places where its words start."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        parts = json.loads(self.model.to_str())
        split = parts["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        added = parts["added_tokens"]
        if not plain or parts["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("chunks of this tokenizer cannot be proven to splice")
        self.model.no_truncation()
        self.model.no_padding()
        self.model.post_processor = None
        self.special = [t["content"] for t in added]
        self.known: dict[str, int] = {}
        self.margin = AHEAD + max([len(t["content"]) for t in added], default=0)

    def counts(self, texts: list[str]) -> list[int]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [len(x) for x in found]

    def counts_by_units(self, texts: list[str]) -> list[int]:
        """The same, each distinct unit once."""
        if len(self.known) > UNITS:
            self.known = {}
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        apart = set(whole)
        cut = [[] if i in apart else units(t) for i, t in enumerate(texts)]
        known = self.known
        new = list({u for us in cut for u in us if u not in known})
        fresh = dict(zip(new, self.counts(new), strict=True))
        known.update((u, n) for u, n in fresh.items() if len(u) <= UNIT_SIZE)
        if any(len(u) > UNIT_SIZE for u in new):
            out = [sum(known[u] if u in known else fresh[u] for u in us) for us in cut]
        else:
            out = [sum(map(known.__getitem__, us)) for us in cut]
        for i, n in zip(whole, self.counts([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out

    def places(self, text: str, ends: bool) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of tokens; proven starts of words; tokens before each. ``ends``: the text really ends here."""
        found = self.model.encode(text, add_special_tokens=False)
        total = len(found)
        if not total:
            return 0, np.zeros(1, np.int64), np.zeros(1, np.int64)
        words = np.array(found.word_ids, np.int64)
        first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        offsets = found.offsets
        at = np.array([offsets[i][0] for i in first.tolist()], np.int64)
        if ends:
            return total, np.append(at, len(text)), np.append(first, total)
        sure = at <= len(text) - self.margin
        return total, at[sure], first[sure]

    def bridge(self, text: str, left: int, right: int, overlap: int) -> int:
        """Tokens of a scan from ``left`` less those of a scan from ``right``, behind a common place of the two."""
        while True:
            stop = min(len(text), right + overlap)
            _, at, before = self.places(text[left:stop], stop == len(text))
            _, own, own_before = self.places(text[right:stop], stop == len(text))
            _, i, j = np.intersect1d(at + left, own + right, assume_unique=False, return_indices=True)
            if len(i):
                return int(before[i[-1]] - own_before[j[-1]])
            overlap *= 2


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, k, last, piece): piece k starts at k * chunk and reaches ``overlap`` characters into the next."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                n = -(-len(text) // chunk)
                for a in range(0, n, 64):
                    ks = range(a, min(a + 64, n))
                    pieces = [text[k * chunk : (k + 1) * chunk + overlap] for k in ks]
                    yield pd.DataFrame({"row": row, "k": list(ks), "last": [k == n - 1 for k in ks], "ends": [
                        (k + 1) * chunk + overlap >= len(text) for k in ks], "piece": pieces})

    rows = long.select("row", "text").mapInPandas(cut, "row long, k int, last boolean, ends boolean, piece string")
    return rows.repartition(shuffle_width(long.sparkSession), "row", "k")


SCAN = "total long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>"


def _scanned(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Per chunk its tokens and, as places in the document, the starts of words in both overlaps."""

    @F.pandas_udf(SCAN)
    def scan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for ks, ends, pieces in batches:
            rows = []
            for k, end, piece in zip(ks, ends, pieces, strict=True):
                total, at, before = own.places(piece, end)
                head, tail = at <= overlap, at >= chunk
                at = at + k * chunk
                rows.append((total, at[head], before[head], at[tail], before[tail]))
            yield pd.DataFrame(rows, columns=["total", "head", "head_n", "tail", "tail_n"])

    return chunks.select("row", "k", "last", scan("k", "ends", "piece").alias("s")).select("row", "k", "last", "s.*")


def _bridged(long: DataFrame, failed: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n) of runs of failing seams (row, k: between k and k + 1), all of a document together."""
    run = F.col("k") - F.row_number().over(Window.partitionBy("row").orderBy("k"))
    runs = failed.withColumn("run", run).groupBy("row", "run").agg(F.min("k").alias("a"), (F.max("k") + 1).alias("b"))
    spans = runs.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    @F.pandas_udf("long")
    def bridge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts, spans in batches:
            yield pd.Series([
                sum(own.bridge(t, s["a"] * chunk, s["b"] * chunk, 2 * overlap) for s in ss)
                for t, ss in zip(texts, spans, strict=True)
            ], dtype="int64")

    return long.join(spans, "row").select("row", bridge("text", "spans").alias("n"))


def spliced(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of ``long(row, text)``, a table that gives the same rows whenever it is read."""
    parts = cut_lineage(_scanned(_chunks(long, chunk, overlap), path, chunk, overlap))
    left = parts.filter(~F.col("last")).select("row", "k", "tail", "tail_n")
    right = parts.filter("k > 0").select("row", (F.col("k") - 1).alias("k"), "head", "head_n")
    place = F.array_max(F.array_intersect("tail", "head"))
    seams = left.join(right, ["row", "k"]).withColumn("place", place)
    number = lambda n, at: F.element_at(n, F.array_position(at, F.col("place")).cast("int"))
    held = seams.filter("place is not null").select("row", (number("tail_n", "tail") - number("head_n", "head")).alias("n"))
    failed = seams.filter("place is null").select("row", "k")
    ends = parts.filter("last").select("row", F.col("total").alias("n"))
    whole = ends.union(held).union(_bridged(long, failed, path, chunk, overlap))
    return whole.groupBy("row").agg(F.sum("n").alias("n_tokens"))


def token_counts(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens``."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series([n for a, b in slices(texts, SLICE) for n in own.counts_by_units(texts[a:b])], dtype="int64")

    short = spread_small(rows.filter(F.char_length("text") <= chunk)).select("doc_id", n_bytes, count("text").alias("n_tokens"))
    long = rows.filter(F.char_length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    long = cut_lineage(long)  # row numbers must name the same rows in every later read
    counted = long.select("row", "doc_id", n_bytes).join(spliced(long, path, chunk, overlap), "row")
    return short.union(counted.select("doc_id", "n_bytes", "n_tokens"))
