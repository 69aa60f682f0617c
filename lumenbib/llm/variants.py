"""Spelling variants of the words of a corpus (method: bit-sliced position index).

Words are counted by Spark with pre-aggregation. Two words differ by one inserted, deleted or replaced character only if
the first half of the shorter one, or the rest of it, stands unchanged at the same end of the other: every word
is entered under both halves, as the shorter and as the longer word of a pair, and the words of an entry meet in a
group (large entries are dealt out as pairs of tiles). A group is indexed by bitsets over its words, one per (position,
letter); a word is looked up in all of them at once: four bitsets hold the words without an error so far and those
with one letter replaced, added or left out, the latter two against positions shifted by one. Words of a group are
numbered by falling count, so the lowest bit of a result is the best form. Only counts and the best form leave a task.

Definitions: runs of ``RUN`` in the texts, A-Z lower-cased. With ``planted`` a run whose crc32 with its document's id is
divisible by that number loses one character. Words have at least ``least`` characters and occurrences. The form
of a word is its near word of largest count (ties: smallest in code-point order) if that is at least ``factor`` times
the word's own; the root is what forms lead to. Counts grow along forms, so they end.

Null and empty texts have no words; a null id counts as an empty one; repeated rows count again; columns other than id
and text are not looked at; an empty table gives an empty table. A word may be as long as its text.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenbib.llm.tiles import TILE, tile_groups
from lumenbib.session import cut_lineage, shuffle_width, spread

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_CHARS, LEAST_TIMES, FACTOR, PLANTED = 5, 3, 2, 97


def word_counts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    least_times: int = LEAST_TIMES,
    planted: int | None = None,
) -> DataFrame:
    """(word, n): words with their occurrences in all texts."""
    runs = F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    rows = rows.select("id", word.alias("word"))
    if planted:
        mark = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        rows = rows.select("word", mark.alias("mark"))
        at = F.pmod("mark", F.char_length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        rows = rows.select(F.when(F.col("mark") % planted == 0, shorter).otherwise(F.col("word")).alias("word"))
    rows = rows.filter(F.char_length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_times)


def _entries(words: DataFrame) -> DataFrame:
    """(word, n, short, half, key): a pair of near words shares an entry of the shorter one's length ``short``."""

    def parts(short: Column) -> list[Column]:
        half, size = F.floor(short / 2).cast("int"), F.char_length("word")
        first = F.struct(short.alias("short"), F.lit(0).alias("half"), F.substr("word", F.lit(1), half).alias("part"))
        rest = F.substr("word", size - (short - half) + 1)
        return [first, F.struct(short.alias("short"), F.lit(1).alias("half"), rest.alias("part"))]

    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(*parts(size), *parts(size - 1))).alias("e"))
    return rows.select("word", "n", "e.short", "e.half", F.xxhash64("e.short", "e.half", "e.part").alias("key"))


class Index:
    """Bitsets of words by position and letter; bit i stands for word i."""

    def __init__(self, words: list[str], short: int, side: int):
        self.short, self.side, self.half = short, side, short // 2
        self.all = (1 << len(words)) - 1
        self.at: dict[tuple[int, str], int] = defaultdict(int)
        self.size: dict[int, int] = defaultdict(int)
        self.first: dict[str, int] = defaultdict(int)
        for i, w in enumerate(words):
            bit = 1 << i
            for key in enumerate(w):
                self.at[key] |= bit
            self.size[len(w)] |= bit
            self.first[w[: self.half]] |= bit

    def near(self, word: str) -> int:
        """Words of the group with exactly one error against ``word``, if their pair belongs to this entry."""
        at = self.at.get
        none = added = self.all  # ``added``: one more letter already, whichever it is
        replaced = left_out = 0
        for i, c in enumerate(word):
            here = at((i, c), 0)
            left_out = left_out & at((i - 1, c), 0) | none
            replaced = replaced & here | none & ~here
            none &= here
            added = added & at((i + 1, c), 0) | none
            if not (none or replaced or added or left_out):
                return 0
        size = len(word)
        if size == self.short:
            found = replaced & self.size.get(size, 0) | added & self.size.get(size + 1, 0)
        else:
            found = left_out & self.size.get(self.short, 0)
        same = self.first.get(word[: self.half], 0)
        return found & ~same if self.side else found & same  # a pair with an equal first half belongs there


def _look_up(rows: list[tuple[str, int, int, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Per word of a group (word, n, short, half, tile) with near words there: how many, and the best of them."""
    entries: dict[tuple[int, int], list[tuple[str, int, int]]] = defaultdict(list)
    for word, n, short, half, tile in rows:
        entries[short, half].append((word, n, tile))
    for (short, half), own in entries.items():
        if len(own) < 2:
            continue
        own.sort(key=lambda x: (-x[1], x[0]))
        index = Index([x[0] for x in own], short, half)
        members: dict[int, int] = defaultdict(int)
        for i, x in enumerate(own):
            members[x[2]] |= 1 << i
        for word, _, tile in own:
            found = index.near(word) & (members[3 - tile] if tile else members[0])
            if found:
                best = own[(found & -found).bit_length() - 1]
                yield word, found.bit_count(), best[1], best[0]


FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
FLUSH = 8192


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[str, int, int, str]] = []
    held: list[tuple[str, int, int, int, int]] = []
    last = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "pair", "word", "n", "short", "half", "side")]
        for key, pair, *row in zip(*columns, strict=True):
            if (key, pair) != last:
                if len(held) > 1:
                    out += _look_up(held)
                last, held = (key, pair), []
                if len(out) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)
                    out = []
            held.append(row)
    if len(held) > 1:
        out += _look_up(held)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best): number of near words, and the most frequent of them."""
    groups = tile_groups(_entries(words), F.lit(0), 0, F.xxhash64("word"), tile)
    dealt = groups.repartition(shuffle_width(words.sparkSession), "key", "pair").sortWithinPartitions("key", "pair")
    found = dealt.mapInArrow(_near_pairs, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    sums = found.groupBy("word").agg(F.sum("near").alias("n_near"), first)
    return sums.select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms(word, form)``, where no word leads back to itself.

    Each round replaces a target by the target's target: the rounds follow the logarithm of the longest chain.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = F.coalesce("next", "root").alias("root")
        moved = cut_lineage(now.join(step, "root", "left").select("word", ends, F.col("next").isNotNull().alias("more")))
        now = moved.select("word", "root")
        if moved.filter("more").isEmpty():
            return now


def variants(words: DataFrame, factor: int = FACTOR, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``."""
    words = cut_lineage(words.select("word", "n"))
    near = near_words(spread(words, "word"), tile)
    is_form = F.col("best_n") >= factor * F.col("n")
    rows = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    ))
    known = roots(rows.filter("form is not null"))
    return rows.join(known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
