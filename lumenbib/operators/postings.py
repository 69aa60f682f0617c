"""Positional index over paper texts: ``(token, paper, places)``, words and Chinese characters alike.

A blank-separated word without Han characters is one token. In a word with Han characters every run of one to
eight of them is a token, and so are the runs of other characters between them. A phrase asks for its Han runs of up to eight
characters whole and for longer ones by eight, side by side and flush with the run's end, so that few places answer even
where the text has few different characters. Wanted tokens are looked up inside the texts; no text is spelled out into
all of its tokens unless more are wanted than a task can hold. A place is the number
of the word in the text, the characters in front of the token in its word, and those from its start to the word's end.
Phrases are settled by arithmetic on places: words must follow one another whole, a Han run may stand anywhere
inside a longer one. Only tokens that some query asks for are kept, and texts do not travel.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenbib.functions.text import let, non_blank, normalize_title
from lumenbib.session import cut_lineage

SPOTS = "array<struct<w:int,c:int,e:int>>"
SALT_ROWS = 100_000  # postings of a token that one task takes
BROADCAST_TOKENS = 200_000  # some 20 MB
BROADCAST_QUERIES = 50_000  # some 50 MB


# The ranges of Han characters.
HAN_RANGES = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
HAN_SIZES = list(range(1, 9))  # characters of a token
HAN = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in HAN_RANGES) + "]"


def _is_han(character: Column) -> Column:
    code = F.ascii(character)
    ranges = [code.between(a, b) for a, b in HAN_RANGES]
    return F.coalesce(ranges[0] | ranges[1] | ranges[2] | ranges[3], F.lit(False))


def _holds_han(text: Column) -> Column:
    return F.coalesce(text.rlike(HAN), F.lit(False))


def _characters(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def _run_at(word: Column, i: Column) -> Column:
    return F.regexp_extract(F.substr(word, i + 1), "^[^" + HAN[1:-1] + "]+", 0)


def word_tokens(word: Column, sizes: list[int]) -> Column:
    """All tokens of a word, those of Han characters in ``sizes``: ``array<struct<token, c, e>>``."""

    def token(t: Column, i: Column, n: Column) -> Column:
        return F.struct(t.alias("token"), i.cast("int").alias("c"), (n - i).cast("int").alias("e"))

    def grams(cs: Column, i: Column) -> Column:
        own = [let(F.slice(cs, i + 1, g), lambda x: F.when((F.size(x) == g) & F.forall(x, _is_han), F.array_join(x, ""))) for g in sizes]  # noqa: B023
        return F.transform(F.filter(F.array(*own), lambda t: t.isNotNull()), lambda t: token(t, i, F.size(cs)))

    def at(cs: Column, c: Column, i: Column) -> Column:
        none = F.array().cast("array<struct<token:string,c:int,e:int>>")
        run_starts = (i == 0) | _is_han(F.get(cs, i - 1))
        return (
            F.when(_is_han(c), grams(cs, i) if sizes else none)
            .when(run_starts, F.array(token(_run_at(word, i), i, F.size(cs))))
            .otherwise(none)
        )

    split = let(_characters(word), lambda cs: F.flatten(F.transform(cs, lambda c, i: at(cs, c, i))))
    return F.when(_holds_han(word), split).otherwise(F.array(token(word, F.lit(0), F.length(word))))


def han_tokens(words: DataFrame, columns: list[str], sizes: list[int]) -> DataFrame:
    """``word_tokens`` of words of Han characters alone: a size's tokens in as many turns, each beginning one further."""
    turns = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(k).alias("k")) for g in sizes for k in range(g)])
    rows = words.select(*columns, "word", F.length("word").alias("size"), F.inline(turns)).filter("size >= g + k")
    rest = F.substr("word", F.col("k") + 1)
    cut = F.coalesce(*[F.when(F.col("g") == g, F.regexp_extract_all(rest, F.lit(f"(?s).{{{g}}}"), F.lit(0))) for g in sizes])
    rows = rows.select(*columns, "size", "g", "k", F.posexplode(cut).alias("i", "token"))
    rows = rows.select(*columns, "token", "size", (F.col("i") * F.col("g") + F.col("k")).cast("int").alias("c"))
    return rows.select(*columns, "token", "c", (F.col("size") - F.col("c")).alias("e"))


RUNS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in HAN_RANGES) + "]+")


class Wanted:
    """Tokens to look up in words with Han characters: longer ones of Han characters by their first two."""

    def __init__(self, tokens: list[str]):
        self.whole = set(tokens)
        self.singles = {t for t in tokens if len(t) == 1}
        self.longer: dict[str, list[str]] = {}
        for t in tokens:
            if len(t) > 1:
                self.longer.setdefault(t[:2], []).append(t)

    def places(self, word: str) -> Iterator[tuple[str, int, int]]:
        """``(token, c, e)`` as in ``word_tokens``."""
        end, size = 0, len(word)
        for run in RUNS.finditer(word):
            if end < run.start() and word[end : run.start()] in self.whole:
                yield word[end : run.start()], end, size - end
            own, start, end = run[0], run.start(), run.end()
            if self.singles:
                for i, c in enumerate(own):
                    if c in self.singles:
                        yield c, start + i, size - start - i
            for i in range(len(own) - 1):
                for t in self.longer.get(own[i : i + 2], ()):
                    if own.startswith(t, i):
                        yield t, start + i, size - start - i
        if end < size and word[end:] in self.whole:
            yield word[end:], end, size - end


    def in_text(self, text: str) -> dict[str, list[tuple[int, int, int]]]:
        """``(w, c, e)`` of every token in a normalised text, in text order."""
        found: dict[str, list[tuple[int, int, int]]] = {}
        if RUNS.search(text):
            for w, word in enumerate(text.split(" ")):
                for token, c, e in self.places(word):
                    found.setdefault(token, []).append((w, c, e))
        else:
            for w, word in enumerate(text.split(" ")):
                if word in self.whole:
                    found.setdefault(word, []).append((w, 0, len(word)))
        return found


FOUND = T.MapType(T.StringType(), T.StructType().add("first", T.IntegerType()).add("spots", T.ArrayType(T.StructType().add("w", T.IntegerType()).add("c", T.IntegerType()).add("e", T.IntegerType()))))


def held_tokens(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per paper: its source, year and numbers of words, and ``found``, a map of the tokens of
    ``wanted(token, spots_needed)`` that it holds to their first place and to all places where they are needed.

    The tokens are looked up inside the texts; the texts are not spelled out into rows, and nothing is shuffled.
    """
    shared = papers.sparkSession.sparkContext.broadcast({r["token"]: r["spots_needed"] for r in wanted.collect()})

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        needed = shared.value
        own = Wanted(list(needed))
        for batch in batches:
            tokens, first, ends, spot_ends = [], array("i"), array("i", [0]), array("i", [0])
            spots = tuple(array("i") for _ in "wce")
            for text in batch.to_pylist():
                for token, places in own.in_text(text).items():
                    tokens.append(token)
                    first.append(places[0][0])
                    if needed[token]:
                        for column, values in zip(spots, zip(*places)):
                            column.extend(values)
                    spot_ends.append(len(spots[0]))
                ends.append(len(tokens))
            numbers = [pa.array(x, pa.int32()) for x in (first, ends, spot_ends, *spots)]
            lists = pa.ListArray.from_arrays(numbers[2], pa.StructArray.from_arrays(numbers[3:], ["w", "c", "e"]))
            values = pa.StructArray.from_arrays([numbers[0], lists], ["first", "spots"])
            yield pa.MapArray.from_arrays(numbers[1], pa.array(tokens, pa.string()), values)

    # A filter on what is found would look it up twice; papers that hold none of the tokens are empty maps.
    return cut_lineage(paper_texts(papers).select(*PAPER, find("text").alias("found")))


def phrase(text: Column) -> Column:
    """What a normalised phrase asks for: ``struct<n_words, tokens: array<struct<token, j, off, size>>>``."""
    kind = "array<struct<token:string,j:int,off:int,size:int>>"

    def token(t: Column, j: Column, i: Column, n: Column) -> Column:
        return F.struct(
            t.alias("token"), j.cast("int").alias("j"), i.cast("int").alias("off"), n.cast("int").alias("size")
        )

    def covered(run: Column, i: Column, j: Column, n: Column) -> Column:
        size = F.length(run)
        g = F.coalesce(*[F.when(size >= k, k) for k in reversed(HAN_SIZES)])
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), size - g, g), F.array(size - g)))
        return F.transform(starts, lambda k: token(F.substr(run, k + 1, g), j, i + k, n))

    def at(word: Column, cs: Column, c: Column, i: Column, j: Column) -> Column:
        before, n = F.get(cs, i - 1), F.size(cs)
        run = F.regexp_extract(F.substr(word, i + 1), f"^{HAN}+", 0)
        return (
            F.when(_is_han(c) & ~_is_han(before), covered(run, i, j, n))
            .when(~_is_han(c) & ((i == 0) | _is_han(before)), F.array(token(_run_at(word, i), j, i, n)))
            .otherwise(F.array().cast(kind))
        )

    def of_word(word: Column, j: Column) -> Column:
        split = let(_characters(word), lambda cs: F.flatten(F.transform(cs, lambda c, i: at(word, cs, c, i, j))))
        return F.when(_holds_han(word), split).otherwise(F.array(token(word, j, F.lit(0), F.length(word))))

    words = F.split(text, " ")
    return F.struct(F.size(words).alias("n_words"), F.flatten(F.transform(words, of_word)).alias("tokens"))


def last_word(p: Column, found: Column) -> Column:
    """Number of the last word of a phrase's first occurrence; null where it does not occur.

    ``found`` maps a token to ``struct<first, spots>``; a phrase of one token only needs the first.
    """
    many = p["n_words"] > 1

    def starts(t: Column) -> Column:
        spots = F.coalesce(F.element_at(found, t["token"])["spots"], F.array().cast(SPOTS))
        kept = F.filter(
            spots,
            lambda s: ~many
            | (((t["j"] == 0) | (s["c"] == t["off"])) & ((t["j"] == p["n_words"] - 1) | (s["e"] == t["size"] - t["off"]))),
        )
        inside = F.when(many, F.lit(0)).otherwise(1)
        return F.transform(kept, lambda s: (s["w"] - t["j"]).cast("long") * (1 << 24) + inside * (s["c"] - t["off"]))

    one = F.element_at(found, p["tokens"][0]["token"])["first"]
    rest = F.slice(p["tokens"], 2, F.size(p["tokens"]))
    common = F.aggregate(rest, starts(p["tokens"][0]), lambda acc, t: F.array_intersect(acc, starts(t)))
    several = F.floor(F.array_min(common) / (1 << 24)).cast("int") + p["n_words"] - 1
    return F.when(F.size(p["tokens"]) == 1, one).otherwise(several)


PAPER = ["seq", "source_database", "year", "title_words", "both_words"]


def paper_texts(papers: DataFrame) -> DataFrame:
    """Normalised text of title, abstract and keywords, whether it ``has_han``, and how many words the title and the
    title with abstract have."""
    title = F.coalesce("title", F.lit(""))
    keywords = F.array_join(non_blank("keywords"), " ")
    whole = F.concat_ws(" ", title, F.coalesce("abstract", F.lit("")), keywords)

    def count(normal: Column) -> Column:
        return F.when(normal == "", 0).otherwise(F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1)

    texts = papers.select(
        "seq",
        "source_database",
        "year",
        count(normalize_title(title)).alias("title_words"),
        count(normalize_title(keywords)).alias("keyword_words"),
        _holds_han(whole).alias("han"),  # behind the explode it would be asked again for every word
        normalize_title(whole).alias("text"),
    )
    return texts.select("seq", "source_database", "year", "title_words", (count(F.col("text")) - F.col("keyword_words")).alias("both_words"), "han", "text")


def postings(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per token of ``wanted(token, spots_needed)`` and paper: its first place, and all where they are needed.

    Beside it the paper's source, year, and how many words its title and its title with abstract have. For more tokens
    than a task can hold: texts are spelled out, both sides are dealt out by token.
    """
    paper, texts = PAPER, paper_texts(papers)
    bare = texts.filter(~F.col("han")).select(*paper, F.posexplode(F.split("text", " ")).alias("w", "token"))
    plain = bare.select(*paper, "w", "token", F.lit(0).alias("c"), F.length("token").alias("e"))
    held = plain.unionByName(_of_han_texts(texts.filter("han"), paper, wanted)).join(wanted, "token")
    # Places are gathered for phrases alone: lists of many small groups are sorted, a least number is hashed.
    found = held.groupBy("token", *paper)
    least, spot = F.min("w").alias("first"), F.struct("w", "c", "e")
    if wanted.filter("spots_needed").isEmpty():
        return cut_lineage(found.agg(least).withColumn("spots", F.array().cast(SPOTS)))
    return cut_lineage(found.agg(least, F.collect_list(F.when(F.col("spots_needed"), spot)).alias("spots")))


def _of_han_texts(texts: DataFrame, paper: list[str], wanted: DataFrame) -> DataFrame:
    """Tokens of texts with Han characters, at least the wanted ones: ``(*paper, w, token, c, e)``."""
    han_sizes = wanted.filter(F.col("token").rlike(f"^{HAN}+$")).select(F.length("token").alias("n")).distinct()
    sizes = sorted(r["n"] for r in han_sizes.collect())  # some of HAN_SIZES
    # A word of nothing else needs no lists of structs.
    words = texts.select(*paper, F.posexplode(F.split("text", " ")).alias("w", "word"))
    pure = F.col("word").rlike(f"^{HAN}+$")
    mixed = words.filter(~pure).select(*paper, "w", F.inline(word_tokens(F.col("word"), sizes)))
    return mixed.unionByName(han_tokens(words.filter(pure), [*paper, "w"], sizes)) if sizes else mixed


def probe(rare: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``rare(token, df, ...)`` with the papers that hold the token; a frequent token is dealt out by paper."""
    salts = F.floor(F.col("df") / SALT_ROWS).cast("int")
    dealt = rare.withColumn("salts", salts).withColumn("salt", F.explode(F.sequence(F.lit(0), salts)))
    sizes = rare.select("token", salts.alias("salts")).distinct()
    papers = index.select("token", "seq", "source_database").join(sizes, "token")
    papers = papers.withColumn("salt", F.pmod(F.xxhash64("seq"), F.col("salts") + 1).cast("int")).drop("salts")
    return dealt.drop("salts").join(papers, ["token", "salt"]).drop("salt")
