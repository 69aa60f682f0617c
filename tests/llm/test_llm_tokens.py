"""Sentence pieces and packing against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lumenbib.llm import packing, sentencepieces
from lumenbib.llm.piece_codec import codec

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "a", "B", "\n", "\t", "é", "漢", "😀", "▁", "the", "ing", "'s", "00", "abc", "́", "!!", "<s>", "aaaa", "H̱", "Σ", "İ", "\x00", " ", "=="]


def random_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_merge_rounds_equal_the_library():
    own, library = codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [*random_texts(1500), "a" * 3000, " " * 2000, "-" * 2000, "=-" * 300, "ab" * 1500]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == [*library.encode(text), 2], text[:50]
        assert own.decode(ids) == library.decode(library.encode(text))


def test_piece_columns(edge_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {(r["doc_id"], r["text"]): r["ids"] for r in sentencepieces.encode(edge_docs.select("doc_id", "text"), PIECES).collect()}
    assert all(ids == [*library.encode(text or ""), 2] for (_, text), ids in rows.items())
    back = sentencepieces.decode(sentencepieces.encode(edge_docs.select("text"), PIECES), PIECES, into="back")
    assert all(r["back"] == (r["text"] or "") for r in back.collect())
    digests = sentencepieces.token_digests(edge_docs, PIECES).collect()
    assert len(digests) == edge_docs.count()
    empty = [r for r in digests if r["doc_id"] == 1][0]
    assert (empty["n_tokens"], empty["ids_sha256"]) == (1, hashlib.sha256(b"2").hexdigest())
    assert sentencepieces.token_digests(no_docs, PIECES).count() == 0


def check_packing(rows, texts, capacity=packing.CAPACITY):
    tokenizer = Tokenizer.from_file(WORDS)
    want = []
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, k, a, len(x := ids[a : a + capacity]), zlib.crc32(x.tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key)
    assert got == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        ends = 0
        for offset, length in sorted(own):
            assert offset == ends
            ends += length
        assert ends <= capacity
    return len(bins)


def test_packing_of_documents(docs):
    rows = packing.pack(docs, WORDS).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert n <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1


def test_packing_of_edge_cases(edge_docs, no_docs):
    check_packing(packing.pack(edge_docs, WORDS).collect(), [(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert packing.pack(no_docs, WORDS).count() == 0


def test_packing_of_many_copies_over_many_partitions_writes_few_files(spark, tmp_path):
    texts = [(i, "the same few words") for i in range(3000)] + [(i, "other words " * (i % 97)) for i in range(3000, 4000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    held = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        packing.pack(docs, WORDS).write.parquet(f"{tmp_path}/packed")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = spark.read.parquet(f"{tmp_path}/packed").collect()
    n = check_packing(rows, texts)
    assert n <= -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1
    assert len(list((tmp_path / "packed").glob("part-*"))) <= 6


def test_tokenizer_words_are_independent():
    tokenizer, known = Tokenizer.from_file(WORDS), packing.word_ids(WORDS)
    texts = random_texts(1500)
    for text, ids in zip(texts, packing.text_ids(texts, known), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def test_ids_over_all_of_unicode():
    tokenizer, known, draw = Tokenizer.from_file(WORDS), packing.word_ids(WORDS), random.Random(11)

    def letter():
        where = draw.choice([(32, 127), (0xA0, 0x250), (0x250, 0xD800), (0xE000, 0x10000), (0x10000, 0x110000)])
        return draw.choice([" ", draw.choice(packing.MARKS), chr(draw.randrange(*where))])

    texts = ["".join(letter() for _ in range(draw.randrange(1, 30))) for _ in range(20000)]
    texts += ["\u0130?", "a\u095a;", "\ufb31;", "\ufb4a, b", "\u0958.", "x\u095f!"]
    for text, ids in zip(texts, packing.text_ids(texts, known), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1], text


def least_bins(items, capacity):
    """Exact number of bins by search."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_plan_covers_the_histogram_and_reduction_is_safe():
    rng = random.Random(5)
    for _ in range(250):
        capacity = rng.randrange(8, 40)
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        histogram = {x: items.count(x) for x in items}
        plan = packing.plan_bins(histogram, capacity)
        used = {}
        for pattern, times in plan:
            assert sum(x * k for x, k in pattern) <= capacity
            for x, k in pattern:
                used[x] = used.get(x, 0) + k * times
        assert used == histogram
        rest = dict(histogram)
        fixed = packing.fix_dominating(rest, capacity)
        left = sorted((x for x, n in rest.items() for _ in range(n)), reverse=True)
        # What is fixed costs nothing: the best packing of the rest makes the best packing of all.
        assert sum(fixed.values()) + (least_bins(left, capacity) if left else 0) == least_bins(items, capacity)


def test_each_unit_of_a_task_is_counted_once_and_sums_equal_the_library():
    import random

    import public_tokenizers
    from lumenbib.llm.token_counts import Counter

    own, draw = Counter(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    blanks = [" ", " ", "  ", "\t", "\n", "\x85", "\xa0", " ", "　", "\x1c", "​"]
    signs = [*"abcXYZ012'.,-é中ßµ²)", "'s", "'ll", "́", "\U0001f600", "<|endoftext|>", "don't", "word", "x" * 70]
    texts = ["".join(draw.choice(blanks if draw.random() < 0.45 else signs) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    want = own.counts(texts)
    assert own.counts_by_units(texts) == want
    seen, plain = [], own.counts
    own.counts = lambda ts: seen.extend(ts) or plain(ts)
    own.known = {}
    again = ["the cat, the dog. the cat"] * 50
    assert own.counts_by_units(again) == plain(again) and len(seen) == len(set(seen)) < 10
