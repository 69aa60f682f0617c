"""Token counts, alignment and spelling variants against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenbib.llm import alignment, token_counts, variants
from lumenbib.llm.queries import vocabulary

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def texts(seed: int, n: int, longest: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "energy", "'re", "'", "s", "12", "3", "\n", "\n\n", "\t", "é", "ß", "中文", "🙂", "á",
             "<|endoftext|>", "<|endo", "ftext|>", "...", "!?", "-", "x" * 9, " ", "▁", "<0x41>", "</s>", "Zug"]
    return ["".join(rng.choices(parts, k=rng.randint(1, longest))) for _ in range(n)]


# ---------------------------------------------------------------- token counts


def library_counts(rows: list[str]) -> list[int]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary(BYTES))
    return [len(model.encode(t, add_special_tokens=False).ids) for t in rows]


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 24), (64, 30), (1000, 200)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    rows = texts(1, 120, 400) + ["a" * 700, " " * 900, "'" * 333, "ab " * 400, "<|endoftext|>" * 60, "s's" * 300, "1" * 50 + "a" * 500 + " b" * 99]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_tokens string")
    got = token_counts.token_counts(docs, vocabulary(BYTES), chunk=chunk, overlap=overlap).collect()
    want = library_counts(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["n_tokens"] for r in got} == dict(enumerate(want))
    assert {r["doc_id"]: r["n_bytes"] for r in got} == {i: len(t.encode()) for i, t in enumerate(rows)}


def test_token_counts_of_odd_rows(spark):
    rows = [(None, "energy " * 50), (None, None), ("7", ""), ("7", "energy " * 50), ("7", "energy " * 50)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = token_counts.token_counts(docs, vocabulary(BYTES), chunk=64, overlap=32).collect()
    n = library_counts(["energy " * 50])[0]
    assert sorted((r[0] or "", r[1], r[2]) for r in got) == [("", 0, 0), ("", 350, n), ("7", 0, 0), ("7", 350, n), ("7", 350, n)]
    assert token_counts.token_counts(docs.limit(0), vocabulary(BYTES)).collect() == []


def test_a_failing_seam_is_bridged(spark):
    own = token_counts.counter(vocabulary(BYTES))
    text = "start " + "a" * 500 + " end of it"
    assert library_counts([text])[0] == own.bridge(text, 0, 100, 8) + own.places(text[100:], True)[0]


def test_tokenizers_without_a_proof_are_refused():
    with pytest.raises(ValueError, match="proven"):
        token_counts.Counter(vocabulary("word_bpe_49k.json"))


# ---------------------------------------------------------------- alignment


def plain_alignment(rows: list[str | None]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(vocabulary(BYTES))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    linked, docs = [], []
    for text in rows:
        if not text:
            docs.append(None)
            continue
        want = f" {text}".encode()
        a, b = a_model.encode(f" {text}", add_special_tokens=False).ids, b_model.encode(text)
        a_bytes = [bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            docs.append(None)
            continue
        groups, i, j, x, y = [], 0, 0, 0, 0
        own_a, own_b = [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                own_a.append(a[i])
                x += len(a_bytes[i])
                i += 1
            else:
                own_b.append(b[j])
                y += len(b_bytes[j])
                j += 1
            if x == y:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        docs.append((a, b, groups))
    for d in docs:
        linked.append(Counter((p, q) for own_a, own_b in d[2] for p in own_a for q in own_b) if d else Counter())
    count = Counter(pair for own in linked for pair in own)
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    out = []
    for d, own in zip(docs, linked, strict=True):
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        spelled = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in d[2])
        best = sum(m for pair, m in own.items() if count[pair] == top[pair[0]])
        out.append((len(d[0]), len(d[1]), len(d[2]), sum(own.values()), best, sum(m * count[p] for p, m in own.items()), hashlib.sha256(spelled.encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("slice_chars", "fan_in"), [(1 << 22, 256), (300, 4)])
def test_alignment_equals_a_plain_version(spark, slice_chars, fan_in):
    rows = texts(2, 60, 40) + ["the energy of the sun"] * 5 + ["▁the", None, "", " ", "a" * 5000, "=-" * 400, "𝄞" * 40, "energy policy " * 20]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id long, text string, slice int")
    got = alignment.align(docs, vocabulary(BYTES), vocabulary(PIECES), slice_chars=slice_chars, fan_in=fan_in).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == dict(enumerate(plain_alignment(rows)))
    assert len(got) == len(rows)


@pytest.mark.parametrize("slice_chars", [1 << 22, 100])
def test_alignment_of_long_texts_in_segments(monkeypatch, slice_chars):
    monkeypatch.setattr(alignment, "SEGMENT", 30)
    monkeypatch.setattr(alignment, "SLICE_CHARS", slice_chars)
    tools = alignment.Aligner(vocabulary(BYTES), vocabulary(PIECES))
    rows = [t for t in texts(3, 40, 300)] + ["Energy policy of the north  and\nof the south " * 30, "energy and policy " * 20 + "▁"]
    own = alignment.Slice(tools)
    for t in rows:
        own.add(t)
    own.work()
    got = [(*s[:4], s[4].hexdigest()) if s else (0, 0, 0, 0, "") for s in own.sums]
    assert got == [(*x[:4], x[6]) for x in plain_alignment(rows)]


def test_alignment_of_odd_tables(spark):
    rows = [(None, "energy"), (None, "energy"), ("k", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = alignment.align(docs, vocabulary(BYTES), vocabulary(PIECES)).collect()
    assert sorted((r["doc_id"] or "", r["n_a"], r["n_best"], r["count_sum"]) for r in got) == [("", 1, 1, 2), ("", 1, 1, 2), ("k", 0, 0, 0)]
    assert alignment.align(docs.limit(0), vocabulary(BYTES), vocabulary(PIECES)).collect() == []


# ---------------------------------------------------------------- spelling variants


def plain_words(rows: list[tuple], planted: int | None) -> dict[str, int]:
    import re

    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if planted and h % planted == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def one_apart(x: str, y: str) -> bool:
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if abs(len(x) - len(y)) != 1:
        return False
    short, long = sorted((x, y), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def invented(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randint(4, 9))) for _ in range(60)] + ["ÀÉêlan", "aaaaa", "aaaaaa", "aaaaaaa", "ababa"]

    def spoiled(w: str) -> str:
        at = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + "d" + w[at + 1 :]])

    rows = [(i, " ".join(spoiled(rng.choice(base)).title() for _ in range(120))) for i in range(60)]
    return [*rows, (None, None), (3, ""), (3, "1 2 3"), (None, "aaaaa " * 4), (9, "z" * 3000)] + [(9, "y" * 3000)] * 3


@pytest.mark.parametrize("tile", [4096, 3])
def test_variants_equal_a_plain_version(spark, tile):
    rows = invented(5)
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")
    words = variants.word_counts(docs, planted=7)
    want = plain_words(rows, 7)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    got = variants.variants(words, tile=tile).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(want)
    assert len(got) == len(want)


def test_forms_lead_on_to_the_root(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "abbbbb": 96, "solitary": 3}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.variants(table).collect()}
    assert got == plain_variants(words)
    assert got["aaaaa"][1] == "abbbbb"


def test_variants_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.word_counts(docs)).filter(F.lit(True)).collect() == []
