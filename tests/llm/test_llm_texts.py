"""Fingerprints and licence scans against plain versions."""

import hashlib
import random
import re

import pytest

from lumenbib.llm import licenses, merkle


def key_of(row):
    return (row[0] is None, -(row[0] or 0))


def test_trees_locate_edits_and_measure_likeness():
    a = merkle.tree("first line.\nsecond, longer line here.\n\nthird part of it.\nfourth.")
    b = merkle.tree("first line.\nsecond, longer line here.\n\nthird part was changed.\nfourth.")
    assert a.digest == merkle.tree("first line.\nsecond, longer line here.\n\nthird part of it.\nfourth.").digest
    assert a.digest != b.digest
    assert merkle.edited_spans(a, b) == [(39, 18)]
    assert merkle.edited_spans(a, a) == []
    assert 0.5 < merkle.likeness(a, b) < 1
    empty = merkle.tree("")
    assert (merkle.likeness(empty, empty), merkle.likeness(a, empty)) == (1.0, 0.0)
    assert merkle.tree("a\nb").digest != merkle.tree("ab").digest != merkle.tree("a b").digest


def lines(*numbers):
    return "".join(f"paragraph {n} says this, and that too.\n" for n in numbers)


def leaves(text):
    return [p for line in text.splitlines(keepends=True) for p in merkle.PHRASES(line)]


def longest_common(a, b):
    """Most characters of common phrases in order."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], max(row[j + 1], row[j], before + len(x) * (x == y))
    return row[-1]


def test_order_counts_and_moves_are_edits():
    a, moved = merkle.tree("a one. b two. c three."), merkle.tree("c three. a one. b two.")
    assert 0 < merkle.likeness(a, moved) < 1 and merkle.edited_spans(a, moved)
    texts = lines(*range(30)), lines(*range(29, -1, -1))
    there, back = map(merkle.tree, texts)
    assert 0 < merkle.likeness(there, back) < 0.2 and merkle.edited_spans(there, back)
    twice = merkle.tree(lines(*range(30), *range(30)))
    assert sum(n for _, n in merkle.edited_spans(twice, there)) == len(texts[0])
    one = merkle.tree(lines(*range(14), 99, *range(15, 30)))
    assert merkle.edited_spans(one, there) == [(texts[0].index("paragraph 14"), len("paragraph 99 says this,") + 1)]
    assert merkle.likeness(one, there) > 0.97


def test_likeness_against_the_longest_common_phrases():
    """The alignment is in order and made of equal text; edits of distinct phrases are found as well as by all orders."""
    draw = random.Random(8)
    for k in range(60):
        n = draw.randrange(1, 90)
        words = [f"w{x}" for x in (draw.sample(range(400), n) if k % 2 else draw.choices(range(9), k=n))]
        a = "".join(w + draw.choice([". ", ", ", ".\n", "\n\n"]) for w in words)
        parts = leaves(a)
        for _ in range(draw.randrange(6)):
            at = draw.randrange(len(parts) + 1)
            parts[at : at + draw.randrange(3)] = draw.choice([[], ["new thing. "], ["x, ", "y.\n"]])
        b = "".join(parts)
        x, y = merkle.tree(a), merkle.tree(b)
        found = merkle.aligned(x, y)
        assert all(a[p : p + n] == b[q : q + n] for p, q, n in found)
        assert all(p + n <= p2 and q + n <= q2 for (p, q, n), (p2, q2, _) in zip(found, found[1:]))
        most, got = longest_common(leaves(a), leaves(b)), sum(n for _, _, n in found)
        assert got <= most and (k % 2 == 0 or got >= 0.95 * most)
        if a or b:
            assert merkle.likeness(x, y) == (1.0 if a == b else pytest.approx(2 * got / (len(a) + len(b))))


def test_clashing_names(spark):
    rows = spark.createDataFrame([("a.", 1, 2, 3)], "text string, tree int, fingerprint int, Sections int")
    got = merkle.fingerprints(rows)
    assert got.columns == ["text", "tree", "fingerprint", "sections"]
    assert got.first()["tree"] == 1 and got.first()["fingerprint"] == merkle.tree("a.").digest.hex()


def test_neighbours_equal_a_plain_ring(docs, edge_docs, no_docs):
    for table in (docs, edge_docs.filter("doc_id IS NOT NULL").distinct(), docs.filter("doc_id = 7")):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), reverse=True)
        got = {r["doc_id"]: r for r in merkle.compare_with_next(table).collect()}
        assert len(got) == len(rows)
        for i, (doc, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            trees = [merkle.tree(t) for t in (text, edited, after)]
            want = (
                doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), trees[0].digest.hex(),
                trees[1].digest.hex(), merkle.likeness(trees[0], trees[1]), merkle.likeness(trees[0], trees[2]),
                len(spans := merkle.edited_spans(trees[0], trees[1])), spans[0][0] if spans else None,
            )
            assert tuple(got[doc]) == want
    assert merkle.compare_with_next(edge_docs).count() == edge_docs.count()
    assert merkle.compare_with_next(no_docs).count() == 0


def test_fingerprint_and_edit_columns(spark):
    rows = spark.createDataFrame([(1, "a.\nb.", "a.\nc."), (2, None, "")], "sections long, old string, new string")
    found = {r["sections"]: r for r in merkle.locate_edits(rows, "old", "new").collect()}
    assert [tuple(x) for x in found[1]["edits"]] == [(3, 2)] and found[2]["edits"] == []
    tree = merkle.fingerprints(rows.withColumnRenamed("sections", "id"), "old").orderBy("id").collect()
    assert tree[0]["fingerprint"] == merkle.tree("a.\nb.").digest.hex()


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [
        (label, i) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(words), places


def test_base_places_equal_brute_force(docs, edge_docs, no_docs, spark):
    texts = [
        "CC-BY cc by CC  BY! general public license, all rights reserved gnu general public license public license",
        "all rights reserved " * 50, "cc", "cc é by", "Cc by", "ALL RIGHTS\nRESERVED",
    ]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for table in (docs.select("doc_id", "text").union(more), edge_docs.filter("doc_id IS NOT NULL").distinct()):
        got = {r["doc_id"]: r for r in licenses.summary(licenses.scan(table)).collect()}
        for r in table.collect():
            n, places = plain_scan(r["text"])
            own, starts = got[r["doc_id"]], [i for _, i in places]
            assert (own["n_words"], own["n_base"]) == (n, len(places))
            assert (own["first_word"], own["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
            assert own["base_labels"] == ",".join(sorted({x for x, _ in places}))
            assert {x for x, _ in places} <= set(own["labels"].split(",")) and 0 <= own["score"] <= 1
    assert licenses.scan(edge_docs).count() == edge_docs.count()
    assert licenses.scan(no_docs).count() == 0


def test_diagonals_bridge_changed_words(spark):
    body = licenses.TEMPLATES[2][0].split()
    changed = [*body[:12], "extra", *body[12:30], *body[31:]]
    far = " ".join(body[:20]) + " zzz" * 200 + " ".join(body[20:])
    texts = [" ".join(changed), " ".join(body[:15]), far, "Licensed under the Apache License, Version 2.0", "the apache of version 2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.summary(licenses.scan(rows)).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["mit", "", "", "apache-2.0", ""]
    assert got[0]["spans"][0]["start"] == 0 and got[0]["spans"][0]["share"] > 0.9
