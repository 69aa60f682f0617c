"""SimHash, vectors and components against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenbib.llm import forest, simhash, vectors


def roots_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_long_paths_and_stars_become_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 200), (5, 5)]
    found = dict(map(tuple, forest.components(spark.createDataFrame(pairs, "a long, b long")).select("node", "root").collect()))
    want = {i: r for i, r in enumerate(roots_of(202, pairs)) if r != i}
    assert found == want
    assert forest.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_shuffles(spark):
    """The driver keeps a thread for each shuffle of the last minute, so a few links are not worth rounds of stars."""
    pairs = [((i * 37) % 301, ((i + 1) * 37) % 301) for i in range(300)] + [(400, i) for i in range(401, 450)] + [(500, 500)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    context, found, jobs = spark.sparkContext, [], []
    for k, how in enumerate(({}, {"few": 0})):
        context.setJobGroup(f"links-{k}", "links")
        found.append(dict(map(tuple, forest.components(edges, **how).collect())))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"links-{k}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] == {i: r for i, r in enumerate(roots_of(501, pairs)) if r != i}
    assert jobs[0] <= 10 < jobs[1]


def test_local_classes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        pairs = rng.integers(0, 40, (rng.integers(1, 60), 2))
        classes = forest.LocalClasses(40)
        for part in np.array_split(pairs, 3):
            classes.link(part[:, 0], part[:, 1])
        assert classes.label.tolist() == roots_of(40, pairs.tolist())


@pytest.mark.parametrize("tile", [4096, 8])
def test_simhash_equals_brute_force(docs, spark, tile):
    text = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n")], "doc_id long, text string")
    more = docs.select("doc_id", "text").union(text)
    more = more.union(docs.filter("doc_id < 40").select(F.col("doc_id") + 5000, F.concat("text", F.lit(" tail"))))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(more, tile=tile).collect()}
    rows = sorted(map(tuple, more.collect()))
    prints = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    pairs = [(i, j) for i in range(len(rows)) for j in (np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= 4) + i + 1)]
    assert len(got) == len(rows)
    for i, root in enumerate(roots_of(len(rows), pairs)):
        r = got[rows[i][0]]
        assert (r["fingerprint"], r["component_id"]) == (f"{int(prints[i]):016x}", rows[root][0])


def test_simhash_edge_cases(edge_docs, no_docs, tmp_path, spark):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {0}  # null, empty and blank texts, the smallest id
    assert [r["component_id"] for r in rows if r["doc_id"] == 9] == [8]
    edge_docs.write.parquet(str(tmp_path / "d"))
    placed = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.one_of_each(placed)
    assert kept.columns == placed.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 8, 10, 11]
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("tile", [4096, 16])
def test_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((12, 24))
    near = (base[rng.integers(0, 4, 120)] + rng.standard_normal((120, 24)) * 0.12).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2), "x") for i, v in enumerate(np.concatenate([base.astype(np.float32), near, near[:9]]))]
    odd = [None, [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [float("inf")] * 24, [1.0] * 24, [1.0] * 5]
    rows += [(1000 + i, v, None if i == 5 else 1, "y") for i, v in enumerate(odd)] + [rows[3], (None, rows[3][1], 1, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")
    got = vectors.near_vectors(frame, tile=tile).collect()
    good = [i for i, (_, v, label, _) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    pairs = [
        (i, j) for i in good for j in good
        if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    ]
    linked, roots = np.bincount(np.array(pairs).ravel(), minlength=len(rows)), roots_of(len(rows), pairs)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in roots}
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(rows[i][0], int(linked[i]), least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows))]
    assert linked.sum() > 100
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_table_plan_reaches_the_recall():
    for n in (1, 1000, 10**6, 10**10):
        bits, tables = vectors.plan_tables(n, 0.98)
        agree = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - agree) ** tables <= vectors.MISS * 1.0001
