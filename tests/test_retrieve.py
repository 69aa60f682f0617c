"""Retrieval by places against plain string search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenbib.operators import retrieve

PAPER = "seq long, title string, abstract string, keywords array<string>, source_database string, year int"


def papers(spark, rows):
    return spark.createDataFrame([(i, t, a, k, "OpenAlex", 2020) for i, (t, a, k) in enumerate(rows)], PAPER)


def found(spark, table, queries, mode="default"):
    asked = spark.createDataFrame([(i, q, mode, None) for i, q in enumerate(queries)], "query_id int, query string, mode string, source string")
    out = {}
    for r in retrieve.search(asked, table).collect():
        out.setdefault(r["query_id"], set()).add(r["seq"])
    return [out.get(i, set()) for i in range(len(queries))]


def test_chinese_and_phrases(spark):
    table = papers(spark, [
        ("中国实现碳中和的路径", "能源政策研究", []),
        ("碳 中和", None, None),
        ("China energy and policy", "", []),
        ("Energy policy of China", "co2排放与碳中和目标", ["碳"]),
        ("energy", "policy", ["energy policy"]),
        (None, None, None),
    ])
    asked = ["碳中和", '"energy policy"', "energy policy", "碳", "co2", "co2排放", "路径", "能源 碳中和", '"policy of" energy', "", '""', '"中和目标"', "中路"]
    got = found(spark, table, asked)
    assert got == [{0, 3}, {3, 4}, {2, 3, 4}, {0, 1, 3}, {3}, {3}, {0}, {0}, {3}, set(), set(), {3}, set()]
    assert found(spark, table, ["碳中和", '"energy policy"'], "title") == [{0}, {3}]
    assert found(spark, table, ["碳中和", '"energy policy"'], "title_abstract") == [{0, 3}, {3, 4}]


@pytest.mark.parametrize("mode", ["default", "title", "title_abstract"])
def test_words_and_phrases_equal_string_search(spark, mode):
    draw = random.Random(3)
    words = ["a", "b", "ab", "c", "碳中", "碳", "aa"]

    def text(n):
        return " ".join(draw.choices(words, k=draw.randint(0, n)))

    rows = [(text(5), text(8), [text(2)]) for _ in range(120)]
    asked = [" ".join(dict.fromkeys(draw.choices(["a", "b", "ab", "aa", "c"], k=2))) for _ in range(15)]
    asked += [f'"{" ".join(draw.choices(["a", "b", "ab", "c"], k=3))}" c' for _ in range(15)]
    asked += ["a AND b OR c", "ab AND aa", "b a OR a b"]

    def plain(query, row):
        title, abstract, keywords = row
        places = {"title": title, "title_abstract": f"{title} {abstract}", "default": f"{title} {abstract} {' '.join(keywords)}"}
        text = " ".join(places[mode].split())

        def holds(p):
            return f" {' '.join(p.split())} " in f" {text} "

        if " AND " in query or " OR " in query:
            groups = [g.split(" OR ") for g in query.split(" AND ")]
        elif query.startswith('"'):
            inner, rest = query[1:].split('"')
            groups = [[inner], *[[w] for w in rest.split()]]
        else:
            groups = [[w] for w in query.split()]
        return all(any(holds(p) for p in g) for g in groups)

    got = found(spark, papers(spark, rows), asked, mode)
    assert got == [{i for i, r in enumerate(rows) if plain(q, r)} for q in asked]
    assert sum(map(len, got)) > 30


@pytest.mark.parametrize("most", [0, 200_000])
def test_han_runs_equal_string_search_and_frequent_pairs_are_not_indexed(spark, monkeypatch, most):
    from lumenbib.operators import postings

    monkeypatch.setattr(postings, "BROADCAST_TOKENS", most)
    draw = random.Random(5)
    rows = [("".join(draw.choices("碳中和a1 ", k=draw.randint(0, 60))), "", []) for _ in range(60)]
    asked = ["".join(draw.choices("碳中和", k=n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 17) for _ in range(2)]
    asked += [rows[i][0].split()[0] for i in range(0, 60, 4) if rows[i][0].split()]
    got = found(spark, papers(spark, rows), asked)
    run = "(?<![{0}])(?:{1})(?![{0}])"
    for query, ids in zip(asked, got, strict=True):
        parts = re.findall("[碳中和]+|[a1]+", query)
        edge = [p if p[0] in "碳中和" else run.format("a1", p) for p in parts]
        assert ids == {i for i, (t, _, _) in enumerate(rows) if re.search("".join(edge), t)}, query
    assert sum(map(len, got)) > 30
    # Six characters are one token, not pairs that stand in most texts.
    own = spark.range(1).select(postings.phrase(F.lit("碳中和碳中和")).alias("p")).first()["p"]
    assert [t["token"] for t in own["tokens"]] == ["碳中和碳中和"]
