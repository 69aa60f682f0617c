"""Steps that read their input once and hold little of it, however large the table is."""

import random
import tracemalloc

from lumenbib.functions import similarity
from lumenbib.operators import postings, retrieve
from lumenbib.plans import queries, source_queries
from lumenbib.sources import records as rd


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_map_stays_in_its_row_and_comes_back_in_order(spark, data):
    texts = ["b a  b\nc a", "", None, " one ", " x y", "x " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq int, text string")
    made = {r["seq"]: r for r in rows.select("seq", source_queries.word_index("text").alias("m")).withColumn("t", rd.restore_abstract("m")).collect()}
    assert made[0]["m"] == {"a": [1, 4], "b": [0, 2], "c": [3]}
    assert made[1]["m"] == {"": [0]} and made[2]["m"] is None
    assert [made[i]["t"] for i in range(6)] == ["b a b c a", None, None, "one", " x y", " ".join(["x"] * 500)]
    odd = spark.sql("SELECT map('z', array(3, 0), 'y', array(0, -1), 'w', array(null)) AS m")
    assert odd.select(rd.restore_abstract("m").alias("t")).first()["t"] == "w y y z z"
    found = plan(source_queries.openalex_records(spark, data))
    assert "hashpartitioning" not in found and "Join" not in found


PAPER = "seq long, title string, abstract string, keywords array<string>, source_database string, year int"


def test_few_queries_meet_papers_in_their_rows(spark, monkeypatch):
    draw = random.Random(8)
    words = ["a", "b", "c", "d", "碳中", "中和a", "e"]

    def text(n):
        return " ".join(draw.choices(words, k=draw.randint(0, n)))

    rows = [(i, text(4), text(9) if i % 7 else None, [text(2)] if i % 5 else None, draw.choice(["OpenAlex", "arXiv"]), 2000 + i % 9) for i in range(150)]
    table = spark.createDataFrame(rows, PAPER)
    asked = ["a b", '"a b" c', "a AND b OR c", "d OR e AND a OR b", "碳中", "碳 d", '"碳中 a"', "zz OR a AND b", "zz"]
    modes, sources = ["default", "title", "title_abstract"], [None, "arXiv"]
    ask = [(i, q, modes[i % 3], sources[i % 2]) for i, q in enumerate(asked * 6)]
    given = spark.createDataFrame(ask, "query_id int, query string, mode string, source string")
    in_rows = retrieve.search(given, table)
    assert "hashpartitioning" not in plan(in_rows)
    got = sorted(map(tuple, in_rows.collect()), key=str)
    monkeypatch.setattr(postings, "BROADCAST_QUERIES", 0)
    assert got == sorted(map(tuple, retrieve.search(given, table).collect()), key=str)
    assert len(got) > 200 and len(got) == len({(r[0], r[4]) for r in got})


def test_words_of_title_and_abstract_are_counted_without_keywords(spark):
    rows = [(1, "A b", " c-d ", ["e f", ""], "x", 1), (2, None, None, None, "x", 1), (3, "", "?", ["e"], "x", 1)]
    got = postings.paper_texts(spark.createDataFrame(rows, PAPER)).orderBy("seq").collect()
    assert [(r["title_words"], r["both_words"]) for r in got] == [(2, 4), (0, 0), (0, 0)]


def test_papers_are_scored_once(spark, data):
    assert "documents.parquet" not in plan(queries.card_index(spark, data))
    assert "documents.parquet" not in plan(queries.download_plan(spark, data))


def test_set_ratios_hold_few_rows_at_a_time():
    draw = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(draw.choices(words, k=200)) for _ in range(4000)]
    near = [t.split(" ", 3)[2] + " some topic" for t in texts]
    tracemalloc.start()
    got = similarity.token_set_ratio_values(texts, near)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60, peak
    one = [similarity.token_set_ratio_values([a], [b])[0] for a, b in zip(texts[::200], near[::200])]
    assert got[::200].tolist() == one
