import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenbib.operators import dedup, expand, incremental, report, retrieve
from lumenbib.operators.enrich import overlay_unpaywall, with_quartile
from lumenbib.operators.evidence import with_evidence
from lumenbib.operators.health import health_from_slices, source_health
from lumenbib.operators.score import final_scores, rule_scores
from lumenbib.plans.search import typed_nulls
from lumenbib.plans.views import journals_view, papers_view
from lumenbib.schema import conform
from lumenbib.sources import records as rd
from lumenbib.sources import tables as tb
from lumenbib.streaming import jobs


def test_openalex_file(spark, tmp_path):
    work = {"id": "W1", "doi": "https://doi.org/10.1/A", "display_name": None, "title": None, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "primary_location": None}
    (tmp_path / "oa.jsonl").write_text(json.dumps(work) + "\n")
    r = rd.openalex_papers(rd.read_json(spark, str(tmp_path / "oa.jsonl"), rd.OPENALEX)).first()
    assert (r["title"], r["abstract"], r["doi"], r["authors"], r["pdf_url"]) == ("Untitled", "a b a", "10.1/a", [], None)


def test_arxiv_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2301.1</id><title>A
        title</title><summary>S</summary><published>2023-01-02T03:04:05Z</published><author><name>Ada</name></author>
        <category term="cs.DL"/><arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">10.1/Z</arxiv:doi></entry></feed>"""
    )
    r = rd.arxiv_papers(rd.read_arxiv(spark, str(tmp_path / "a.xml"))).first()
    assert (r["title"], r["year"], r["doi"], r["pdf_url"], r["keywords"]) == ("A title", 2023, "10.1/z", "https://arxiv.org/pdf/2301.1.pdf", ["cs.DL"])


def test_csv_tables(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("﻿doi, title ,human_label,feedback_score\n10.1/a, T ,core,\n,\"U, v\",data,7\n".encode())
    rows = tb.read_feedback(spark, str(tmp_path / "f.csv")).orderBy("pos").collect()
    assert [(r["doi"], r["title"], r["human_label"], r["feedback_score"]) for r in rows] == [("10.1/a", "T", "core", ""), ("", "U, v", "data", "7")]
    (tmp_path / "j.csv").write_text("journal_name,quartile\nNature,Q2\nnature!,Q1\n,Q3\nX,\n")
    papers = spark.createDataFrame([(1, "NATURE"), (2, None), (3, "x")], "seq long, journal string")
    got = {r["seq"]: r["quartile"] for r in with_quartile(papers, tb.read_journals(spark, str(tmp_path / "j.csv"))).collect()}
    assert got == {1: "Q1", 2: "unknown", 3: "unknown"}


def test_expansion_rules(spark):
    topics = spark.createDataFrame([(1, "GCAM 碳中和 carbon pricing in China"), (2, "碳中和 电力投资")], "topic_id long, topic string")
    a, b = expand.expand_topics(topics).orderBy("topic_id").collect()
    assert a["detected_language"] == "mixed" and b["detected_language"] == "zh"
    assert a["english_keywords"][:3] == ["carbon pricing", "GCAM", "carbon"] and "碳中和" in a["chinese_keywords"]
    assert {"carbon market", "净零"} <= set(a["synonyms"]) and "IAM-based scenario analysis" in a["related_terms"]
    assert b["english_topic"] == "carbon neutrality electricity investment"
    assert a["boolean_queries"][0].startswith('("carbon pricing" OR "GCAM") AND ("China") AND (')


def test_boolean_and_plain_search(spark):
    papers = spark.createDataFrame(
        [(1, "Energy policy", "about china"), (2, "Energy", "policy of peru"), (3, "Food", "china")], "seq long, title string, abstract string"
    ).withColumns({"keywords": F.array().cast("array<string>"), "source_database": F.lit("X"), "year": F.lit(None).cast("int")})
    queries = spark.createDataFrame(
        [("q1", "energy policy", "default"), ("q2", "energy policy", "title"), ("q3", '("energy policy" OR "food") AND (china)', "default"), ("q4", "absent energy", "default")],
        "query_id string, query string, mode string",
    ).withColumn("source", F.lit(None).cast("string"))
    got = {}
    for r in retrieve.search(queries, papers).collect():
        got.setdefault(r["query_id"], set()).add(r["seq"])
    assert got == {"q1": {1, 2}, "q2": {1}, "q3": {1, 3}}


def test_quotas():
    assert retrieve.source_limits(1500, ["OpenAlex", "Semantic Scholar", "Crossref", "arXiv"]) == {"OpenAlex": 675, "Semantic Scholar": 450, "Crossref": 225, "arXiv": 150}
    assert retrieve.source_limits(10, ["OpenAlex", "CNKI"], 5) == {"OpenAlex": 20, "CNKI": 5}


def test_incremental_stream(spark, data, tmp_path):
    keyed = papers_view(spark, data).select("id", "title", "abstract", F.col("seq").cast("timestamp").alias("landed_at"))
    keyed = keyed.withColumn("key", incremental.work_key("v1"))
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    keyed.filter("id < 'P5'").write.parquet(landed)

    def run():
        rows = spark.readStream.schema(keyed.schema).parquet(landed)
        jobs.stream_new_results(rows, lambda b: b.select("key", "id"), out, str(tmp_path / "state"), event_time=None).awaitTermination()

    run()
    keyed.write.mode("append").parquet(landed)
    run()
    got = spark.read.parquet(out)
    assert got.count() == got.select("key").distinct().count() == keyed.select("key").distinct().count()


def test_health_stream_in_any_order(spark, tmp_path):
    rows = [("a" if i % 3 else "b", datetime(2024, 1, 1, i % 20, i % 60), i, i % 4 != 0, float(i % 7 * 100), "x") for i in range(300)]
    log = spark.createDataFrame(rows, "source string, ts timestamp, seq long, success boolean, latency_ms double, reason string")
    last = log.limit(1).withColumns({"source": F.lit("closing"), "ts": F.lit("2024-03-01").cast("timestamp")})
    log.orderBy(F.rand(3)).unionByName(last).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    jobs.stream_health_slices(stream, str(tmp_path / "slices"), str(tmp_path / "state")).awaitTermination()
    got = health_from_slices(spark.read.parquet(str(tmp_path / "slices")).filter("bucket <> 'closing'"))
    want = {r["bucket"]: r for r in source_health(log).collect()}
    for r in got.collect():
        w = want.pop(r["bucket"])
        assert abs(r["success_ema"] - w["success_ema"]) < 1e-9 and r["attempts"] == w["attempts"] and r["last_error"] == w["last_error"]
    assert not want


def test_sinks(spark, data, tmp_path):
    rated = with_quartile(papers_view(spark, data), journals_view(spark))
    scored = with_evidence(rule_scores(rated, ["the"], ["the and"], F.lit("the"), None, 2026), ["the"])
    final = final_scores(typed_nulls(scored)).withColumn("rubric", F.lit(None).cast("struct<decision:string,confidence:double,policy_relevance:double,final_llm_score:double,topic_relevance:double,object_relevance:double,method_relevance:double,data_relevance:double,novelty:double,citation_value:double,writing_value:double,reason:string,usable_for:array<string>,labels:array<string>>")).withColumn("llm_score", F.lit(None).cast("double")).cache()
    flat = report.flat_table(final)
    assert flat.columns == report.FLAT_COLUMNS and len(flat.columns) == 63
    for form in ("parquet", "csv"):
        report.write_flat(flat, str(tmp_path / form), form)
    report.write_bibtex(final, str(tmp_path / "bib"))
    report.write_raw_json(final.select("id", "title"), str(tmp_path / "raw"))
    cards = final.orderBy("seq").limit(5).withColumn("card_rank", (F.col("seq") + 1).cast("int"))
    report.write_cards(cards, str(tmp_path / "cards"))
    texts = "".join(p.read_text() for p in (tmp_path / "cards").glob("part-*"))
    assert texts.count("<!-- ") == 5 and texts.count("## How it ranks") == 5
    report.write_cards(cards.withColumn("topic_id", F.col("seq") % 2), str(tmp_path / "by_topic"))
    assert sorted(p.name for p in (tmp_path / "by_topic").glob("topic_id=*")) == ["topic_id=0", "topic_id=1"]
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == final.count()
    assert "@article{" in "".join(p.read_text() for p in (tmp_path / "bib").glob("part-*"))
    report.write_expanded(expand.expand_topics(spark.createDataFrame([(1, "wind power")], "topic_id long, topic string")), str(tmp_path / "expanded"))
    assert spark.read.json(str(tmp_path / "expanded")).first()["topic_id"] == 1
    report.write_diagnostics(report.diagnostics(means=report.score_averages(final)), str(tmp_path / "diagnostics"))
    assert "means" in json.loads(spark.read.text(str(tmp_path / "diagnostics")).first()["value"])
    keyed = final.withColumn("key", incremental.work_key("v1")).select("key", "final_score")
    incremental.store(keyed, str(tmp_path / "kept"), "v1")
    assert incremental.todo(keyed, incremental.stored(spark, str(tmp_path / "kept"), "v1")).count() == 0
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"%PDF-1.7" + b"x" * 20000)
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"<html></html>")
    assert {r["path"][-5:]: r["is_pdf"] for r in tb.read_pdfs(spark, str(tmp_path / "pdf")).collect()} == {"a.pdf": True, "b.pdf": False}
    seen = spark.createDataFrame([(10, 2)], "retrieved long, failed long")
    text = report.summary_markdown("the", final, final.limit(3), cards, {"Sources": seen})
    assert "## Journals" in text and "| retrieved | 10 |" in text and "| selected | 3 |" in text


def test_landed_files_keep_their_order_through_the_merge(spark, tmp_path):
    works = [{"id": f"W{i}", "doi": f"10.1/{i % 3}", "display_name": f"title {i % 3}", "publication_year": 2000 + i} for i in range(6)]
    folder = tmp_path / "works"
    folder.mkdir()
    for k, name in enumerate(("b.json", "a.json")):
        (folder / name).write_text("\n".join(json.dumps(w) for w in works[k * 3 : k * 3 + 3]))
    landed = rd.openalex_papers(rd.read_json(spark, str(folder), rd.OPENALEX))
    assert [r["id"] for r in landed.orderBy("seq").collect()] == ["W3", "W4", "W5", "W0", "W1", "W2"]  # files by name
    merged = {r["doi"]: r for r in dedup.dedup_by_doi(landed).collect()}
    assert {d: (r["id"], r["year"]) for d, r in merged.items()} == {f"10.1/{i}": (f"W{i + 3}", 2003 + i) for i in range(3)}
    entry = "<entry><id>http://arxiv.org/abs/2301.0000{0}</id><title>t{0}</title><published>2020-12-31T23:00:00Z</published></entry>"
    (tmp_path / "feed.xml").write_text("<feed>" + "".join(entry.format(i) for i in range(4)) + "</feed>")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        feed = rd.arxiv_papers(rd.read_arxiv(spark, str(tmp_path / "feed.xml"))).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [(r["title"], r["year"]) for r in feed] == [(f"t{i}", 2020) for i in range(4)]


def test_merge_refuses_records_without_order(spark):
    bare = conform(spark.createDataFrame([("W1", "10.1/1")], "id string, doi string"))
    with pytest.raises(Exception, match="no arrival order"):
        dedup.dedup_by_doi(bare).collect()


def test_nested_div_rows_and_one_record_per_doi(spark):
    html = """<div class="item"><div><a href="/k/1">first</a></div><div>2019 被引: 7</div></div>
      <div class="item"><div><a href="/k/2">second</a></div><div>2020</div></div>"""
    pages = spark.createDataFrame([(0, html)], "position long, html string")
    found = rd.cnki_papers(pages).orderBy("seq").collect()
    assert [(r["title"], r["year"], r["citation_count"], r["landing_page_url"]) for r in found] == [("first", 2019, 7, "/k/1"), ("second", 2020, None, "/k/2")]
    place = "struct<url_for_pdf:string,url_for_landing_page:string,url:string>"
    snapshot = spark.createDataFrame(
        [("10.1/A", False, None, None, None), ("https://doi.org/10.1/a", True, "gold", ("u.pdf", None, "u"), [])],
        f"doi string, is_oa boolean, oa_status string, best_oa_location {place}, oa_locations array<{place}>",
    )
    papers = conform(spark.createDataFrame([(1, "10.1/a"), (2, None)], "seq long, doi string"))
    overlaid = {r["seq"]: r for r in overlay_unpaywall(papers, snapshot).collect()}
    assert len(overlaid) == 2 and overlaid[1]["pdf_url"] == "u.pdf" and not overlaid[2]["oa_hit"]


def test_hit_limits_follow_the_request(spark):
    expanded = expand.expand_topics(spark.createDataFrame([(1, "wind power policy")], "topic_id long, topic string"))
    queries = retrieve.provider_queries(expanded, "OpenAlex", 20000)
    most = queries.agg(F.max("hits")).first()[0]
    assert most > 120
    hits = spark.range(most + 50).select(F.lit(1).alias("query_id"), F.col("id").alias("seq"), F.lit(2000).alias("year"), F.lit(1.0).alias("relevance"), F.lit(most).alias("hits"))
    assert retrieve.top_hits(hits).count() == most
    assert retrieve.per_query_limit("arXiv", 5000, F.lit(1), 200) is not None
