"""The physical plans keep their shape: pruned scans, ranked heads cut before the shuffle, checked broadcasts."""

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from lumenbib.operators import select
from lumenbib.plans import views as v
from lumenbib.plans.queries import stub_model
from lumenbib.plans.search import search_topics
from lumenbib.sources.records import from_year


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_points():
    assert set(oracle_sql()) <= set(queries())


def test_heads_are_cut_before_the_shuffle(spark, data):
    plan = plan_of(queries()["select_hybrid_groups"](spark, data))
    assert "WindowGroupLimit" in plan
    assert "WindowGroupLimit" in plan_of(queries()["retrieve_topk"](spark, data))


def test_small_lookup_is_broadcast_by_size(spark, data):
    assert "BroadcastHashJoin" in plan_of(queries()["journal_quartile"](spark, data))


def test_scan_is_pruned_and_filtered(spark, tmp_path, data):
    v.papers_view(spark, data).drop("cnki").write.parquet(str(tmp_path / "p"))
    plan = plan_of(from_year(spark.read.parquet(str(tmp_path / "p")), 2010, False).select("id"))
    assert "PushedFilters: [IsNotNull(year), GreaterThanOrEqual(year,2010)]" in plan
    assert "ReadSchema: struct<id:string,year:int>" in plan


def test_top_k_is_one_pass(spark, data):
    rows = v.papers_view(spark, data).select("seq", "citation_count", F.col("year").cast("double").alias("final_score"))
    assert "TakeOrderedAndProject" in plan_of(select.top_papers(rows)) or "GlobalLimit" in plan_of(select.top_papers(rows))


def test_whole_search_with_merge(spark, data):
    topics = v.topics_view(spark, data).filter("topic_id < 2")
    tables = search_topics(
        topics, v.papers_view(spark, data), v.journals_view(spark), 2026, v.unpaywall_view(spark, data), v.feedback_view(spark, data), stub_model, limit=20
    )
    selected = tables["selected"].collect()
    assert selected and len({(r["topic_id"], r["seq"]) for r in selected}) == len(selected)
    assert all(r["final_decision"] for r in selected)
    assert tables["papers"].count() < 200
