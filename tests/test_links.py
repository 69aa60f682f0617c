import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenbib.operators import candidates as ca
from lumenbib.operators import health, rubric
from lumenbib.sources import payloads as pl


def test_provider_payloads(spark):
    """Objects and lists of objects, several locations, and empty results."""
    doi = "10.5555/lake.42"
    texts = {
        "unpaywall": """{"best_oa_location": {"url_for_pdf": "https://eprints.lakeside.example/42/full.pdf", "url": "https://eprints.lakeside.example/42"},
          "oa_locations": [{"url_for_pdf": "https://mirror.lakeside.example/42.pdf"}, {"url_for_pdf": ""}]}""",
        "openalex": """{"best_oa_location": null, "primary_location": {"landing_page_url": "https://lake-studies.example/v3/42"}, "open_access": {"oa_url": null}}""",
        "crossref": """{"message": {"URL": "https://lake-studies.example/v3/42", "link": [
          {"URL": "https://lake-studies.example/v3/42.html", "content-type": "text/html"},
          {"URL": "https://lake-studies.example/v3/42.pdf", "content-type": "application/pdf"}]}}""",
        "openaire": """{"response": {"results": {"result": {"metadata": {"oaf:entity": {"oaf:result": {"children": {"result":
          [{"instance": {"url": {"$": "https://air.example/42/download/1"}}}, {"instance": {"url": {"$": "https://air.example/plain"}}}]}}}}}}}}""",
        "doaj": '{"results": []}',
        "europepmc": '{"resultList": {"result": []}}',
        "pmc": '{"records": [{"pmcid": "PMC7700042"}, {"pmcid": null}]}',
        "core": '{"results": []}',
    }
    tables = {k: spark.createDataFrame([(doi.upper(), v)], "doi string, payload string") for k, v in texts.items()}
    papers = spark.createDataFrame([(1, doi, None, ""), (2, None, None, None)], "seq long, doi string, landing_page_url string, pdf_url string")
    links = ca.first_links(ca.discovered_links(papers, pl.all_payload_links(tables))).collect()
    urls = {r["url"] for r in links}
    assert {r["seq"] for r in links} == {1}
    assert urls >= {
        "https://eprints.lakeside.example/42/full.pdf",
        "https://mirror.lakeside.example/42.pdf",
        "https://lake-studies.example/v3/42",
        "https://lake-studies.example/v3/42.pdf",
        "https://air.example/42/download/1",
    }
    assert any("PMC7700042" in u for u in urls)
    assert not any(u == "" for u in urls)
    filled = {r["seq"]: r for r in ca.backfill(papers, pl.payload_backfill(tables)).collect()}
    assert filled[1]["pdf_url"] == "https://eprints.lakeside.example/42/full.pdf"
    assert (filled[2]["landing_page_url"], filled[2]["pdf_url"]) == (None, None)


def test_link_order(spark):
    links = spark.createDataFrame(
        [(1, 0, "https://x/l", "metadata.landing_page_url", True), (1, 1, "https://x/a.pdf", "arxiv", False), (1, 2, "https://x/m.pdf", "metadata.pdf_url", False)],
        "seq long, pos long, url string, source string, from_landing boolean",
    )
    known = spark.createDataFrame([("arxiv", 0.9, 100.0), ("metadata.pdf_url", 0.1, 100.0)], "bucket string, success_ema double, latency_ema double")
    ranked = ca.rank_links(links, known).orderBy("link_rank").collect()
    assert [r["source"] for r in ranked] == ["arxiv", "metadata.pdf_url", "metadata.landing_page_url"]


def attempts(spark, rows):
    return spark.createDataFrame(rows, "source string, ts timestamp, seq long, success boolean, latency_ms double, reason string")


def test_health_fixture(spark):
    at = datetime(2024, 1, 1)
    rows = [("openalex.primary_location.pdf_url", at, 1, True, 1000.0, ""), ("openalex.best", at + timedelta(hours=2), 2, False, 0.0, "http_403")]
    r = health.source_health(attempts(spark, rows)).first()
    assert (r["bucket"], r["last_error"], r["attempts"]) == ("openalex", "http_403", 2)
    assert abs(r["success_ema"] - 0.4928) < 1e-12 and abs(r["latency_ema"] - 3640) < 1e-9


def test_health_and_runs_equal_the_loop(spark):
    rng = random.Random(7)
    rows = [
        (rng.choice(["a", "a", "a", "b"]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(40_000)), i, rng.random() < 0.6, float(rng.choice([0, 100, 900])), f"r{i % 3}")
        for i in range(800)
    ]
    want, runs = {}, {}
    for source, ts, i, ok, ms, reason in sorted(rows, key=lambda r: (r[1], r[2])):
        s, l, n = want.get(source, (0.5, 4000.0, 0))
        want[source] = (0.12 * ok + 0.88 * s, 0.12 * ms + 0.88 * l if ok and ms > 0 else l, n + 1)
        streak, stop, n = runs.get(source, (0, None, 0))
        streak = 0 if ok else streak + 1
        runs[source] = (streak, stop or (n + 1 if streak >= 3 else None), n + 1)
    log = attempts(spark, rows)
    for r in health.source_health(log, "5 minutes").collect():
        s, l, n = want[r["bucket"]]
        assert abs(r["success_ema"] - s) < 1e-9 and abs(r["latency_ema"] - l) < 1e-6 and r["attempts"] == n
    assert {r["source"]: r["stop_after"] for r in health.failure_stops(log, 3, "1 minute").collect()} == {k: v[1] for k, v in runs.items()}


def test_rubric_texts(spark):
    texts = [
        '```json\n{"confidence": "120", "decision": " core ", "labels": ["a", " "]}\n```',
        'Sure: {"final_llm_score": 70.5, "labels": null} bye',
        "no json",
        '[{"confidence": 1}]',
        '{"confidence": "n/a"}',
        '{"confidence": 1, broken',
        None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, answer string")
    got = [r["r"] for r in rows.select("i", rubric.parse_rubric("answer").alias("r")).orderBy("i").collect()]
    assert (got[0]["confidence"], got[0]["decision"], got[0]["labels"]) == (100.0, "core", ["a"])
    assert got[1]["final_llm_score"] == 70.5 and got[1]["labels"] == []
    assert got[2] is None and got[3] is None and got[4]["confidence"] is None and got[5] is None and got[6] is None


def test_model_is_asked_twice(spark):
    def load():
        calls = {"n": 0}

        def model(prompts):
            calls["n"] += 1
            return ["timeout" if calls["n"] == 1 else '{"final_llm_score": 88}' for _ in prompts]

        return model

    rows = spark.createDataFrame([(1, "p")], "seq long, prompt string").coalesce(1)
    r = rubric.ask_model(rows, load).select("outcome", rubric.parse_rubric("response").alias("r")).first()
    assert r["outcome"] == "scored" and r["r"]["final_llm_score"] == 88.0


def test_pdf_bytes(spark):
    good = b"%PDF-1.4" + b"x" * 1100 + b"%%EOF"
    rows = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"%PDF-1.4 short")), (3, bytearray(b"<html>" + b"x" * 5000))], "i int, content binary")
    assert [r[0] for r in rows.orderBy("i").select(ca.is_stored_pdf(F.col("content"))).collect()] == [True, False, False]


def test_titles_with_a_changed_word_find_their_doi(spark):
    works = spark.createDataFrame(
        [(1, "regional modelling of climate adaptation in cities", "10.1/a"), (2, "climate policy in the cities of europe", "10.1/b")],
        "seq long, title string, doi string",
    )
    papers = spark.createDataFrame(
        [(10, "Regional modelling of climate adaption in cities", None), (11, "short", None), (12, "unlike any other of them", ""), (13, None, None)],
        "seq long, title string, doi string",
    )
    found = ca.resolve_titles(papers, works)
    assert [(r["seq"], r["found_doi"]) for r in found.collect()] == [(10, "10.1/a")]
    filled = {r["seq"]: r["doi"] for r in ca.with_found_doi(papers, found).collect()}
    assert filled == {10: "10.1/a", 11: None, 12: None, 13: None}


def test_links_of_a_hot_doi_are_distinct_before_they_meet_its_papers(spark, monkeypatch):
    monkeypatch.setattr(ca, "DOI_LINKS", 7)
    papers = spark.createDataFrame([(i, "https://doi.org/10.1/HOT" if i < 30 else f"10.1/{i}") for i in range(33)], "seq long, doi string")
    rows = [("10.1/hot", p, i, f" https://x.org/{(i * 7) % 40}.pdf" if i % 2 else f"https://X.org/{i}.pdf", f"{p}.{i}", False) for p in ("doaj", "unpaywall") for i in range(40)]
    rows += [("10.1/31", "core", 0, "https://x.org/a.pdf", "core.0", False), (None, "core", 0, "https://x.org/b.pdf", "core.0", False)]
    links = spark.createDataFrame(rows, "doi string, provider string, pos int, url string, source string, from_landing boolean")
    got = ca.discovered_links(papers, links).collect()
    want = {}
    for doi, p, i, url, source, _ in rows:
        at = (ca.PROVIDERS.index(p) + 1) * 100000 + i
        key = (doi, url.strip().lower())
        want[key] = min(want.get(key, (at, source)), (at, source))
    full = {(s, u, *want["10.1/hot", u]) for s in range(30) for d, u in want if d == "10.1/hot"} | {(31, "https://x.org/a.pdf", 800000, "core.0")}
    assert {(r["seq"], r["url"].lower(), r["pos"], r["source"]) for r in got} == full and len(got) == len(full)
