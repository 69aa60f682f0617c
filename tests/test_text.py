from pyspark.sql import functions as F

from lumenbib.functions import text as tx
from lumenbib.functions import urls
from lumenbib.operators.candidates import page_links


def test_keys(values):
    assert values(tx.normalize_doi("x"), [" HTTPS://dx.doi.org/10.1/AbC ", "", "10.1/x", None]) == ["10.1/abc", None, "10.1/x", None]
    assert values(tx.normalize_title("x"), ["Carbon-Neutrality: 碳中和 (2020)", None]) == ["carbon neutrality 碳中和 2020", ""]
    assert values(tx.short_title("x", 2), ["A b c", "", None]) == ["a_b", "untitled", "untitled"]
    assert values(tx.clean_filename("x", 10), [' a/b: c?.', "...", "x" * 20]) == ["a_b__c", "paper", "x" * 10]
    assert values(tx.detect_language("x"), ["abc", "中国", "GCAM 中国", "12", ""]) == ["en", "zh", "mixed", None, None]
    assert values(tx.round2(tx.col("x")), [2.674, 2.676, 99.995], "double") == [2.67, 2.68, 100.0]


def test_first_author(values):
    authors = [["Smith, John", "B"], ["Ada Lovelace"], [], ["  "], None]
    assert values(tx.first_author("x"), authors, "array<string>") == ["smith", "lovelace", "unknown", "unknown", "unknown"]


def test_lists(values):
    assert values(tx.ordered_distinct("x"), [["X", " x ", "Y", None, "", "a  b", "A b"]], "array<string>") == [["X", "Y", "a b"]]
    assert values(tx.ordered_distinct("x", clean=False), [["X ", "x", " Y"]], "array<string>") == [["X ", " Y"]]
    assert values(tx.tokenize_topic("x"), ["GCAM-China in a net_zero v1.5"]) == [["gcam-china", "net_zero", "v1.5"]]
    assert values(tx.split_sentences("x"), ["One. Two; three！四\nfive v1.5 x"]) == [["One.", "Two", "three", "四", "five v1.5 x"]]


def test_strip_html(values):
    assert values(tx.strip_html("x"), ["<p>a &amp; b</p> &eacute;", "plain <b>x</b>", None]) == ["a & b é", "plain x", ""]


def test_buckets_and_arxiv(values):
    labels = ["unpaywall.oa_locations[0].url_for_pdf", "crossref.page_scrape[0]:html", "metadata.pdf_url", "", None, "raw.pdf_url"]
    assert values(tx.source_bucket("x"), labels) == ["unpaywall", "crossref", "metadata.pdf_url", "unknown", "unknown", "raw.pdf_url"]
    given = ["https://arxiv.org/abs/2301.12345v2", "arXiv: hep-th/9901001", "x"]
    assert values(tx.arxiv_id("x"), given) == ["2301.12345", "hep-th/9901001", None]


def test_escape_bibtex(values):
    assert values(tx.escape_bibtex("x"), ["a_b & {c} 5% \\"]) == ["a\\_b \\& \\{c\\} 5\\% \\\\"]


def test_plausible(values):
    given = ["https://example.org/file.pdf", "https://doaj.org/subjects/climate", "ftp://x/a.pdf", "https://x.org/a.pdf;s=1", None, "not a url"]
    assert values(urls.is_plausible_pdf_url("x"), given) == [True, False, False, True, False, False]


def test_only_link_tags_give_links(spark):
    html = """<body><img src="/pdf/cover.png"><script src="/pdf/viewer.js"></script><a class=x data-download-url="/download/7">d</a>
      <iframe src="/pdf/show?a=1&amp;b=2"></iframe><a href="/plain">p</a></body>"""
    pages = spark.createDataFrame([("https://journal.example.net/a", html)], "url string, html string")
    host = "https://journal.example.net"
    assert page_links(pages).first()["pdf_links"] == [f"{host}/download/7", f"{host}/pdf/show?a=1&b=2"]


def test_page_links(spark):
    html = """<head><meta content="/v2/77.pdf" name="citation_pdf_url"></head><nav><a href="../up/x.pdf">up</a></nav>
      <p onclick="window.open('/store/77-final.pdf')">file</p><a class="b" href="/get?n=77&type=printable&format=pdf">print</a>"""
    pages = spark.createDataFrame([("https://lakes.example/a/77", html), ("https://lakes.example/b", "<p>none</p>")], "url string, html string")
    found = [r["pdf_links"] for r in page_links(pages).orderBy("url").collect()]
    paths = ["/v2/77.pdf", "/up/x.pdf", "/get?n=77&type=printable&format=pdf", "/store/77-final.pdf"]
    assert found[0] == [f"https://lakes.example{p}" for p in paths]
    assert found[1] == []


def test_ordered_distinct_of_a_long_list_needs_no_search_per_value(spark):
    import time

    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(119_999)), lambda i: F.concat(F.lit("W "), (i % 60_000).cast("string"))).alias("x"))
    took = time.time()
    got = rows.select(tx.ordered_distinct("x").alias("y")).first()["y"]
    assert got == [f"W {i}" for i in range(60_000)] and time.time() - took < 20
    mixed = spark.createDataFrame([(["b", " A", None, "a ", "B", "", "c  d", "C d"],)], "x array<string>")
    assert mixed.select(tx.ordered_distinct("x").alias("y")).first()["y"] == ["b", "A", "c d"]
    assert mixed.select(tx.ordered_distinct("x", False).alias("y")).first()["y"] == ["b", " A", "c  d", "C d"]
