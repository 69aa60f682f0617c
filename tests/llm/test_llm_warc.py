"""Archives: round trip, splitting at any byte, revisits, odd rows."""

import hashlib
import io

from pyspark.sql import functions as F

from lumenbib.llm import warc


def plain(rows):
    """What the rules say about (page_id, html)."""
    body = [(i, (h or "").encode()) for i, h in rows]
    head = {}
    for i, b in body:
        if len(b) >= 1000 and i is not None:
            head[b] = max(i, head.get(b, i))
    out = []
    for i, b in body:
        other = b in head and (i is None or i < head[b])
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", head[b] if other else None))
    return out


def rows_of(frame):
    keep = frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, keep), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_round_trip(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    more = pages.filter("page_id < 9").select(F.col("page_id") + 1000, "url", "html")
    big = "é" * 700
    odd = [(2000, None, None), (2001, "a b", ""), (2002, "u", big), (2003, "u", big), (2003, "u", big), (None, "u", big), (2004, "u", "x" * 999), (2005, "u", "x" * 999), (2006, "u", "\x1f\x8b\x08" * 500), (None, None, "z")]
    whole = pages.union(more).union(spark.createDataFrame(odd, pages.schema))
    want = ordered(plain([(r["page_id"], r["html"]) for r in whole.collect()]))
    assert rows_of(warc.round_trip(whole.withColumn("refers_to", F.lit(1)).withColumn("size", F.lit("s")))) == want


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_any_split_gives_each_record_once(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet").coalesce(1)
    archives = warc.write_archives(pages, str(tmp_path / "w"), "page_id", "html", "url")
    want = rows_of(warc.read_archives(archives))
    assert len(want) == pages.count()
    assert rows_of(warc.read_archives(archives, range_bytes=3000)) == want
    text = warc.read_archives(archives, with_payload=True).filter("record_type = 'response'")
    payloads = {int(r["page_id"]): bytes(r["payload"]).decode() for r in text.collect()}
    assert all(payloads[r["page_id"]] == r["html"] for r in pages.collect() if r["page_id"] in payloads)


def test_false_magic_is_not_a_record():
    one = warc.record("1", "u", b"\x1f\x8b\x08 no member", 13, "00" * 20, None)
    two = warc.record("2", "u", b"", 5000, "11" * 20, "1")
    data = b"\x1f\x8b\x08junk" + one + two
    for cut in range(0, len(data), 7):
        found = [*warc.records_in(io_file(data), 0, cut), *warc.records_in(io_file(data), cut, len(data))]
        assert [r[b"warc-record-id"] for r in found] == [b"<urn:x-page:1>", b"<urn:x-page:2>"]


class io_file(io.BytesIO):
    def size(self):
        return len(self.getvalue())
