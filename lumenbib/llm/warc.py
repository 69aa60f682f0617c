"""WARC archives: a writer with revisit records, and a splittable reader (method: byte ranges and gzip magic).

Every record is a gzip member of its own. A reader task gets a byte range of a file, looks for the gzip magic in it,
accepts a candidate only if it inflates to a complete WARC record that is followed by another member or the file's end,
and owns the records that start inside its range; the last one is read beyond the range's end. Ranges of a file can so
be read by different tasks without an index.

The writer finds equal payloads by digest: the record with the largest id is the response, the others are revisits of
it; payloads under ``least_bytes`` are always responses. Only (digest, id) rows of repeated payloads are aggregated;
the join that marks them can be split by adaptive execution when one payload holds a large share.

A null payload is an empty one. Rows that repeat an id and a payload are all responses if theirs is the largest id; a
null id is never the largest. An empty table gives no archive and no rows. Columns that are not named are not looked
at. Files go to a shared folder; each is written under a name of the attempt and then moved, so that a lost executor
leaves no half file under a final name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenbib.session import checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 16 << 20
BLOCK = 1 << 18
# Names and forms of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


# ---------------------------------------------------------------- records


def record_name(key: str) -> bytes:
    return b"<urn:x-page:%s>" % key.encode()


def record(key: str, uri: str, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit keeps the response's HTTP head, with the full length, and no payload."""
    block = HTTP % size + (b"" if refers_to is not None else payload)
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: " + record_name(key),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + re.sub(r"\s+", "%20", uri).encode(),
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)),
        b"Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + record_name(refers_to)]
    head.append(b"Content-Length: %d" % len(block))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict | None:
    """Fields of an inflated record, or None if it is none."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or rest[int(length) :] != b"\r\n\r\n":
        return None
    fields[b"block"] = rest[: int(length)]
    return fields


# ---------------------------------------------------------------- byte ranges


class Window:
    """Random reads of a file through one block."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def read(self, start: int, n: int = BLOCK) -> bytes:
        if not self.at <= start < self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(BLOCK)
        return self.held[start - self.at : start - self.at + n]

    def find(self, start: int, end: int) -> int:
        """First gzip magic that starts in the range; -1 if there is none."""
        while start < end:
            part = self.read(start)
            if len(part) < len(MAGIC):  # the block's end: read anew from here
                self.held = b""
                part = self.read(start)
            k = part.find(MAGIC, 0, end - start + len(MAGIC) - 1)
            if k >= 0:
                return start + k
            if start + len(part) >= self.size:
                return -1
            start += max(1, len(part) - len(MAGIC) + 1)
        return -1

    def inflate(self, start: int) -> tuple[bytes, int] | None:
        """The member that starts here and where it ends; None if it is no whole member of a WARC record."""
        member, out, at = zlib.decompressobj(31), [], start
        try:
            while not member.eof:
                part = self.read(at)
                if not part:
                    return None
                out.append(member.decompress(part))
                at += len(part)
                if len(out) == 1 and not out[0][:7].startswith(b"WARC/1."[: len(out[0])]):
                    return None
        except zlib.error:
            return None
        end = at - len(member.unused_data)
        return b"".join(out), end


def records_in(file, start: int, end: int) -> Iterator[dict]:
    """Records that start in a byte range, in order."""
    window = Window(file)
    at = window.find(start, min(end, window.size))
    while at >= 0:
        got = window.inflate(at)
        fields = parse(got[0]) if got else None
        follows = got and (got[1] == window.size or window.find(got[1], got[1] + 1) == got[1])
        after = at + 1
        if fields and follows:
            yield fields
            after = got[1]
        at = window.find(after, min(end, window.size))


# ---------------------------------------------------------------- Spark


def mark_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Adds ``digest``, ``size`` and ``refers_to`` to (id, uri, payload)."""
    sized = pages.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = sized.filter(F.col("size") >= least_bytes)
    heads = large.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("head"))
    repeated = heads.filter("n > 1").select("digest", "head")
    other = (F.col("size") >= least_bytes) & (F.col("id").isNull() | (F.col("id") < F.col("head")))
    marked = sized.join(repeated, "digest", "left").withColumn("refers_to", F.when(other, F.col("head")))
    return marked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).drop("head")


def write_archives(
    pages: DataFrame, folder: str, page_id: str, payload: str, uri: str | None = None, least_bytes: int = 1000
) -> DataFrame:
    """Writes one archive per task into ``folder`` and returns (path, bytes, records) per archive."""
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    where = F.coalesce(F.col(uri).cast("string"), F.lit("")) if uri else F.lit("")
    rows = mark_revisits(pages.select(F.col(page_id).alias("id"), where.alias("uri"), body.alias("payload")), least_bytes)
    rows = rows.select(F.col("id").cast("string"), "uri", "payload", "size", "digest", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, n, out, size = f"{name}.{uuid.uuid4().hex}", 0, None, 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                out = out or system.open_output_stream(draft)
                member = record(r[0] or "", r[1], r[2] or b"", *r[3:])
                out.write(member)
                n, size = n + 1, size + len(member)
        if out:
            out.close()
            system.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "bytes": [size], "records": [n]})

    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    written = rows.mapInArrow(run, "path string, bytes long, records long")
    return pages.sparkSession.createDataFrame(written.collect(), written.schema)  # a row per file


READ = "page_id string, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to string"


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of archives given as (path, bytes), each file cut into byte ranges that any task can read."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = archives.select("path", F.explode(starts).alias("start"))
    width = max(1, ranges.count())
    ranges = ranges.repartition(width, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                system, name = file_system(path)
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    for fields in records_in(file, start, start + range_bytes):
                        rows.append(row_of(fields, with_payload))
                        held += len(fields[b"block"]) if with_payload else 0
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield to_batch(rows, with_payload)
                            rows, held = [], 0
                if rows:
                    yield to_batch(rows, with_payload)

    return ranges.mapInArrow(run, READ + (", payload binary" if with_payload else ""))


def row_of(fields: dict, with_payload: bool) -> tuple:
    kind = fields[b"warc-type"].decode()
    head, _, payload = fields[b"block"].partition(b"\r\n\r\n")
    if kind == "revisit":  # of the response's payload: the digest named here, the length in its HTTP head
        digest = base64.b32decode(fields[b"warc-payload-digest"].partition(b":")[2]).hex()
        size = int(re.search(rb"(?i)\ncontent-length:\s*(\d+)", head)[1])
    else:
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)

    def key(name: bytes) -> str | None:
        m = re.fullmatch(r"<urn:x-page:(.+)>", fields.get(name, b"").decode())
        return m[1] if m else None

    row = (key(b"warc-record-id"), fields.get(b"warc-target-uri", b"").decode(), kind, size, digest, key(b"warc-refers-to"))
    return (*row, payload if kind == "response" else None) if with_payload else row


def to_batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    text, long = pa.string(), pa.int64()
    kinds = [text, text, text, long, text, text] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in READ.split(", ")] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, page_id: str = "page_id", payload: str = "html", uri: str | None = "url") -> DataFrame:
    """Writes all pages as archives and reads the archives back."""
    folder = archive_folder(pages.sparkSession)
    records = read_archives(write_archives(pages, folder, page_id, payload, uri))
    kind = pages.schema[page_id].dataType
    return records.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
