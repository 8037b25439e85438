"""Web archives (WARC 1.1): writing captures, reading records, assembling transactions.

A capture is written as three records: the request, the response (or a revisit
of an equal payload) and metadata; request and metadata name the response in
``WARC-Concurrent-To``.  The reader returns one row per record; ``assemble``
joins the records of a transaction through those identifiers into one nested row.

Archives are written by Spark's text writer, whose line separator is the blank
line that ends a record, so files are committed like any Spark output; ``gzip``
compresses a file as one member.  They are read whole by ``binaryFile`` and cut
by ``Content-Length``, so ``records_per_file`` bounds what a task holds.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .shared import bytes_of, query, read, small, written

CRLF = "\r\n"
#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT_BYTES = 100
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")
RECORD_FIELDS = ("record_id string, record_type string, target_uri string, concurrent_to string, content_type string, "
                 "payload_digest string, payload_bytes long, page_id long")


def _record(kind: str, record_id: Column, headers: dict[str, Column], block: Column) -> Column:
    """One record but for the blank line that ends it; null headers are left out."""
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record_id]
    for name, value in headers.items():
        lines.append(F.coalesce(F.concat(F.lit(f"{CRLF}{name}: "), value), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit(f"{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF), block)


def _uri(url: Column) -> Column:
    """The address as a header value: white space, which no address has, is percent-encoded."""
    for c in ("\r", "\n", "\t", " "):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return url


def write_captures(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z", records_per_file: int = 6000, compression: str = "gzip") -> None:
    """Write each row as a request, a response or revisit, and a metadata record.

    Of rows with equal payloads of at least ``LEAST_REVISIT_BYTES`` bytes those
    with the smallest id are responses, the others revisits without payload.
    Null bodies are empty payloads; null ids and addresses are left out of the
    records (a null id never is the smallest).  Repeated rows are written again.
    Only repeated digests are joined, so bodies are not shuffled unless there are
    more of them than can be broadcast.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), _uri(F.col(url_col)).alias("uri"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    base = base.withColumns({"digest": F.sha2(bytes_of("body"), 256), "size": F.octet_length("body")})
    repeated = (base.filter(F.col("size") >= LEAST_REVISIT_BYTES).groupBy("digest")
                .agg(F.min("id").alias("first"), F.count("*").alias("c")).filter("c > 1 and first is not null"))
    rows = base.join(small(written(repeated.select("digest", "first"), "digests"), 500_000), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    # one evaluation of the row number names all records of a row
    rows = rows.withColumns({"revisit": revisit, "row": F.monotonically_increasing_id()})
    name = lambda role: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.md5(F.concat_ws(" ", F.lit(role), "row", "digest").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    rows = rows.withColumn("own", name("response"))
    shared = {"WARC-Date": F.lit(date), "WARC-Target-URI": F.col("uri")}
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha256:"), "digest")}
    linked = {"WARC-Concurrent-To": F.col("own")}
    http = {"Content-Type": F.lit("application/http;msgtype=response")}
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    main = F.when(F.col("revisit"), _record("revisit", F.col("own"), shared | digest | http | {"WARC-Profile": F.lit(PROFILE)}, head)).otherwise(
        _record("response", F.col("own"), shared | digest | http, F.concat(head, "body")))
    path_of = F.coalesce(F.regexp_extract(F.col("uri"), r"^[^:/]+://[^/]*(/[^#]*)", 1), F.lit(""))
    request = _record("request", name("request"), shared | linked | {"Content-Type": F.lit("application/http;msgtype=request")},
                      F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    notes = _record("metadata", name("metadata"), shared | linked | {"Content-Type": F.lit("application/warc-fields")},
                    F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")))
    (rows.select(F.explode(F.array(request, main, notes)).alias("value")).write.option("lineSep", CRLF + CRLF)
     .option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path))


def _inflated(raw: bytes) -> bytes:
    """The bytes of a file that may be gzip, in one member or many."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out += [member.decompress(raw), member.flush()]
        raw = member.unused_data
    return b"".join(out)


HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)


def parse_records(data: bytes):
    """(headers by lower-case name, block) of each record; ``ValueError`` where the data is no record."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v.decode("utf-8") for k, v in HEADER.findall(data, data.index(b"\r\n", at) + 2, end)}
        if not headers.get(b"content-length", "").isdigit():
            raise ValueError(f"no Content-Length in the record at byte {at}")
        start, at = end + 4, end + 4 + int(headers[b"content-length"])
        if at > len(data):
            raise ValueError("the last record is cut off")
        yield headers, data[start:at]


def _payload(kind: str, content_type: str, block: bytes) -> bytes:
    """The block without the HTTP head where there is one."""
    if kind != "revisit" and content_type.startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return b"" if kind == "revisit" else block


def read_records(spark: SparkSession, path: str, *, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path`` (``RECORD_FIELDS``; with ``payload`` on request).

    ``payload_digest`` is the bare hex SHA-256 of the payload; of a revisit it is
    the one that its header gives, and ``payload_bytes`` is null.  ``page_id`` is
    read from metadata.  Several ``WARC-Concurrent-To`` headers count as the last.
    """
    fields = RECORD_FIELDS + (", payload binary" if with_payload else "")
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse_records(_inflated(content.as_py())):
                    kind, content_type = h.get(b"warc-type", ""), h.get(b"content-type", "")
                    payload = _payload(kind, content_type, block)
                    revisit = kind == "revisit"
                    digest = h.get(b"warc-payload-digest", "").rpartition(":")[2] or None if revisit else hashlib.sha256(payload).hexdigest()
                    page = re.search(rb"^page-id: (-?\d+)", block, re.M) if kind == "metadata" else None
                    row = (h.get(b"warc-record-id"), kind, h.get(b"warc-target-uri"), h.get(b"warc-concurrent-to"), content_type or None,
                           digest, None if revisit else len(payload), int(page[1]) if page else None)
                    rows.append((*row, payload) if with_payload else row)
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,warc,gz}").load(path)
    return files.select("content").mapInArrow(run, fields)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id`` and the structs ``response``, ``request``, ``metadata``, with ``n_records``.

    A request or metadata record belongs to the record that it names in
    ``concurrent_to``, or that names it; through a request that names the
    response, metadata may also name the request.  A capture without a response
    has a null ``response``.  Of several records with one role the one with the
    smallest record id is shown; ``n_records`` counts all.  Records without an id
    are left out.
    """
    own = records.filter("record_id is not null")
    anchor = F.col("record_type").isin(*ANCHORS)
    both = own.filter("concurrent_to is not null")
    links = (both.filter(~anchor).select(F.col("record_id").alias("k"), F.col("concurrent_to").alias("v"))
             .unionAll(both.filter(anchor).select(F.col("concurrent_to").alias("k"), F.col("record_id").alias("v")))
             .groupBy("k").agg(F.min("v").alias("v")))
    side = own.filter(~anchor).withColumn("named", F.coalesce("concurrent_to", "record_id"))
    side = side.join(links, F.col("named") == F.col("k"), "left").withColumn("capture_id", F.coalesce("v", "named")).drop("named", "k", "v")
    everything = own.filter(anchor).withColumn("capture_id", F.col("record_id")).unionByName(side)
    shown = F.struct("record_id", *[c for c in records.columns if c != "record_id"])
    role = lambda cond, name: F.min(F.when(cond, shown)).alias(name)
    return everything.groupBy("capture_id").agg(role(anchor, "response"), role(F.col("record_type") == "request", "request"),
                                                role(F.col("record_type") == "metadata", "metadata"), F.count("*").alias("n_records"))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``captures`` with ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    A revisit takes its payload's size from the responses with its digest, and
    refers to the smallest page id among them.
    """
    flat = captures.select("*", F.col("metadata.page_id").alias("page_id"), F.col("response.payload_digest").alias("payload_digest"),
                           F.col("response.record_type").alias("record_type"), F.col("response.payload_bytes").alias("__size"))
    first = (flat.filter("record_type <> 'revisit'").groupBy(F.col("payload_digest").alias("__d"))
             .agg(F.min("page_id").alias("__first"), F.max("__size").alias("__full")))
    again = F.when(F.col("record_type") == "revisit", F.col("payload_digest"))
    return (flat.withColumn("__again", again).join(first, F.col("__again") == F.col("__d"), "left")
            .withColumns({"payload_bytes": F.coalesce("__size", "__full"), "refers_to": F.col("__first")})
            .drop("__size", "__d", "__first", "__full", "__again"))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to
FROM m
"""


@query("op3_warc", OP3_SQL)
def op3_warc(spark, sf_dir):
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_captures(read(spark, sf_dir, "pages"), path)
    captures = resolve_revisits(assemble(read_records(spark, path)))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
