"""WARC archives: one transaction of records per captured page, written and assembled again.

:func:`write_archive` writes, for every page, a request record, a response record (or a revisit of the response with the
same payload and the smallest page_id) and a metadata record; request and metadata name the capture's record in
WARC-Concurrent-To. Records are lines of Spark's text writer whose separator is the CRLF CRLF that ends a WARC record,
gzip-compressed (one gzip stream a file), so the archive lies wherever Spark can write. :func:`read_archive` streams the
files chunk by chunk, puts blocks together by Content-Length and measures and hashes each block's payload, and
:func:`assemble` joins records through their concurrent-to identifiers into one nested row per capture; where nobody asks
for the blocks of responses, they don't travel. No step holds more than some records at a time, whatever the
size of a file; ``records_per_file`` sets only how finely an archive can be read in parallel.

Defined cases: null html is an empty payload; a null page_id is written as ``null`` and never the target of a revisit
while a row with an id has the same payload; repeated rows of a page_id are captures of their own that share a record
id, and each comes back; null urls become empty; empty tables give empty archives and results; control characters in
urls are percent-encoded; very large pages are single rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm.common import fresh_path, no_nulls

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(text: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1 of a string or binary column: 160 bits are 8 runs of 20, each of 5 hexadecimal
    or 4 base32 digits. The hash is bound to a variable, as an expression inside the runs would be evaluated for each."""
    digit = lambda v, shift: F.substring(F.lit(_ALPHABET), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    run = lambda v: F.concat(digit(v, 15), digit(v, 10), digit(v, 5), digit(v, 0))
    runs = lambda h: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(h, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    return F.get(F.transform(F.array(F.sha1(text)), lambda h: F.array_join(F.transform(runs(h), run), "")), F.lit(0))


def _record(kind: F.Column | str, record_id: F.Column, url: F.Column, extra: list[F.Column], content_type: str, block: F.Column) -> F.Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), F.lit(f"WARC-Date: {_DATE}"), F.concat(F.lit("WARC-Target-URI: "), url), *extra, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit("\r\n\r\n"), block)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> DataFrame:
    """The records of each page, as one string column ``value``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(no_nulls(url_col), "[\\x00-\\x20\\x7F]", "%20").alias("url"), no_nulls(html_col).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("equal", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    firsts = rows.groupBy("equal").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(firsts, "equal")
    rows = rows.withColumn("revisit", (F.col("bytes") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    name = lambda what, of="page_id": F.concat(F.lit("urn:nodeloom:"), F.coalesce(F.col(of).cast("string"), F.lit("null")), F.lit(f":{what}"))
    capture = F.concat(name("capture"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    together = F.concat(F.lit("WARC-Concurrent-To: <"), capture, F.lit(">"))
    main = F.when(F.col("revisit"), _record("revisit", capture, F.col("url"), [digest, F.lit(f"WARC-Profile: {_REVISIT}"), F.concat(F.lit("WARC-Refers-To: <"), name("capture", "first_id"), F.lit(">"))], "application/http;msgtype=response", http))
    main = main.otherwise(_record("response", capture, F.col("url"), [digest], "application/http;msgtype=response", F.concat(http, F.col("html"))))
    request = _record("request", name("request"), F.col("url"), [together], "application/http;msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record("metadata", name("metadata"), F.col("url"), [together], "application/warc-fields", F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("\r\npayload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n")))
    return rows.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archive(pages: DataFrame, path: str, records_per_file: int = 6000, **columns: str) -> None:
    plan_records(pages, **columns).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_FIELDS = [("kind", "string"), ("record_id", "string"), ("concurrent_to", "string"), ("refers_to", "string"), ("url", "string"), ("digest", "string"), ("block", "binary"), ("payload_bytes", "long"), ("payload_digest", "string"), ("stated_bytes", "long")]
_RECORD = ", ".join(f"{n} {t}" for n, t in _FIELDS)
_ARROW = pa.schema([(n, {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[t]) for n, t in _FIELDS])
_NAMES = {b"warc-type": 0, b"warc-record-id": 1, b"warc-concurrent-to": 2, b"warc-refers-to": 3, b"warc-target-uri": 4, b"warc-payload-digest": 5}


_END = b"\r\n\r\n"


def parse_records(chunks: Iterable[bytes]) -> Iterator[list]:
    """Records of archive files that come as the chunks between CRLF CRLF, one file after the other.

    A chunk that is a record's head says how long the block behind it is; the block's chunks are put together again, so
    it may hold CRLF CRLF and lines that look like a head. A block that ends in CRLF runs into the next head, which is
    then cut off it. Chunks outside records are passed over.
    """
    row: list | None = None
    length = held = 0
    block: list[bytes] = []
    for chunk in chunks:
        if row is not None:
            block.append(chunk)
            held += len(_END) + len(chunk)
            if held < length:
                continue
            joined = _END.join(block)
            row[6] = joined[:length]
            yield row
            row, chunk = None, joined[length + len(_END) :]
        if chunk.startswith(b"WARC/1."):
            row, block, length, held = [None] * 7, [], 0, -len(_END)
            for line in chunk.split(b"\r\n")[1:]:
                key, _, value = line.partition(b":")
                key, value = key.strip().lower(), value.strip()
                if key == b"content-length":
                    length = int(value)
                elif (k := _NAMES.get(key)) is not None:
                    row[k] = value.decode("utf-8", "replace").strip("<>")


_STATED = re.compile(rb"(?i)^content-length: *([0-9]{1,18})", re.M)


def payload_of(block: bytes) -> tuple[int, str, int | None]:
    """Bytes behind the head of an HTTP block (all of a block without one), their bare base32 SHA-1, and the length that
    the head states."""
    end = block.find(_END)
    data = memoryview(block)[end + len(_END) if end >= 0 else 0 :]
    stated = _STATED.search(block, 0, end) if end >= 0 else None
    return len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), int(stated[1]) if stated else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    held = 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW.types)], schema=_ARROW)
    for row in parse_records(chunk for batch in batches for chunk in batch.column(0).to_pylist()):
        rows.append([*row, *payload_of(row[6])])
        held += len(row[6])
        if held > 4 << 20 or len(rows) == 5000:
            yield made()
            rows, held = [], 0
    yield made()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record: kind, ids, url, digest, block, and its payload's size and digest as they were read, and the size stated.

    Files are streamed; a task holds some records at a time.
    """
    chunks = spark.read.option("lineSep", "\r\n\r\n").option("pathGlobFilter", "*.txt*").text(path)
    return chunks.select(F.col("value").cast("binary")).mapInArrow(_parse, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, url, kind, digest, refers_to, response, request, metadata."""
    main = records.where(F.col("kind").isin("response", "revisit"))
    side = lambda kind: records.where(F.col("kind") == kind).groupBy("concurrent_to").agg(F.first(F.struct("record_id", "block")).alias(kind)).withColumnRenamed("concurrent_to", f"{kind}_of")
    out = main.join(side("request"), F.col("record_id") == F.col("request_of"), "left").join(side("metadata"), F.col("record_id") == F.col("metadata_of"), "left")
    return out.select("record_id", "url", "kind", "digest", "refers_to", F.struct("block", "payload_bytes", "payload_digest", "stated_bytes").alias("response"), "request", "metadata")


def capture_digests(captures: DataFrame) -> DataFrame:
    """What the op's query returns, from assembled captures alone."""
    as_text = lambda b: b.cast("string")  # noqa: E731  the same bytes
    response = F.col("kind") == "response"
    return captures.select(
        F.regexp_extract(as_text(F.col("metadata.block")), "page_id: (-?[0-9]+)", 1).try_cast("long").alias("page_id"),
        F.when(response, F.col("response.payload_bytes")).otherwise(F.col("response.stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("response.payload_digest")).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.regexp_extract("refers_to", ":(-?[0-9]+):", 1).try_cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame, min_payload: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` as an archive in the shared folder, read it back and assemble it."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path, min_payload=min_payload, **columns)
    return assemble(read_archive(pages.sparkSession, path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""
