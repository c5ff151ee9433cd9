"""Operator 3, WARC revisit resolution.

Pages are written as WARC/1.1 response records, one record a page. Reading
the archives back gives one small header row a record; the headers are
shuffled by payload digest (aggregated first, so a digest with a third of all
records is no hot task), the record with the largest page id of each digest
is the original, and a second set of archives is written with fresh headers:
originals with their payload, all others as revisit records without one that
refer to the original. Reading these again joins each revisit record to its
response, for the payload's length.

Archives are gzip files written by Spark's text sink: a record ends with two
line breaks, which is the sink's line separator, and a file has FILE_RECORDS
records at most. They are read with Spark's binaryFile source, so they may lie
in any store, and are parsed by Content-Length, so payloads may hold any
bytes: they are carried as bytes and written as they were. Rewritten records
keep their date, HTTP status and HTTP headers. binaryFile takes files up to
2 GB; a larger archive is an error.

A null payload counts as empty; empty payloads equal each other; line breaks
in a url are percent-encoded; a null url or page id leaves its header out and
comes back as null, and a null page id sorts below all others; of repeated
rows exactly one is the response; an empty table gives empty archives and an
empty result; extra columns are not archived.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, shared_path

#: Fixed values of the WARC/1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Payloads of fewer bytes are never made revisits.
MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
#: Most records of a file written, and lots that the revisits of an original
#: are dealt to when it is looked up.
FILE_RECORDS, LOTS = 4096, 16
#: Rows and payload bytes of a batch that leaves the parser.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

HEADER = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to string, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: each 5 hex digits of the digest are 4 characters."""
    digest = F.sha1(payload)
    parts = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, by).bitwiseAND(31) + 1, F.lit(1)) for by in (15, 10, 5, 0)]
    return F.concat(*parts)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _size(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def _record(record_type: Column, block: Column, date: Column) -> Column:
    """The text of a record from the columns of HEADER and its block."""
    revisit = record_type == "revisit"
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"{VERSION}\r\n"), _header("WARC-Type", record_type), _header("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        _header("WARC-Target-URI", url), _header("WARC-Date", date),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), F.col("refers_to"), F.lit(">")))),
        _header("X-Page-Id", F.col("page_id").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", _size(block).cast("string")),
        F.lit("\r\n"), block)


def _http(payload_bytes: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    payload_bytes.cast("string"), F.lit(END))


def _write(records: Column, rows: DataFrame, path: str) -> str:
    rows.select(records.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> str:
    """One response record a row, below the new folder ``path``."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
                        base32_sha1(payload).alias("payload_digest"), F.lit(None).cast("string").alias("refers_to"),
                        # an id for the record, fixed once it is written
                        F.concat(F.lit("urn:record:"), F.monotonically_increasing_id().cast("string")).alias("record_id"))
    return _write(_record(F.lit("response"), F.concat(_http(_size(F.col("payload"))), F.col("payload")), F.lit(date)), rows, path)


def _parse(content: bytes) -> Iterator[tuple]:
    """(WARC headers, HTTP head, payload) of each record of one archive file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            head[name.decode().lower()] = value.decode()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        http, _, payload = block.partition(END.encode())
        yield head, http, payload


def read_records(spark: SparkSession, path: str, payloads: bool = False, raw: bool = False) -> DataFrame:
    """The records of all archives below ``path``: the columns of HEADER, and
    if asked for the payload as text (bytes that are no UTF-8 are replaced) or,
    ``raw``, date, HTTP head and payload as they are. ``intact``: the payload
    has the digest named."""
    schema = HEADER + (", payload string" if payloads else "") + (", date string, http binary, payload binary" if raw else "")

    def rows(batches):
        out, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for head, http, payload in _parse(content.as_py()):
                    named = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    kind = head["warc-type"]
                    digest = _b32(payload) if kind == "response" else named
                    page = head.get("x-page-id")
                    out.append((head["warc-record-id"].strip("<>"), kind, None if page is None else int(page), head.get("warc-target-uri"),
                                named, len(payload) if kind == "response" else None,
                                head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, digest == named)
                               + ((payload.decode("utf-8", "replace"),) if payloads else ())
                               + ((head.get("warc-date"), http, payload) if raw else ()))
                    held += len(payload) if payloads or raw else 0
                    if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(out, payloads, raw)
                        out, held = [], 0
        if out:
            yield _batch(out, payloads, raw)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(rows, schema)


def _b32(payload: bytes) -> str:
    import base64
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _batch(rows: list[tuple], payloads: bool, raw: bool) -> pa.RecordBatch:
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()),
              ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("intact", pa.bool_())] + [("payload", pa.string())] * payloads
    fields += [("date", pa.string()), ("http", pa.binary()), ("payload", pa.binary())] * raw
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(record_id, refers_to): the original's record for each record that is
    to become a revisit, null for originals. Headers only are shuffled."""
    big = headers.filter((F.col("payload_bytes") >= min_bytes) & F.col("intact"))
    first = big.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id")).alias("original"))
    pairs = big.select("record_id", "payload_digest", "payload_bytes").join(first, ["payload_digest", "payload_bytes"])
    return pairs.filter(F.col("record_id") != F.col("original.record_id")).select("record_id", F.col("original.record_id").alias("refers_to"))


def deduplicate(spark: SparkSession, source: str, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> str:
    """Write the archives of ``source`` below ``path`` again, payloads once."""
    headers = keep(read_records(spark, source), "warc-headers")
    revisits = keep(resolve(headers, min_bytes), "warc-revisits").withColumnRenamed("refers_to", "original")
    rows = (read_records(spark, source, raw=True).drop("refers_to").join(revisits, "record_id", "left")
            .withColumnRenamed("original", "refers_to"))
    revisit = F.col("refers_to").isNotNull()
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.col("record_type"))
    # bytes as text of the same bytes, which the sink writes as they are
    head = F.concat(F.col("http").cast("string"), F.lit(END))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload").cast("string")))
    return _write(_record(kind, block, F.coalesce("date", F.lit(date))), rows, path)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """Every record of deduplicated archives, revisits joined to their
    originals: page_id, payload_bytes, payload_digest, record_type, refers_to
    (the original's page id), url."""
    records = keep(read_records(spark, path), "warc-records")
    revisit = F.col("record_type") == "revisit"
    lot = F.pmod(F.xxhash64("record_id"), F.lit(LOTS))
    revisits = records.filter(revisit).withColumn("lot", lot)
    known = revisits.select(F.col("refers_to").alias("record_id")).distinct()
    originals = (records.filter(~revisit).join(known, "record_id", "left_semi")
                 .select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original"), F.col("payload_bytes").alias("original_bytes"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOTS - 1).cast("long"))).alias("lot")))
    # responses refer to nothing and take no part in the join
    found = revisits.join(originals, ["refers_to", "lot"], "left").select(
        "page_id", F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("original").alias("refers_to"), "url")
    return found.unionByName(records.filter(~revisit).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "url"))


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write, deduplicate and read back ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    raw = write_pages(pages, shared_path(spark, "warc-raw"))
    return read_resolved(spark, deduplicate(spark, raw, shared_path(spark, "warc"), min_bytes))
