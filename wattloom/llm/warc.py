"""WARC archives with revisit records: equal payloads are stored once.

Headers (payload digest and page id) are shuffled by digest to find the payloads that more pages have, and the first page of
each. A bitmap of those digests, of fixed size, tells each task which of its pages are alone: they are written where they
are. Of the others, headers join the first pages, and each task sends a repeated payload once; so payloads of
single pages are never shuffled and those of copies hardly. Each page is a response, or a revisit that refers to one. Spark's
text writer makes the archives (a record ends with the blank lines that it writes as line separator), so
they go to any store Spark knows and a lost task writes its part again. Reading parses whole archives
by Content-Length, hence payloads may hold any text, also that of a WARC header.

Defined results: a null payload is empty; payloads under ``least`` bytes are always responses; rows that
repeat the smallest page id of a payload are responses too; a null page id is written as "null" and is
never the first of its payload unless all its page ids are null; a long payload is one record, whole; other columns, of
whatever name, are ignored; an empty table gives no archive rows.
"""

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import bitmap
from wattloom.llm.storage import Scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")


def resolve_revisits(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html",
                     least: int = 100) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col(html), F.lit(""))
    lean = pages.select(
        F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    long_enough = F.col("payload_bytes") >= least
    repeated = Scratch(pages.sparkSession).store("repeated-payloads", lean.filter(long_enough).groupBy(
        "payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    words = bitmap.build(repeated.select(bitmap.hashed(F.col("payload_digest")).alias("h")), "h")
    maybe = long_enough & bitmap.may_contain(words, bitmap.hashed(F.col("payload_digest")))
    nothing = F.lit(None).cast("long")
    alone = lean.filter(~maybe).withColumn("refers_to", nothing)

    copies = lean.filter(maybe)
    first = F.col("first_id")
    # A set bit proves nothing: a page without a repeated digest finds no first page and is a response.
    resolved = copies.drop("payload").join(repeated.drop("n"), "payload_digest", "left").withColumn(
        "refers_to", F.when(first.isNotNull() & ~F.col("page_id").eqNullSafe(first), first)).drop("first_id")
    payloads = copies.groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    responses = resolved.filter("refers_to IS NULL").join(payloads, "payload_digest")
    revisits = resolved.filter("refers_to IS NOT NULL").withColumn("payload", F.lit(None).cast("string"))
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    return alone.select(*names).unionByName(responses.select(*names)).unionByName(revisits.select(*names))


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def record_text(date: str) -> Column:
    """The WARC record of a resolved page, without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _uri(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "),
                                 _uri(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END), body)


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   records_per_file: int = 2000) -> None:
    """Write one gzip archive per ``records_per_file`` records, or fewer, into the new folder ``path``."""
    resolved.select(record_text(date).alias("record")).write.option("lineSep", END).option(
        "compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    data, at = gzip.decompress(content), 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        at = stop + 4 + int(headers["content-length"])
        yield headers, data[stop + 4:at]
        at += 4


def _page_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return None if number == "null" else int(number)


def _record(headers: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(head.rpartition(b"Content-Length: ")[2])
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    kind, refers = headers["warc-type"], None
    if kind == "revisit":
        refers = _page_of(headers["warc-refers-to"])
    elif len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged record {headers['warc-record-id']}")
    return (_page_of(headers["warc-record-id"]), headers["warc-target-uri"], length, digest, kind, refers,
            payload if keep_payload and kind == "response" else None)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record (see ``RECORD``); a damaged response is an error. Revisits have no payload."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [_record(h, b, keep_payload) for h, b in parse_archive(content.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], schema=schema)

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return archives.select("content").mapInArrow(parse, RECORD)
