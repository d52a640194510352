"""WARC archives with an index, read back by coalesced byte ranges.

Writing: payload digests that repeat are joined with the smallest page_id of each (only ids, sizes
and digests are aggregated; hot digests are broadcast, so no key holds many payloads); a page is a ``response`` record if it is that page and a
``revisit`` record otherwise.  Tasks write archive files of about ``ARCHIVE_BYTES`` and return
an index row (file, offset, length, URL, digest) for every record.  The index is written as a
table before anything is read: records are only ever found through it, so the archives of
attempts that did not commit are never read.

Reading: the selected index rows of a file are sorted by offset and neighbouring ranges (at
most ``GAP`` bytes apart, at most ``SPAN`` bytes in all) are read at once.  A record is cut out
of its range by offset and length, and its own headers are parsed.

Defined cases: a null html is an empty payload; a null URL is written as ``urn:none``; rows with
the same page_id and the same payload are records of the same kind; payloads smaller than
``min_payload`` are never revisits; a null page_id can only be the response of its payload if
no other row has it; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import broadcast_if_small, materialize, new_path, table, tasks_for, with_scheme
from lexmill.llm.files import read_range, write_file

ARCHIVE_BYTES = 16_000_000
GAP, SPAN = 65_536, 8_000_000
MIN_PAYLOAD = 0
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
NO_URL = "urn:none"
#: A digest of so large a share of the rows is hot; there are at most as many of them.
HOT_SHARE = 10_000
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def target_uri(url: str | None) -> str | None:
    """A URL as its record has it: what may not stand in a header is percent-encoded."""
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]", errors="replace") if url else None


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, target: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; the HTTP head tells the full payload's length, also in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target or NO_URL}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", *([f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else [])]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], int]:
    """The named fields up to the empty line, and where what follows begins."""
    end = block.index(b"\r\n\r\n")
    lines = block[:end].decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}, end + 4


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """The fields of one whole record."""
    head, at = _headers(data)
    block = data[at : at + int(head["content-length"])]
    http, body = _headers(block)
    revisit = head["warc-type"] == "revisit"
    return {
        "page_id": _page(head["warc-record-id"]), "url": None if head["warc-target-uri"] == NO_URL else head["warc-target-uri"], "payload_bytes": int(http["content-length"]), "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to")), "payload": None if revisit else block[body:],
    }


def _write_archives(folder: str):
    names = [part.split()[0] for part in INDEX.split(", ")]

    def run(batches):
        part, number, held, size, index = TaskContext.get().partitionId(), 0, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal held, size, index, number
            uri = write_file(folder, f"{part:06d}-{number:06d}.warc", b"".join(held))
            rows = [dict(zip(names, (uri, *row))) for row in index]
            held, size, index, number = [], 0, [], number + 1
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, types))))

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "refers_to", "revisit"))):
                page_id, url, payload, refers_to, revisit = row
                digest = base32_digest(payload)
                target = target_uri(url)
                record = _record(page_id, target, payload, digest, refers_to, revisit)
                index.append((size, len(record), page_id, target, digest, "revisit" if revisit else "response"))
                held.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return run


def _by_heat(copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The digests of many rows, always broadcast since they are at most ``HOT_SHARE``, and all others:
    broadcast too if a count says that they are few, so that no payload is shuffled."""
    bound = (copies.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    return F.broadcast(copies.filter(F.col("n") > bound)), broadcast_if_small(copies.filter(F.col("n") <= bound))


def write_archives(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files; returns the index, a row for each record."""
    spark = pages.sparkSession
    folder = with_scheme(spark, new_path(spark, "warc"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    copies = source.filter(F.octet_length("payload") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    copies = materialize(copies.filter("n > 1"), "repeated-digests")
    known = source
    for part, repeated in enumerate(_by_heat(copies)):
        known = known.join(repeated.select("digest", F.col("first_id").alias(f"first_{part}")), "digest", "left")
    first_id = F.coalesce("first_0", "first_1")
    revisit = first_id.isNotNull() & ~F.col("page_id").eqNullSafe(first_id)
    known = known.select("page_id", "url", "payload", F.when(revisit, first_id).alias("refers_to"), revisit.alias("revisit"))
    return materialize(known.mapInArrow(_write_archives(folder), INDEX), "warc-index")


def _read_ranges(batches):
    types = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            start = row["start"]
            data = read_range(row["file"], start, row["end"] - start)
            records = [parse_record(data[r["offset"] - start : r["offset"] - start + r["length"]]) for r in row["records"]]
            yield pa.RecordBatch.from_pylist(records, schema=types)


def read_records(index: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The records whose index rows fulfil ``wanted``, by coalesced range reads in file order."""
    chosen = (index if wanted is None else index.filter(wanted)).select("file", "offset", "length")
    by_offset = Window.partitionBy("file").orderBy("offset")  # a file is of bounded size
    before = by_offset.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("offset") - F.coalesce(F.max(F.col("offset") + F.col("length")).over(before), F.col("offset"))
    # A range ends at a gap that is not worth reading over, and at every SPAN bytes of the file.
    piece = F.floor(F.col("offset") / SPAN)
    opens = (gap > GAP) | (piece != F.coalesce(F.lag(piece).over(by_offset), piece))
    ranged = chosen.withColumn("range", F.sum(opens.cast("int")).over(by_offset))
    ranges = ranged.groupBy("file", "range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
    total = chosen.agg(F.sum("length")).first()[0] or 0
    # Dealt by what has to be read: the index rows alone are so few bytes that one task would get them all.
    dealt = ranges.repartition(tasks_for(total), "file", "range")
    return dealt.select("file", "start", "end", "records").mapInArrow(_read_ranges, RECORD)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Bare base32 of SHA-1: 160 bits are 32 digits of 5 bits, read off the hex digits.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (
  SELECT page_id, html, hex,
    list_aggregate(list_transform(range(4), lambda q: list_aggregate(list_transform(range(8), lambda d:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, 10 * q + 1, 10) AS BIGINT) >> CAST(35 - 5 * d AS INTEGER)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b JOIN f USING (hex)
"""
