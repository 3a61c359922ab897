"""WARC archives: writing records, long ones in segments, and reassembling them when reading back.

Archives are gzipped files of bounded size that Spark's writer puts in the shared folder. A record's block
is an HTTP response with chunked transfer framing. Continuation records name their origin; reading groups
them by it, orders them by segment number, verifies the total length and decodes the framing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, new_path

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 32 << 10, 4 << 10, 1000
#: Payloads that occur more than once whose (digest, page) may be broadcast; more are joined by shuffle.
BROADCAST_REPEATS = 100_000
_VERSION, _END = b"WARC/1.1\r\n", b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size:
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 2 + size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return _VERSION + lines.encode() + b"\r\n" + block


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def page_records(page_id: int | None, uid: int, url: str | None, payload: bytes, response: tuple[int, int] | None, date: str, segment_bytes: int) -> list[bytes]:
    """The records of a page: a revisit of response (page, uid), or a response in one or more segments."""
    name = lambda page, own: f"<urn:page:{'' if page is None else page}:{own & (2**64 - 1):016x}>"
    own = [("WARC-Record-ID", name(page_id, uid)), ("WARC-Date", date), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if response:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [_record([("WARC-Type", "revisit"), *own, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(*response))], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), *own], block)]
    out = [_record([("WARC-Type", "response"), *own, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if n == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[0][1][:-1]}:{n}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own[0][1]), ("WARC-Segment-Number", n), *total], part))
    return out


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes every row as a WARC record and returns the folder.

    Of rows with equal payloads of at least least_revisit_bytes bytes, the one with the smallest id (then
    the smallest row hash) is a response and the others revisit it. Rows that are equal in id, url and
    payload are one record, written as often. Null payloads are empty; null ids come last. Other columns
    are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("sha"), F.xxhash64("page_id", "url", "html").alias("uid"))
    own = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uid")
    repeats = rows.where(F.octet_length("html") >= least_revisit_bytes).groupBy("sha").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    few = repeats.count() <= BROADCAST_REPEATS
    rows = rows.join(F.broadcast(repeats) if few else repeats, "sha", "left")
    rows = rows.withColumn("revisits", F.coalesce((F.col("first") != own) & (F.octet_length("html") >= least_revisit_bytes), F.lit(False)))
    rows = rows.select("page_id", "uid", "url", F.col("html").cast("binary").alias("html"), "revisits", F.col("first.page_id").alias("to_page"), F.col("first.uid").alias("to_uid"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                out = []
                for r in batch.slice(i, 256).to_pylist():
                    out += page_records(r["page_id"], r["uid"], r["url"], r["html"], (r["to_page"], r["to_uid"]) if r["revisits"] else None, date, segment_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    path = new_path(pages.sparkSession, "warc")
    lines = bounded_batches(rows).mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of a plain or gzipped archive."""
    while data[:2] == b"\x1f\x8b":
        plain, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            plain.append(member.decompress(rest))
            rest = member.unused_data
        data = b"".join(plain)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(_END, at)
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


_READ = "record_id string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"
_SEGMENT = "origin string, number int, total long, page_id long, url string, payload_digest string, block binary"


def _page(name: str | None) -> int | None:
    digits = (name or "").split(":")[2:3]
    return int(digits[0]) if digits and digits[0] else None


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(_END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _decoded(record_id: str, page_id: int | None, url: str | None, stated: str | None, block: bytes, error: str | None = None) -> tuple:
    payload = None
    try:
        payload = None if error else _payload(block)
    except ValueError as e:
        error = str(e)
    found = None if payload is None else digest(payload)
    if found and stated and found != stated:
        error = "the payload's digest differs"
    return record_id, page_id, url, "response", None, payload, None if payload is None else len(payload), found, error


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    for batch in batches:
        for content in batch["content"]:
            yield from parse_records(content.as_py())


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response and revisit: record_id, page_id, url, record_type, refers_to (a page), payload, payload_bytes, payload_digest, error.

    Segments are put together by origin and number. A missing segment, a total length that differs, broken
    framing or another digest is told in error. A revisit has no payload of its own.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for h, block in _contents(batches):
            if h["warc-type"] == "revisit":
                head = {k.strip().lower(): v for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n"))}
                rows.append((h["warc-record-id"], _page(h["warc-record-id"].strip("<>")), h.get("warc-target-uri"), "revisit", _page(h.get("warc-refers-to", "").strip("<>")), None, int(head["content-length"]) if "content-length" in head else None, h.get("warc-payload-digest", "").removeprefix("sha1:"), None))
            elif h["warc-type"] == "response" and "warc-segment-number" not in h:
                rows.append(_decoded(h["warc-record-id"], _page(h["warc-record-id"].strip("<>")), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), block))
            if len(rows) >= 500:
                yield _arrow(rows, _READ)
                rows = []
        yield _arrow(rows, _READ)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for h, block in _contents(batches):
            if "warc-segment-number" in h:
                own = h["warc-record-id"]
                first = h["warc-type"] != "continuation"
                rows.append((own if first else h["warc-segment-origin-id"], int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, _page(own.strip("<>")), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"), block))
            if len(rows) >= 500:
                yield _arrow(rows, _SEGMENT)
                rows = []
        yield _arrow(rows, _SEGMENT)

    def assemble(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        parts = {r["number"]: r for r in rows}
        total = next((r["total"] for r in rows if r["total"] is not None), None)
        block = b"".join(parts[n]["block"] for n in sorted(parts))
        error = "a segment is missing" if sorted(parts) != list(range(1, len(parts) + 1)) else "the total length differs" if total != len(block) else None
        first = rows[0]
        copies = max(1, sum(r["number"] == 1 for r in rows))
        return pa.Table.from_batches([_arrow([_decoded(first["origin"], first["page_id"], first["url"], first["payload_digest"], block, error)] * copies, _READ)])

    files = _archives(spark, path)
    return bounded_batches(files).mapInArrow(whole, _READ).union(files.mapInArrow(segments, _SEGMENT).groupBy("origin").applyInArrow(assemble, _READ))
